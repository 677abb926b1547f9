"""Column functions: parsing, labels, guards and comparisons.  Missing numbers are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE_ABSOLUTE, CLOSE_RELATIVE = 1e-8, 1e-5


def number(x: Column | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x


def nan_to_null(x: Column) -> Column:
    """NaN compares as larger than any number in Spark, so it is turned into NULL at every boundary."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def slug(x: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def rule_label(method: Column, threshold: Column) -> Column:
    return F.format_string("%s@%.2f", method, threshold)


def parse_list(x: Column, kind: str = "double") -> Column:
    """A comma list as an array: parts are trimmed, empty ones dropped."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast(kind))


def parse_range_list(x: Column, low: int, high: int) -> Column:
    """A comma list of integers between two bounds, each once, ascending."""
    return F.array_sort(F.array_distinct(F.filter(parse_list(x, "int"), lambda v: (v >= low) & (v <= high))))


def feature_rank(name: Column) -> Column:
    """The rank k in names such as pca32_centered_cosine or pca8_neg_l2, or NULL."""
    k = F.regexp_extract(name, r"^pca(\d+)_(centered_cosine|neg_l2)$", 1)
    return F.when(k != "", k.cast("int"))


def strip_suffix(x: Column, suffix: str) -> Column:
    return F.when(x.endswith(suffix), F.substring(x, 1, F.length(x) - len(suffix))).otherwise(x)


def shift_magnitude(x: Column, shift: Column | float) -> Column:
    """Moves a value away from zero by ``shift``; zero counts as positive."""
    return F.when(x < 0, -1.0).otherwise(1.0) * (F.abs(x) + number(shift))


def at_least(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


def safe_divide(x: Column, by: Column, low: float = 1.0) -> Column:
    return x / at_least(by, low)


def is_close(a: Column, b: Column | float) -> Column:
    return F.abs(a - number(b)) <= CLOSE_ABSOLUTE + CLOSE_RELATIVE * F.abs(number(b))


def nearly_equal(a: Column, b: Column | float, tolerance: float = 1e-12) -> Column:
    return F.abs(a - number(b)) <= tolerance


def join_list(x: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), separator)


def mode_metric(mode: Column, drop: Column, uplift: Column) -> Column:
    """The metric that a mode is watched by; an unknown mode is an error."""
    return (
        F.when(mode == "ranking_first", drop)
        .when(mode == "reliability_first", uplift)
        .otherwise(F.raise_error(F.concat(F.lit("unknown mode "), F.coalesce(mode, F.lit("null")))).cast("double"))
    )


def hash_number(*parts: Column | str | int) -> Column:
    """The first 32 bits of the md5 of the parts joined by '|'; any engine with md5 can repeat it."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def six(x: Column) -> Column:
    """Rounded for output; sums differ between engines in the last bits."""
    return F.round(x, 6)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which a null equals a null; without keys ``right`` is one row, for all of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys]
    return left.join(renamed if keys else F.broadcast(right), same or F.lit(True), how).drop(*[f"_of_{k}" for k in keys])
