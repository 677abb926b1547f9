"""First, best and top rows of groups, equal-frequency bins, islands and fixed-size windows of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import metrics
from ..functions.scalars import joined


def best_rows(df: DataFrame, groups: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each group; ``order`` should end in a unique key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def relax(df: DataFrame, groups: list[str], ok: Column) -> DataFrame:
    """Rows that satisfy ``ok``; all rows of a group in which none does, flagged by ``fallback``."""
    any_ok = F.max(F.coalesce(ok, F.lit(False)).cast("int")).over(Window.partitionBy(*groups))
    return df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_any", any_ok).where(F.col("_ok") | (F.col("_any") == 0)).withColumn("fallback", F.col("_any") == 0).drop("_ok", "_any")


def frequency_bins(df: DataFrame, groups: list[str], column: str, bins: int, name: str = "bin") -> DataFrame:
    """Equal-frequency bins between interpolated quantiles; equal values share a bin and repeated edges count once.  Groups without a finite value have no row."""
    edges = metrics.quantiles(df, groups, column, [i / bins for i in range(bins + 1)]).select(*groups, F.array_distinct("quantiles").alias("_edges"))
    out = joined(df, edges, groups) if groups else df.crossJoin(F.broadcast(edges))
    below = F.size(F.filter("_edges", lambda e: e < F.col(column)))
    return out.withColumn(name, F.greatest(below - 1, F.lit(0))).drop("_edges")


def islands(df: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    """``df`` with the number, from 1, of each unbroken run of equal values along ``order``."""
    along = Window.partitionBy(*groups).orderBy(order)
    changed = F.when(F.lag(value).over(along).eqNullSafe(F.col(value)) & (F.row_number().over(along) > 1), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("island", F.sum("_c").over(along)).drop("_c")


def gaps(df: DataFrame, groups: list[str], start: str, end: str, tolerance: float = 1e-12) -> DataFrame:
    """Each interval with its gap to and overlap with the one before it; an interval that ends before it starts is an error."""
    before = F.lag(end).over(Window.partitionBy(*groups).orderBy(start, end))
    step = F.col(start) - before
    checked = F.when(F.col(end) < F.col(start), F.raise_error(F.lit("an interval ends before it starts")).cast("double")).otherwise(F.col(end))
    return df.withColumn(end, checked).withColumn("gap", F.when(step > tolerance, step).otherwise(0.0)).withColumn("overlap", F.when(-step > tolerance, -step).otherwise(0.0))


def numbered(df: DataFrame, groups: list[str], part: Column, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with each row's number, from 0, in its group by ``part`` and ``order``, and the group's rows as ``total``.

    Rows are numbered inside slices (groups, part) and moved up by what the slices before hold, so a large group is not one task."""
    df = df.withColumn("_s", part)
    along = Window.partitionBy(*groups).orderBy("_s")
    sizes = df.groupBy(*groups, "_s").agg(F.count("*").alias("_c"))
    sizes = sizes.select(*groups, "_s", F.coalesce(F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), *([F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)] if total else []))
    rows = df.withColumn(name, F.row_number().over(Window.partitionBy(*groups, "_s").orderBy(*order)) - 1)
    return joined(rows, sizes, [*groups, "_s"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_s")


def slice_of(df: DataFrame, column: str) -> Column:
    """Slices along a column for :func:`numbered`; columns that are no numbers are one slice."""
    return metrics.score_slice(F.col(column).cast("double")) if isinstance(df.schema[column].dataType, NumericType) else F.lit(0)


def row_windows(df: DataFrame, groups: list[str], order: list[str], *sizes: int) -> DataFrame:
    """Windows of each size of rows in order: window_size and window_id from 0; the incomplete last one is dropped.  Rows are numbered once for all sizes."""
    rows = numbered(df, groups, slice_of(df, order[0]), [F.col(c) for c in order], "_n", "_t")
    each = F.array(*[F.when(F.col("_n") < F.floor(F.col("_t") / size) * size, F.struct(F.lit(size).alias("window_size"), F.floor(F.col("_n") / size).cast("int").alias("window_id"))) for size in sizes])
    return rows.withColumn("_w", F.explode(F.filter(each, lambda w: w.isNotNull()))).select("*", "_w.*").drop("_n", "_t", "_w")


def global_top(df: DataFrame, key: str, *order: Column, k: int) -> DataFrame:
    """The k first keys over all groups, each with its best row; ``order`` should end in a unique column.  Keeps k rows a task."""
    return best_rows(df, [key], *order).orderBy(*order).limit(k)
