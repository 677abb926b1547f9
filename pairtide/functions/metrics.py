"""Ranking and calibration metrics per group, as joins and aggregations.

Each function takes a DataFrame, the group columns, the 0/1 label and the score,
and returns one row per group.  Scores are first reduced to one row per distinct
value, and running totals are formed in two steps, over slices of the score range and inside
each slice, so a large group is not handled by one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import finite, joined

#: Slices of the score range for each power of two.
SLICES = 32
#: Inner bin edges exactly as ``numpy.linspace`` gives them; 0.3, 0.6 and 0.7 are not the nearest doubles of their decimals.
EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)]


def score_slice(x: Column) -> Column:
    """A number that rises with x: SLICES for each power of two, so scores near zero and large ones are cut as finely as others.

    The logarithm may be off by one at a power of two; the mantissa makes up for it."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    at = power * SLICES + F.floor((size / F.pow(F.lit(2.0), power) - 1) * SLICES) + 1100 * SLICES
    return F.when(x == 0, 0).when(x > 0, at).otherwise(-at).cast("int")


def _counted(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that metrics count: with a label and a finite score."""
    return df.where(finite(F.col(score)) & F.col(label).isNotNull())


def _by_score(df: DataFrame, groups: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """(groups, score, pos, neg, pos_below, neg_below): one row per distinct score with the totals of smaller ones; ``weight``: how often a row counts."""
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    points = _counted(df, label, score).groupBy(*groups, F.col(score).alias("_x")).agg(F.sum(y * w).alias("pos"), F.sum((1.0 - y) * w).alias("neg"))
    whole = Window.partitionBy(*groups)
    points = points.withColumn("_s", score_slice(F.col("_x")))
    slices = points.groupBy(*groups, "_s").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*groups, "_s", F.coalesce(F.sum("_pos").over(before), F.lit(0.0)).alias("_pos_before"), F.coalesce(F.sum("_neg").over(before), F.lit(0.0)).alias("_neg_before"))
    inside = Window.partitionBy(*groups, "_s").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    return joined(points, slices, [*groups, "_s"]).select(
        *groups,
        F.col("_x").alias("score"),
        "pos",
        "neg",
        (F.col("_pos_before") + F.coalesce(F.sum("pos").over(inside), F.lit(0.0))).alias("pos_below"),
        (F.col("_neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0))).alias("neg_below"),
    )


def auroc(df: DataFrame, groups: list[str], label: str, score: str, name: str = "auroc", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting a half; NULL for a group with one class."""
    points = _by_score(df, groups, label, score, weight)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return points.groupBy(*groups).agg((won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias(name))


def average_precision(df: DataFrame, groups: list[str], label: str, score: str, name: str = "aupr") -> DataFrame:
    """Sum of precision times the gain in recall over distinct thresholds; NULL without positives or negatives."""
    points = _by_score(df, groups, label, score)
    total = points.groupBy(*groups).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    points = points.join(total, groups) if groups else points.crossJoin(F.broadcast(total))
    tp, fp = F.col("_p") - F.col("pos_below"), F.col("_n") - F.col("neg_below")
    return points.groupBy(*groups).agg(
        F.when((F.max("_p") > 0) & (F.max("_n") > 0), F.sum(F.col("pos") / F.col("_p") * tp / (tp + fp))).alias(name)
    )


def bin_left(p: Column) -> Column:
    """Bins closed on the left: how many inner edges are at or below p."""
    return sum((F.when(p >= F.lit(e), 1).otherwise(0) for e in EDGES[1:-1]), F.lit(0))


def bin_right(p: Column) -> Column:
    """Bins closed on the right: how many edges are below p, less one, from 0 to 9."""
    below = sum((F.when(p > F.lit(e), 1).otherwise(0) for e in EDGES), F.lit(0))
    return F.least(F.greatest(below - 1, F.lit(0)), F.lit(9))


def _bins(df: DataFrame, groups: list[str], label: str, score: str, closed: str) -> DataFrame:
    b = {"left": bin_left, "right": bin_right}[closed](F.col(score))
    return _counted(df, label, score).groupBy(*groups, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("acc"), F.avg(score).alias("conf")
    )


def ece(df: DataFrame, groups: list[str], label: str, score: str, name: str = "ece", closed: str = "left") -> DataFrame:
    """Expected calibration error over ten bins."""
    rows = _bins(df, groups, label, score, closed)
    gap = F.col("n") * F.abs(F.col("acc") - F.col("conf"))
    return rows.groupBy(*groups).agg((F.sum(gap) / F.sum("n")).alias(name))


def reliability(df: DataFrame, groups: list[str], label: str, score: str, closed: str = "left") -> DataFrame:
    """One row per group and bin, empty bins too (n = 0, NULL means)."""
    grid = df.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return grid.join(_bins(df, groups, label, score, closed), [*groups, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def brier(label: Column, score: Column) -> Column:
    """The mean squared error over rows with a label and a finite score, as an aggregate."""
    return F.avg(F.when(finite(score), (score - label.cast("double")) * (score - label.cast("double"))))


def average_ranks(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """``df`` with ranks from 1, ties at their mean."""
    points = _by_score(df.withColumn("_one", F.lit(1)), groups, "_one", column)
    ranks = points.select(*groups, F.col("score").alias(column), (F.col("pos_below") + (F.col("pos") + 1) / 2).alias(name))
    return df.join(ranks, [*groups, column])


def correlations(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """n, Pearson and Spearman correlation; NULL with fewer than three rows or without spread."""
    ranked = average_ranks(average_ranks(df, groups, x, "_rx"), groups, y, "_ry")

    def corr(a: str, b: str) -> Column:
        enough = (F.count("*") >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
        return F.when(enough, F.corr(a, b))

    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"))


def summary(df: DataFrame, groups: list[str], label: str, score: str, prefix: str = "", weight: str | None = None) -> DataFrame:
    """auc, ece and brier of each group, all from the counts by distinct score; a group without a finite score has no row."""
    points = _by_score(df, groups, label, score, weight)
    x, n = F.col("score"), F.col("pos") + F.col("neg")
    bins = points.groupBy(*groups, bin_left(x).alias("_b")).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(x * n).alias("_x"),
        F.sum(F.col("pos") * (x - 1) * (x - 1) + F.col("neg") * x * x).alias("_q"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("_won"),
    )
    total = F.sum(F.col("_p") + F.col("_n"))
    return bins.groupBy(*groups).agg(
        (F.sum("_q") / total).alias(f"{prefix}brier"), (F.sum("_won") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0.0))).alias(f"{prefix}auc"),
        (F.sum(F.abs(F.col("_p") - F.col("_x"))) / total).alias(f"{prefix}ece"),
    )


def estimable(label: Column, least: int = 8, least_class: int = 2) -> Column:
    """Whether a group has enough rows of both classes, as an aggregate."""
    pos = F.sum(label)
    return (F.count("*") >= least) & (pos >= least_class) & (F.count("*") - pos >= least_class)


def right_tail(null: Column, true: Column) -> Column:
    """The share of null values at or above the true one, as an aggregate; nothing is added to the counts."""
    return F.avg((null >= true).cast("double"))


#: Parts of a score slice that :func:`quantiles` narrows down to before it orders values.
PARTS = 4096


def quantiles(df: DataFrame, groups: list[str], column: str, points: list[float]) -> DataFrame:
    """(groups, n, quantiles): interpolated quantiles of each group's finite values, exact; a group without one has no row.

    Values are counted, the counts by slice and by part of a slice show where the wanted ranks are, and only the values of those parts are put in order."""
    x = F.col(f"`{column}`").cast("double")
    counts = df.where(finite(x)).groupBy(*groups, (x + 0.0).alias("_x")).agg(F.count("*").alias("_c"))
    size = F.abs("_x")
    place = size / F.pow(F.lit(2.0), F.floor(F.log2(size))) * (SLICES * PARTS)
    counts = counts.withColumn("_s", score_slice(F.col("_x"))).withColumn("_f", F.when(F.col("_x") == 0, 0).otherwise(F.floor(F.when(F.col("_x") > 0, place).otherwise(-place))).cast("long"))

    def narrowed(level: DataFrame, within: list[str], order: str) -> DataFrame:
        """Rows of ``level`` in which wanted ranks lie, with those ranks and the rows before them."""
        along = Window.partitionBy(*groups, *within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_c").over(along), F.lit(0))).drop("_base")
        here = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))
        return level.withColumn("_ranks", F.filter("_ranks", here)).where(F.size("_ranks") > 0).drop("_c")

    total = counts.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    at = F.array(*[F.lit(float(q)) for q in points])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda q: F.array(F.floor(q * (F.col("_n") - 1)), F.ceil(q * (F.col("_n") - 1))))))
    wanted = total.select(*groups, "_n", ranks.alias("_ranks"), F.lit(0).cast("long").alias("_base"))
    slices = joined(counts.groupBy(*groups, "_s").agg(F.sum("_c").alias("_c")), wanted, groups)
    slices = narrowed(slices, [], "_s").withColumnRenamed("_before", "_base")
    parts = joined(counts.groupBy(*groups, "_s", "_f").agg(F.sum("_c").alias("_c")), slices, [*groups, "_s"])
    parts = narrowed(parts, ["_s"], "_f").withColumnRenamed("_before", "_base").drop("_n")
    values = narrowed(joined(counts, parts, [*groups, "_s", "_f"]), ["_s", "_f"], "_x")
    found = values.select(*groups, "_x", F.explode("_ranks").alias("_r")).groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_v"))

    def between(q):
        h = q * (F.col("_n") - 1)
        low, high = F.element_at("_v", F.floor(h)), F.element_at("_v", F.ceil(h))
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return joined(total, found, groups).select(*groups, F.col("_n").alias("n"), F.transform(at, between).alias("quantiles"))


def window_summary(df: DataFrame, groups: list[str], label: str, score: str, *more: Column, prefix: str = "") -> DataFrame:
    """n, auc, ece and brier of groups that are known to be small, such as windows of rows, and ``more`` aggregates; one shuffle by group.

    Groups without a finite score keep their row with NULLs."""
    p, y = F.col("_p"), F.col("_y")
    counted = finite(F.col(score)) & F.col(label).isNotNull()
    rows = df.withColumn("_p", F.when(counted, F.col(score).cast("double"))).withColumn("_y", F.when(counted, F.col(label).cast("double")))
    own = Window.partitionBy(*groups)
    rows = rows.withColumn("_up", F.count("_p").over(own.orderBy("_p"))).withColumn("_tied", F.count("_p").over(Window.partitionBy(*groups, "_p")))
    rank = F.col("_up") - (F.col("_tied") - 1) / 2
    bins = F.array(*[F.abs(F.sum(F.when(bin_left(p) == b, y - p).otherwise(0.0))) for b in range(10)])
    pos, neg = F.sum(y), F.sum(1 - y)
    out = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), *more, ((F.sum(y * rank) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))).alias(f"{prefix}auc"),
        (F.aggregate(bins, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.count("_p"), F.lit(0))).alias(f"{prefix}ece"), F.avg((p - y) * (p - y)).alias(f"{prefix}brier"),
    )
    return out
