"""Hand-computed cases and independent numpy versions of scalar functions, metrics and ranking operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairtide.functions import metrics, scalars
from pairtide.operators import ranking


def brute_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    rows = [(g, int(rng.random() < 0.4), float(round(rng.random(), 2))) for g in "ab" for _ in range(150)]
    rows += [("one", 1, 0.2), ("one", 1, 0.3), ("tied", 0, 0.5), ("tied", 1, 0.5), ("a", 1, None), ("a", 0, float("nan"))]
    return rows, spark.createDataFrame(rows, "g string, y int, p double")


def groups(rows):
    out = {}
    for g, y, p in rows:
        if p is not None and p == p:
            out.setdefault(g, []).append((y, p))
    return {g: tuple(np.array(x) for x in zip(*v, strict=True)) for g, v in out.items()}


def test_auroc(scored):
    rows, df = scored
    got = {r.g: r.auroc for r in metrics.auroc(df, ["g"], "y", "p").collect()}
    for g, (y, p) in groups(rows).items():
        want = brute_auroc(y, p)
        assert got[g] is None if want is None else abs(got[g] - want) < 1e-12
    flipped = {r.g: r.auroc for r in metrics.auroc(df.withColumn("p", -F.col("p")), ["g"], "y", "p").collect()}
    grown = {r.g: r.auroc for r in metrics.auroc(df.withColumn("p", F.exp(F.col("p") * 3) * 100), ["g"], "y", "p").collect()}
    assert all(got[g] is None or (abs(got[g] + flipped[g] - 1) < 1e-12 and abs(got[g] - grown[g]) < 1e-12) for g in got)


def test_average_precision(scored):
    rows, df = scored
    got = {r.g: r.aupr for r in metrics.average_precision(df, ["g"], "y", "p").collect()}
    for g, (y, p) in groups(rows).items():
        total, before = 0.0, 0
        for t in sorted(set(p.tolist()), reverse=True):
            hit = y[p >= t].sum()
            total += (hit - before) / max(y.sum(), 1) * hit / (p >= t).sum()
            before = hit
        assert got[g] is None if y.min() == y.max() else abs(got[g] - total) < 1e-12


def test_bins_at_their_edges(spark):
    p = [i / 10 for i in range(11)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double").select("i", metrics.bin_left(F.col("p")).alias("l"), metrics.bin_right(F.col("p")).alias("r")).orderBy("i").collect()
    assert [r.l for r in got] == [0, 1, 2, 2, 4, 5, 5, 6, 8, 9, 9]
    assert [r.r for r in got] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_reliability_has_empty_bins(scored):
    _, df = scored
    rows = metrics.reliability(df.where("p = p"), ["g"], "y", "p").where("g = 'tied'").collect()
    assert len(rows) == 10 and sum(r.n for r in rows) == 2 and sum(r.acc is None for r in rows) == 9


def test_equal_frequency_bins(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 1, 1, 1, 2, 3, 4, 5, 6, 7)], "g string, x double")
    assert sorted(r.bin for r in ranking.frequency_bins(df, ["g"], "x", 4).collect()) == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2]


def test_islands_gaps_windows(spark):
    runs = spark.createDataFrame([("a", i, r) for i, r in enumerate("rrqqr", 1)], "g string, i int, r string")
    assert [x.island for x in ranking.islands(runs, ["g"], "i", "r").orderBy("i").collect()] == [1, 1, 2, 2, 3]
    spans = spark.createDataFrame([("a", 0.0, 0.0125), ("a", 0.015, 0.03), ("b", 0.0, 0.3), ("b", 0.2, 0.4)], "g string, s double, e double")
    got = {(r.g, r.s): (round(r.gap, 6), round(r.overlap, 6)) for r in ranking.gaps(spans, ["g"], "s", "e").collect()}
    assert got == {("a", 0.0): (0, 0), ("a", 0.015): (0.0025, 0), ("b", 0.0): (0, 0), ("b", 0.2): (0, 0.1)}
    with pytest.raises(Exception, match="ends before"):
        ranking.gaps(spark.createDataFrame([("a", 1.0, 0.0)], "g string, s double, e double"), ["g"], "s", "e").collect()
    cut = ranking.row_windows(spark.range(1050).withColumn("g", F.lit(1)), ["g"], ["id"], 500)
    assert cut.count() == 1000 and cut.select("window_id").distinct().count() == 2


def test_relax_and_best(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 3, 1.0), ("b", 4, 2.0)], "g string, i int, x double")
    got = {(r.g, r.i): r.fallback for r in ranking.relax(df, ["g"], F.col("x") > 3).collect()}
    assert got == {("a", 1): False, ("b", 3): True, ("b", 4): True}
    assert {r.g: r.i for r in ranking.best_rows(df, ["g"], F.desc_nulls_last("x"), "i").collect()} == {"a": 1, "b": 4}


def test_scalars(spark):
    row = spark.createDataFrame([("Ab--C d!", "1, 2,,x", "0.05,0.1 ", -0.0, -2.0)], "s string, l string, n string, z double, m double").select(
        scalars.slug(F.col("s")), scalars.parse_list(F.col("n")), scalars.shift_magnitude(F.col("z"), 0.05), scalars.shift_magnitude(F.col("m"), 0.5), scalars.rule_label(F.lit("raw"), F.lit(0.05)),
        scalars.nan_to_null(F.lit(float("nan"))), scalars.feature_rank(F.lit("pca32_neg_l2")), scalars.strip_suffix(F.lit("a_prob"), "_prob"), scalars.parse_range_list(F.lit("3,1,9,3"), 1, 5),
    ).first()
    assert tuple(row) == ("ab_c_d", [0.05, 0.1], 0.05, -2.5, "raw@0.05", None, 32, "a", [1, 3])
    with pytest.raises(Exception, match="unknown mode"):
        spark.range(1).select(scalars.mode_metric(F.lit("x"), F.lit(1.0), F.lit(2.0))).collect()


def test_correlation_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 9.0, 3.0)], "g string, x double, y double")
    got = {r.g: r for r in metrics.correlations(df, ["g"], "x", "y").collect()}
    assert got["a"].pearson is None and abs(got["b"].spearman - 1) < 1e-12 and got["b"].pearson < 1
