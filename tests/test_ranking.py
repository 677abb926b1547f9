"""Exact quantiles, numbering in slices, windows of several sizes and global tops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairtide.functions import metrics
from pairtide.operators import ranking


def test_quantiles_equal_percentiles(spark):
    """Ties, one value, negative and tiny values, missing ones, a null group; values that share a slice."""
    rng = np.random.default_rng(9)
    data = {"ties": rng.integers(0, 5, 200) / 5, "one": np.array([0.25]), "close": 0.5 + rng.random(300) * 1e-9, "wide": rng.normal(size=151) * 10.0 ** rng.integers(-12, 12, 151), None: rng.random(64)}
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("ties", None), ("ties", float("nan")), ("none", None), ("wide", 0.0), ("wide", -0.0)]
    data["wide"] = np.append(data["wide"], [0.0, 0.0])
    points = [0.0, 0.025, 0.1, 1 / 3, 0.5, 0.7, 0.95, 1.0]
    got = {r.g: r for r in metrics.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", points).collect()}
    assert got.keys() == data.keys()
    for g, x in data.items():
        assert got[g].n == len(x) and np.allclose(got[g].quantiles, np.quantile(x, points), rtol=1e-12, atol=0)
    alone = metrics.quantiles(spark.createDataFrame(rows, "g string, x double"), [], "x", [0.5]).first()
    assert alone.quantiles[0] == pytest.approx(np.median(np.concatenate(list(data.values()))))
    exact = spark.createDataFrame(rows, "g string, x double").where("x is not null and not isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, points))).alias("q")).collect()
    assert all(np.allclose(got[r.g].quantiles, r.q, rtol=1e-12, atol=0) for r in exact)


def test_windows_of_all_sizes_from_one_numbering(spark):
    rng = np.random.default_rng(10)
    keys = [float(k) for k in rng.permutation(230)]
    df = spark.createDataFrame([(g, k) for g in ("a", None) for k in keys], "g string, k double").repartition(4)
    got = ranking.row_windows(df, ["g"], ["k"], 50, 100).collect()
    assert {(r.g, r.k, r.window_size, r.window_id) for r in got} == {(g, k, s, int(k) // s) for g in ("a", None) for k in keys for s in (50, 100) if k < 230 // s * s}


def test_metrics_of_small_groups_equal_the_general_ones(spark):
    rng = np.random.default_rng(12)
    rows = [(g, int(rng.random() < 0.4), float(v)) for g in ("a", "b") for v in rng.integers(0, 12, 80) / 12] + [("one", 1, 0.3), ("a", None, 0.5), ("a", 1, float("nan")), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    want = {r.g: r for r in metrics.summary(df, ["g"], "y", "p").collect()}
    got = {r.g: r for r in metrics.window_summary(df, ["g"], "y", "p").collect()}
    assert got.keys() == {"a", "b", "one", "none"} and got["a"].n == 82 and got["none"].ece is None
    for g, r in want.items():
        for m in ("auc", "ece", "brier"):
            assert got[g][m] == (None if r[m] is None else pytest.approx(r[m]))


def test_global_top_takes_each_key_once(spark):
    df = spark.createDataFrame([(s, d, float((s * 7 + d * 3) % 11)) for s in range(6) for d in range(3)], "s int, d int, v double")
    got = ranking.global_top(df, "s", F.desc("v"), "s", "d", k=4).collect()
    best = sorted((max((r.v, -r.d) for r in df.where(f"s = {s}").collect()) + (s,) for s in range(6)), key=lambda t: (-t[0], t[2]))
    assert [(r.s, r.v) for r in got] == [(s, v) for v, _, s in best[:4]]
