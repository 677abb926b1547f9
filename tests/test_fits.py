"""Logistic and isotonic fits: missing values, clashing names, many fits of one design, slices against whole fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairtide.operators import models, resample


def logistic(x, y, scale=True):
    """The optimum by plain Newton steps on one table: a function of features."""
    mean, sd = (x.mean(0), x.std(0)) if scale else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    sd = np.where(sd > 1e-12, sd, 1.0)
    z, beta = np.column_stack([(x - mean) / sd, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    w, penalty = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))), np.append(np.ones(x.shape[1]), 0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-(z @ beta)))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12), z.T @ (w * (p - y)) + penalty * beta)
    return lambda at: 1 / (1 + np.exp(-(((at - mean) / sd) @ beta[:-1] + beta[-1])))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    n = 240
    x = rng.normal(size=(n, 2)) * [1, 1e-3] + [0, 1e4]  # a mean far above the spread
    y = (x[:, 0] + rng.normal(size=n) > 0.3).astype(int)
    return [(("a", None)[i % 2], i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]


SCHEMA = "model string, rep long, y int, fold double, held double"


def test_every_fit_of_a_design_is_at_its_optimum(spark, table):
    """Groups, keys, labels and features with the names that the fits use inside; a null group; all five fits of a design."""
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = {r.rep: r for r in models.cross_predict(df, ["model"], "rep", "y", {"one": ["fold"], "two": ["fold", "held"]}).collect()}
    assert len(got) == len(table) and {r.model for r in got.values()} == {"a", None}
    inner = df.select(F.col("model").alias("g"), F.col("rep").alias("k"), "y", F.col("fold").alias("a"), F.col("held").alias("b"))
    rows = resample.stratified_folds(inner, ["g"], "k", "y", 5).toPandas()
    for name, columns in (("one", ["a"]), ("two", ["a", "b"])):
        for g in ("a", None):
            own = rows[rows.g.isna() if g is None else rows.g == g]
            for fold in range(5):
                train, test = own[own.fold != fold], own[own.fold == fold]
                want = logistic(train[columns].to_numpy(float), train.y.to_numpy(float))(test[columns].to_numpy(float))
                assert np.allclose([got[k][name] for k in test.k], want, atol=1e-6)


def test_missing_values_touch_their_own_rows_only(spark, table):
    holes = [("a", 1000, 1, float("nan"), 1e4), ("a", 1001, 0, None, 1e4), (None, 1002, 1, float("inf"), 1e4)]
    unlabelled = [("a", 1003, None, 0.1, 1e4), (None, 1004, None, 0.1, 1e4)]
    clean = spark.createDataFrame(table, SCHEMA)
    want = {r.rep: r.one for r in models.cross_predict(clean, ["model"], "rep", "y", {"one": ["fold"]}).collect()}
    more = spark.createDataFrame(table + unlabelled, SCHEMA)
    got = {r.rep: r.one for r in models.cross_predict(more, ["model"], "rep", "y", {"one": ["fold"]}).collect()}
    assert got.pop(1003) is None and got.pop(1004) is None
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    got = {r.rep: r.one for r in models.cross_predict(clean.unionByName(spark.createDataFrame(holes, SCHEMA)), ["model"], "rep", "y", {"one": ["fold"]}).collect()}
    assert [k for k, p in got.items() if p is None] == [1000, 1001, 1002] or sorted(k for k, p in got.items() if p is None) == [1000, 1001, 1002]
    for method in ("platt", "isotonic"):
        rows = {r.rep: r.calibrated for r in models.calibrate(clean.unionByName(spark.createDataFrame(holes + unlabelled, SCHEMA)), ["model"], "rep", "y", "fold", method).collect()}
        assert sorted(k for k, p in rows.items() if p is None) == [1000, 1001, 1002, 1003, 1004] and len(rows) == len(table) + 5


def test_a_fit_joins_its_rows_by_shuffle_too(spark, table, monkeypatch):
    df = spark.createDataFrame(table, SCHEMA)
    want = {r.rep: r.one for r in models.cross_predict(df, ["model"], "rep", "y", {"one": ["fold"]}).collect()}
    monkeypatch.setattr(models, "SENT_BYTES", 0)
    monkeypatch.setattr(models, "BLOCK", 7)
    monkeypatch.setattr(models, "OPEN", 20)
    got = {r.rep: r.one for r in models.cross_predict(df, ["model"], "rep", "y", {"one": ["fold"]}).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_bounds_of_a_design(spark):
    with pytest.raises(ValueError, match="fits"):
        models.fit_designs(spark.createDataFrame([("a", 1.0, [1.0], 1)], "design string, y double, x array<double>, bits long"), 1, 63)


def isotonic_by_hand(x, y):
    """The max-min formula over the distinct scores."""
    xs = np.unique(x)
    n, pos = np.array([(x == v).sum() for v in xs], float), np.array([y[x == v].sum() for v in xs], float)
    cn, cp = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(pos))
    value = [max(min((cp[b] - cp[a]) / (cn[b] - cn[a]) for b in range(i + 1, len(xs) + 1)) for a in range(i + 1)) for i in range(len(xs))]
    return xs, np.array(value)


@pytest.mark.parametrize("size", [1 << 16, 3])
def test_slices_give_the_isotonic_fit_of_all_rows(spark, monkeypatch, size):
    """Ties, one class, falling and rising scores; slices of three points, merged four at a time."""
    monkeypatch.setattr(models, "SLICE", size)
    monkeypatch.setattr(models, "FAN_BITS", 1)
    rng = np.random.default_rng(3)
    data = {"noisy": rng.integers(0, 25, 120) / 25, "distinct": rng.random(90), "falling": np.arange(60) / 60, "rising": np.arange(60) / 60, "one": rng.random(30), "tied": np.full(20, 0.5)}
    labels = {"noisy": lambda x: rng.random(len(x)) < x, "distinct": lambda x: rng.random(len(x)) < x, "falling": lambda x: x < 0.5, "rising": lambda x: x >= 0.5, "one": lambda x: x >= 0, "tied": lambda x: np.arange(len(x)) % 4 == 0}
    rows, want = [], {}
    for design, x in data.items():
        y, fold = labels[design](x).astype(int), rng.integers(0, 3, len(x))
        fold[: len(x) // 10] = 3  # rows of no fold are fitted on themselves
        rows += [(design, int(f), float(v), int(t)) for f, v, t in zip(fold, x, y, strict=True)]
        for f in range(4):
            train = fold == 3 if f == 3 else (fold != f) & (fold != 3)
            model = isotonic_by_hand(x[train], y[train])
            want |= {(design, f, float(v)): float(np.interp(v, *model)) for v in x[fold == f]}
    df = spark.createDataFrame(rows, "design string, fold int, x double, y int").repartition(5)
    got = {(r.design, r.fit, r.x): r.calibrated for r in models.isotonic_points(df, 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_pooling_pooled_stacks_is_pooling_points():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        x, y, w = np.arange(n, dtype=float), rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n).astype(float)
        whole, cut = models.pooled(y * w, w, x, x), int(rng.integers(0, n + 1))
        parts = [models.pooled(y[s] * w[s], w[s], x[s], x[s]) for s in (slice(0, cut), slice(cut, n)) if len(y[s])]
        merged = models.pooled(*[np.concatenate(c) for c in zip(*parts, strict=True)])
        assert all(np.allclose(a, b) for a, b in zip(whole, merged, strict=True)) and (np.diff(whole[0] / whole[1]) > 0).all()
    late = np.append(np.arange(1000.0), 0.0)  # one low value at the end pools from the right, step by step
    assert len(models.pooled(late, np.append(np.ones(1000), 1e9), np.arange(1001.0), np.arange(1001.0))[0]) < 5


def test_a_million_rows_of_one_group(spark):
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("all").alias("design"), (F.col("id") % 4).cast("int").alias("fold"), F.rand(1).alias("x")).withColumn("y", (F.rand(2) < F.col("x")).cast("int"))
    out = models.isotonic_points(df, 4)
    r = out.agg(F.count("*").alias("n"), F.max(F.abs(F.col("calibrated") - F.col("x"))).alias("off")).first()
    assert r.n == 1_000_000 and r.off < 0.06


def test_scores_are_calibrated_together_from_one_deal_of_folds(spark, table, monkeypatch):
    """Every score and method dealt the same folds anew: four times here."""
    df, dealt = spark.createDataFrame(table, SCHEMA), []
    want = {(m, s): {r.rep: r.calibrated for r in models.calibrate(df, ["model"], "rep", "y", s, m).collect()} for m in ("platt", "isotonic") for s in ("fold", "held")}
    deal = models.stratified_folds
    monkeypatch.setattr(models, "stratified_folds", lambda *a, **k: dealt.append(1) or deal(*a, **k))
    rows = models.calibrations(df, ["model"], "rep", "y", ["fold", "held"], ["raw", "platt", "isotonic"]).collect()
    assert len(rows) == len(table) and len(dealt) == 1
    assert all(r.raw_fold == r.fold and r.raw_held == r.held for r in rows)
    assert all(r[f"{m}_{s}"] == pytest.approx(p[r.rep], abs=1e-9) for (m, s), p in want.items() for r in rows)


def test_layer_sweep_fits_the_baseline_once_a_source_group(spark, monkeypatch):
    """Each run had its own folds and fits of the same baseline: 2 designs a run and source group."""
    import duckdb

    from pairtide import catalog

    sf, designs, fit = "/root/testdata/sf0.001", [], models.fit_designs
    monkeypatch.setattr(models, "fit_designs", lambda rows, *a: designs.append(rows.select("design").distinct().count()) or fit(rows, *a))
    got = catalog.QUERIES["layer_sweep"](spark, sf)
    names, got = got.columns, sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    want = con.sql(catalog.ORACLE_SQL["layer_sweep"])
    want = sorted(want.select(*names).fetchall()) if want.columns != names else sorted(want.fetchall())
    assert len(got) == len(want) and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(got, want, strict=True))
    groups = len({r[names.index("source_group")] for r in got})
    filled = len({r[names.index("source_group")] for r in got if r[names.index("second_gain")] is not None})
    assert groups and sum(designs) == groups * (9 + 1) + filled


def test_folds_dealt_before(spark):
    rows = [("g", i, i % 3 // 2, float(i * 7 % 11), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, k long, y int, u double, v double")
    dealt = resample.stratified_folds(df, ["g"], "k", "y", 3)
    ask = lambda d, **more: sorted(map(tuple, models.cross_predict(d, ["g"], "k", "y", {"a": ["u"], "b": ["u", "v"]}, 3, **more).collect()))
    assert all(a == pytest.approx(b) for a, b in zip(ask(dealt, fold="fold"), ask(df), strict=True))
    with pytest.raises(ValueError):
        ask(dealt, fold="fold", repeats=2)
