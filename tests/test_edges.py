"""Cases that tables of the driver don't hold: ends of segments, unknown modes, empty baselines, missing scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairtide.functions import metrics
from pairtide.operators import config, monitor, pairs, policy
from pairtide.sources import tables
from pairtide.streaming import monitor as stream


def test_rule_at_ends_of_segments(spark):
    touching = spark.createDataFrame([(0.0, 0.015, "low"), (0.015, 0.03, "high")], "lambda_start double, lambda_end double, rule string")
    apart = spark.createDataFrame([(0.0, 0.01, "low"), (0.015, 0.03, "high")], touching.schema)
    costs = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.0125, 0.015, 0.03, 0.031)], "cost double")
    for segments in (touching, apart):
        got = policy.rule_at(costs, segments).collect()
        assert {r.cost: r.rule for r in got} == {-0.1: None, 0.0: "low", 0.0125: "low", 0.015: "high", 0.03: "high", 0.031: None} and len(got) == 6


def test_empty_choice_and_one_rule(spark):
    grid = spark.createDataFrame([("d0", 0.01, 0.1)], "domain string, coverage double, delta_auc double")
    with pytest.raises(ValueError, match="enough coverage"):
        policy.utilities(grid, (0.0,), least_coverage=0.5)
    one = config.DOCUMENT.replace(""",
                {"name": "high", "lambda_min": 0.015, "lambda_max": 0.03, "method": "affine", "threshold": 0.3}]""", "]")
    modes = spark.createDataFrame([("d0", "ranking_first", "raw", 0.05)], "domain string, mode string, method string, threshold double")
    got = {r.check_name: r.passed for r in config.validate(config.document(spark, one), modes).collect()}
    assert got["rules_contiguous"] and got["rules_present"] and len(one) < len(config.DOCUMENT)


LOG = "event_id long, domain string, mode string, label int, policy_prob double, referral_flag int"


def test_alerts_of_stream_and_batch_agree(spark):
    rng = np.random.default_rng(3)
    keys = [("d0", "ranking_first"), ("d0", "reliability_first"), ("d1", "another")]
    rows = [(i, *k, int(rng.random() < 0.5), float(rng.random()), 0 if k[0] == "d1" else int(rng.random() < 0.4)) for k in keys for i in range(400)]
    log = spark.createDataFrame(rows, LOG)
    base = {(r.domain, r["mode"]): (r.baseline_auc, r.baseline_ece, r.baseline_coverage) for r in monitor.baselines(log).collect()}
    for caps in ((0.05, 0.05, 0.2), (0.02, 0.01, 0.05)):
        windows = monitor.window_metrics(log, (40,), *caps).collect()
        assert len(windows) == 30
        for w in windows:
            part = [r for r in rows if r[1:3] == (w.domain, w["mode"])][40 * w.window_id :][:40]
            y, p, r = (np.array([x[k] for x in part], float) for k in (3, 4, 5))
            assert stream.alert_of((w.domain, w["mode"]), stream.auroc_of(y, p), stream.ece_of(y, p), float(r.mean()), base, caps) == w.any_alert
        unknown = [w for w in windows if w["mode"] == "another"]
        assert all(w.coverage_drift is None and not w.coverage_alert for w in unknown)  # no coverage in the baseline
        assert any(w.ranking_alert != w.reliability_alert and w.performance_alert for w in unknown)
    at_cap = ("d0", "ranking_first")
    assert not stream.alert_of(at_cap, 0.75, 0.0, 0.4, {at_cap: (0.8, 0.0, 0.4)}, (0.05, 0.05, 0.2))  # 0.8 - 0.75 is a little over 0.05 unrounded
    with pytest.raises(ValueError, match="no baseline for d9"):
        stream.alert_of(("d9", "x"), 0.5, 0.0, 0.1, base, (0.05, 0.05, 0.2))
    with pytest.raises(PySparkException, match="no baseline for d1 another"):
        monitor.window_metrics(log, (40,), base=log.where("domain = 'd0'")).collect()


def test_metrics_leave_out_missing_scores(spark):
    rng = np.random.default_rng(4)
    good = [("g", int(rng.random() < 0.4), float(rng.random())) for _ in range(300)]
    odd = [("g", 1, None), ("g", 0, float("nan")), ("g", None, 0.7), ("g", 1, float("inf")), ("empty", 1, None)]
    df = spark.createDataFrame([*good, *odd], "grp string, label int, p double")
    y, p = np.array([x[1] for x in good]), np.array([x[2] for x in good])
    pos, neg = p[y == 1], p[y == 0]
    auc = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    bins = np.minimum((p * 10).astype(int), 9)
    ece = sum(abs(y[bins == b].sum() - p[bins == b].sum()) for b in range(10)) / len(y)
    got = {r.grp: r for r in metrics.summary(df, ["grp"], "label", "p").collect()}
    assert set(got) == {"g"} and (got["g"].auc, got["g"].ece, got["g"].brier) == pytest.approx((auc, ece, ((p - y) ** 2).mean()))
    assert metrics.ece(df.where("grp = 'g'"), ["grp"], "label", "p").first().ece == pytest.approx(ece)
    assert df.groupBy("grp").agg(metrics.brier(F.col("label"), F.col("p")).alias("b")).where("grp = 'g'").first().b == pytest.approx(((p - y) ** 2).mean())


def test_score_slices_rise_and_are_fine(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(3000), rng.random(500) * 1e-6, rng.normal(size=1000) * 1e4, 2.0 ** np.arange(-40, 40), np.nextafter(2.0 ** np.arange(-40, 40), 0), [0.0, -0.0, 5e-324, 1e308, -1e308]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", metrics.score_slice(F.col("x")).alias("s")).toPandas().sort_values("x")
    assert (np.diff(got.s) >= 0).all()
    share = lambda part: part.s.value_counts().max() / len(part)
    assert share(got[(got.x > 100) & (got.x < 1e5)]) < 0.05 and share(got[(got.x > 0) & (got.x < 1e-6)]) < 0.1
    y = (rng.random(len(x)) < 0.5).astype(int)
    auc = metrics.auroc(spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, x, strict=True)], "grp string, y int, x double"), ["grp"], "y", "x").first().auroc
    pos, neg = x[y == 1], x[y == 0]
    assert auc == pytest.approx((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)


def test_negatives_by_draws(spark):
    rng = np.random.default_rng(6)
    rows = {(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 150), rng.integers(0, 500, 150), strict=True) if a != b}
    positive = spark.createDataFrame(sorted(rows), "source long, target long")
    got = [tuple(r) for r in pairs.negatives(positive).collect()]
    assert len(got) == len(set(got)) == 3 * len(rows) and not set(got) & rows and all(a != b for a, b in got)
    assert {a for a, _ in got} <= {a for a, _ in rows} and {b for _, b in got} <= {b for _, b in rows}
    assert sorted(got) == sorted(tuple(r) for r in pairs.negatives(positive.repartition(5)).collect())
    fewer = [tuple(r) for r in pairs.negatives(positive, 1.0).collect()]
    assert len(fewer) == len(rows) and len(set(fewer) & set(got)) == len(rows)  # the first draws are the same
    numbers = pairs.numbered(positive, "target").collect()
    assert sorted(r.i for r in numbers) == list(range(len({b for _, b in rows})))
    assert pairs.negatives(positive.where("false")).count() == 0


def test_mapping_catalog_and_alignment(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "name string, id int").write.parquet(str(tmp_path / "map"))
    assert {r.name: r.id for r in tables.read_mapping(spark, str(tmp_path / "map"), "name", "id").collect()} == {"a": 1, "b": 2}
    spark.createDataFrame([("a", 1), ("a", 2)], "name string, id int").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(PySparkException, match="several values for a"):
        tables.read_mapping(spark, str(tmp_path / "bad"), "name", "id").collect()
    runs = spark.createDataFrame([("lung", 1, 0.5), ("lung", 2, 0.5), ("kidney", 1, 0.1)], "domain string, seed int, x double")
    runs.write.partitionBy("domain", "seed").parquet(str(tmp_path / "runs"))
    got = {(r.domain, r.seed): (r.n_files, r.n_bytes > 0) for r in tables.run_catalog(spark, str(tmp_path / "runs")).collect()}
    assert set(got) == {("lung", 1), ("lung", 2), ("kidney", 1)} and all(n == 1 and b for n, b in got.values())
    left = spark.createDataFrame([(1, "x"), (2, "y")], "row int, a string")
    right = spark.createDataFrame([(2, "q"), (1, "p")], "row int, b string")
    assert sorted(tuple(r) for r in tables.aligned(left, right, "row").collect()) == [(1, "x", "p"), (2, "y", "q")]
    for other in (right.where("row = 1"), right.unionByName(right), right.unionByName(spark.createDataFrame([(3, "r")], right.schema))):
        with pytest.raises(PySparkException, match="rows don't align"):
            tables.aligned(left, other, "row").collect()
    spark.createDataFrame([(1, 7, 2.0), (1, 8, 0.5)], "cell_id int, gene_id int, value float").write.parquet(str(tmp_path / "matrix"))
    assert tables.read_matrix(spark, str(tmp_path / "matrix")).agg(F.sum("value")).first()[0] == 2.5
    tables.write_delimited(left, str(tmp_path / "csv"), separator=";")
    assert tables.read_delimited(spark, str(tmp_path / "csv"), "a string, row int", separator=";").count() == 2
    assert math.isclose(tables.read_matrix(spark, str(tmp_path / "matrix")).first().value % 0.5, 0)
