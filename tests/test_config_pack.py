"""Deployment documents of any shape: each check fails where it should; schedules with many segments."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairtide.operators import config, policy


@pytest.fixture
def tables(spark):
    modes = spark.createDataFrame([("d0", "ranking_first", "raw", 0.05), ("d1", "ranking_first", "raw", 0.05), ("d0", "reliability_first", "affine", 0.05)], "domain string, mode string, method string, threshold double")
    tuned = spark.createDataFrame([(250, m, 0.2, 0.05) for m in config.MODES] + [(100, "ranking_first", 0.9, 0.9)], "window_size int, mode string, coverage_cap double, performance_cap double")
    segments = spark.createDataFrame([(0.0, "raw", 0.05), (0.005, "affine", 0.3), (0.0125, "raw", 0.5)], "lambda_start double, method string, threshold double")
    return {"modes": modes, "tuned": tuned, "segments": segments, "replayed": spark.createDataFrame([(True,), (True,)], "exact_match boolean")}


def failed(spark, tables, text, **changed):
    rows = config.validate_pack(config.pack(spark, text), **(tables | changed)).collect()
    assert len(rows) == 24 and len({r.check_name for r in rows}) == 24
    return {r.check_name: r.detail for r in rows if not r.passed}


def edited(change):
    doc = json.loads(config.PACK)
    change(doc)
    return json.dumps(doc)


def test_a_fitting_document_passes(spark, tables):
    assert failed(spark, tables, config.PACK) == {}


def test_values_that_differ_fail_their_own_check(spark, tables):
    def modes(doc):
        doc["policy"]["modes"]["ranking_first"] = {"calibration_method": "affine", "disagreement_threshold": 0.051}
    assert set(failed(spark, tables, edited(modes))) == {"ranking_first_method_match", "ranking_first_threshold_match"}

    def caps(doc):
        doc["monitoring"]["hard_alert_thresholds"] |= {"coverage_rel_drift_abs": 0.21, "reliability_ece_uplift": 0.06}
    assert set(failed(spark, tables, edited(caps))) == {"ranking_first_coverage_cap_match", "reliability_first_coverage_cap_match", "reliability_first_performance_cap_match"}

    def costs(doc):
        part = doc["policy"]["cost_aware_default"]
        part["lambda_boundary"], part["rules"][0]["lambda_max_exclusive"], part["rules"][1]["disagreement_threshold"] = 0.013, 0.012, 0.4
    assert set(failed(spark, tables, edited(costs))) == {"cost_schedule_boundary_match", "config_cost_schedule_contiguous", "cost_schedule_high_rule_match"}


def test_missing_unknown_and_mistyped_keys_fail(spark, tables):
    def gone(doc):
        del doc["policy"]["modes"]["reliability_first"]
        doc["monitoring"]["hard_alert_threshold"] = {}
    found = failed(spark, tables, edited(gone))
    assert set(found) == {"keys_present", "keys_known", "config_has_mode_reliability_first", "reliability_first_method_match", "reliability_first_threshold_match"}
    assert found["keys_known"] == "$.monitoring.hard_alert_threshold" and "$.policy.modes.reliability_first.calibration_method" in found["keys_present"]

    def mistyped(doc):
        doc["monitoring"]["hard_alert_thresholds"]["ranking_auc_drop"] = "small"
        doc["policy"]["cost_aware_default"]["rules"] = doc["policy"]["cost_aware_default"]["rules"][:1]
    found = failed(spark, tables, edited(mistyped))
    assert {"keys_present", "ranking_first_performance_cap_match", "cost_schedule_rules_count", "cost_schedule_high_rule_match"} <= set(found)
    assert len(failed(spark, tables, "not json")) >= 20


def test_tables_that_differ_or_are_empty_fail(spark, tables):
    empty = {k: df.limit(0) for k, df in tables.items()}
    found = set(failed(spark, tables, config.PACK, **empty))
    assert {"dual_mode_rows_for_ranking_first", "tuned_thresholds_window_present", "tuned_row_for_reliability_first", "empirical_schedule_segments", "replay_exact"} <= found
    assert set(failed(spark, tables, config.PACK, replayed=spark.createDataFrame([(True,), (False,)], "exact_match boolean"))) == {"replay_exact"}
    mixed = tables["modes"].unionByName(spark.createDataFrame([("d2", "ranking_first", "affine", 0.05)], tables["modes"].schema))
    assert set(failed(spark, tables, config.PACK, modes=mixed)) == {"ranking_first_method_match"}
    compared = config.compare_modes(config.pack(spark), mixed).where("not method_match").collect()
    assert [(r.domain, r.config_method, r.table_method) for r in compared] == [("d2", "raw", "affine")]


def test_documents_from_files(spark, tmp_path, tables):
    (tmp_path / "pack.json").write_text(config.PACK)
    assert config.validate_pack(config.read_pack(spark, str(tmp_path / "pack.json")), **tables).where("not passed").count() == 0


def test_a_hundred_thousand_segments(spark):
    """Segments of very different lengths, keyed by domain and version, one of them null; every cost finds its segment."""
    n = 50_000
    start = lambda i: i * (i + 1) / 2 * 1e-9
    segments = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit(None).cast("string"))).alias("domain"), F.lit(1).alias("version"), start(F.col("id").cast("double")).alias("lambda_start"), start(F.col("id").cast("double")).alias("lambda_end"), F.col("id").cast("string").alias("rule"))
    costs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a").alias("domain"), F.lit(1).alias("version"), (F.col("id") * 6.3e-5 - 0.001).alias("cost"))
    got = policy.rule_at(costs, segments, ["domain", "version"])
    assert got.count() == 20_000
    i = F.floor((F.sqrt(1 + 8 * F.col("cost") * 1e9) - 1) / 2)
    last = start(n - 1)
    want = F.when((F.col("cost") >= 0) & (F.col("cost") <= last), i.cast("string"))
    off = got.where(~F.col("rule").eqNullSafe(want)).collect()
    assert all(abs(int(r.rule) - i_) <= 1 for r in off for i_ in [int(((1 + 8 * r.cost * 1e9) ** 0.5 - 1) / 2)]) and len(off) < 20  # the closed form rounds at the ends
    assert policy.rule_at(costs.limit(0), segments, ["domain", "version"]).count() == 0
    assert policy.rule_at(costs, segments.limit(0), ["domain", "version"]).where("rule is not null").count() == 0
