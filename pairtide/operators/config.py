"""A policy document and its checks against the tables it was derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_close

SCHEMA = (
    "version string, created string, default_mode string, "
    "modes struct<ranking_first: struct<method: string, threshold: double>, reliability_first: struct<method: string, threshold: double>>, "
    "cost_rules array<struct<name: string, lambda_min: double, lambda_max: double, method: string, threshold: double>>, "
    "monitoring struct<window_size: int, coverage_cap: double, auc_drop_cap: double, ece_uplift_cap: double, hard_consecutive: int, soft_alerts: int, soft_windows: int>"
)
DOCUMENT = """{"version": "1", "created": "2026-01-01", "default_mode": "ranking_first",
 "modes": {"ranking_first": {"method": "raw", "threshold": 0.05}, "reliability_first": {"method": "affine", "threshold": 0.05}},
 "cost_rules": [{"name": "low", "lambda_min": 0.0, "lambda_max": 0.015, "method": "raw", "threshold": 0.05},
                {"name": "high", "lambda_min": 0.015, "lambda_max": 0.03, "method": "affine", "threshold": 0.3}],
 "monitoring": {"window_size": 250, "coverage_cap": 0.2, "auc_drop_cap": 0.05, "ece_uplift_cap": 0.05,
                "hard_consecutive": 2, "soft_alerts": 3, "soft_windows": 5}}"""


def document(spark: SparkSession, text: str = DOCUMENT) -> DataFrame:
    """The document as one row of nested columns."""
    return spark.range(1).select(F.from_json(F.lit(text), SCHEMA).alias("policy")).select("policy.*")


def validate(doc: DataFrame, modes: DataFrame) -> DataFrame:
    """(check_name, passed, detail) rows: structure of the document, and its modes against the table of modes."""
    rules, watch = F.col("cost_rules"), F.col("monitoring")
    inside: dict[str, tuple[Column, Column]] = {
        "has_version": (F.col("version").isNotNull(), F.col("version")),
        "default_mode_known": (F.col("default_mode").isin("ranking_first", "reliability_first"), F.col("default_mode")),
        "rules_present": (F.size(rules) >= 1, F.size(rules).cast("string")),
        "rules_ordered": (F.forall(rules, lambda r: r["lambda_min"] < r["lambda_max"]), F.size(rules).cast("string")),
        "rules_contiguous": (F.forall(F.when(F.size(rules) > 1, F.sequence(F.lit(1), F.size(rules) - 1)).otherwise(F.array().cast("array<int>")), lambda i: is_close(F.element_at(rules, i)["lambda_max"], F.element_at(rules, i + 1)["lambda_min"])), F.size(rules).cast("string")),
        "rules_start_at_zero": (is_close(F.element_at(rules, 1)["lambda_min"], 0.0), F.lit("0")),
        "window_positive": (watch["window_size"] > 0, watch["window_size"].cast("string")),
        "caps_positive": ((watch["coverage_cap"] > 0) & (watch["auc_drop_cap"] > 0) & (watch["ece_uplift_cap"] > 0), F.lit("3")),
        "soft_within_windows": (watch["soft_alerts"] <= watch["soft_windows"], watch["soft_alerts"].cast("string")),
        "hard_consecutive": (F.coalesce(watch["hard_consecutive"], F.lit(2)) >= 2, watch["hard_consecutive"].cast("string")),
    }
    rows = doc.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(p, F.lit(False)).alias("passed"), d.alias("detail")) for n, (p, d) in inside.items()])).alias("r")).select("r.*")
    wanted = doc.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"modes.{m}.method").alias("want"), F.col(f"modes.{m}.threshold").alias("want_threshold")) for m in ("ranking_first", "reliability_first")])).alias("w")).select("w.*")
    agreeing = modes.join(F.broadcast(wanted), "mode").groupBy("mode").agg(
        F.bool_and(is_close(F.col("threshold"), F.col("want_threshold"))).alias("threshold_ok"), F.sum((F.col("method") == F.col("want")).cast("long")).alias("agree"), F.count("*").alias("n")
    )
    threshold = agreeing.select(F.concat("mode", F.lit("_threshold")).alias("check_name"), F.col("threshold_ok").alias("passed"), F.col("n").cast("string").alias("detail"))
    method = agreeing.select(F.concat("mode", F.lit("_method")).alias("check_name"), (F.col("agree") == F.col("n")).alias("passed"), F.concat_ws("/", F.col("agree").cast("string"), F.col("n").cast("string")).alias("detail"))
    return rows.unionByName(threshold).unionByName(method)


def validation_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("all_passed"))


#: A deployment document: policies by mode, alert thresholds, and rules by cost.
PACK = """{"config_id": "pack-1", "created": "2026-01-01",
 "policy": {"modes": {"ranking_first": {"calibration_method": "raw", "disagreement_threshold": 0.05},
                      "reliability_first": {"calibration_method": "affine", "disagreement_threshold": 0.05}},
            "cost_aware_default": {"lambda_boundary": 0.0125,
              "rules": [{"name": "low", "calibration_method": "raw", "disagreement_threshold": 0.05, "lambda_min_inclusive": 0.0, "lambda_max_exclusive": 0.0125},
                        {"name": "high", "calibration_method": "raw", "disagreement_threshold": 0.5, "lambda_min_inclusive": 0.0125, "lambda_max_exclusive": 0.03}]}},
 "monitoring": {"window_size": 250, "hard_alert_thresholds": {"coverage_rel_drift_abs": 0.2, "ranking_auc_drop": 0.05, "reliability_ece_uplift": 0.05}}}"""

MODES = ("ranking_first", "reliability_first")
#: Values that the checks read: paths below the document and their types.
_VALUES = {
    **{f"{m}_{c}": (f"$.policy.modes.{m}.{k}", t) for m in MODES for c, k, t in (("method", "calibration_method", "string"), ("threshold", "disagreement_threshold", "double"))},
    "coverage_cap": ("$.monitoring.hard_alert_thresholds.coverage_rel_drift_abs", "double"),
    "ranking_first_cap": ("$.monitoring.hard_alert_thresholds.ranking_auc_drop", "double"),
    "reliability_first_cap": ("$.monitoring.hard_alert_thresholds.reliability_ece_uplift", "double"),
    "window_size": ("$.monitoring.window_size", "int"), "boundary": ("$.policy.cost_aware_default.lambda_boundary", "double"),
    **{f"{end}_{c}": (f"$.policy.cost_aware_default.rules[{i}].{k}", t) for i, end in enumerate(("low", "high")) for c, k, t in (("method", "calibration_method", "string"), ("threshold", "disagreement_threshold", "double"), ("from", "lambda_min_inclusive", "double"), ("to", "lambda_max_exclusive", "double"))},
}
#: Keys that a document may have at its top, in its policy and in its monitoring part.
_KNOWN = {"$": {"config_id", "created", "policy", "monitoring"}, "$.policy": {"modes", "cost_aware_default"}, "$.monitoring": {"window_size", "hard_alert_thresholds"}}


def pack(spark: SparkSession, text: str = PACK) -> DataFrame:
    """The document as one row (doc) of any shape; text that is no JSON gives a NULL document, on which every check of its contents fails."""
    return spark.range(1).select(F.try_parse_json(F.lit(text)).alias("doc"))


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """A document file as :func:`pack` gives it."""
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))


def _read(doc: DataFrame) -> DataFrame:
    """The values that the checks need, NULL where they are missing or of another type, and the document's unknown keys."""
    values = doc.select("doc", *[F.try_variant_get("doc", path, kind).alias(name) for name, (path, kind) in _VALUES.items()])
    keys = [F.map_keys(F.try_variant_get("doc", path, "map<string, variant>")) for path in _KNOWN]
    below = lambda path: lambda name: F.concat(F.lit(f"{path}."), name)
    odd = [F.transform(F.array_except(k, F.array(*map(F.lit, sorted(known)))), below(path)) for k, (path, known) in zip(keys, _KNOWN.items(), strict=True)]
    rules = F.size(F.try_variant_get("doc", "$.policy.cost_aware_default.rules", "array<variant>"))
    return values.withColumn("_unknown", F.flatten(F.array(*[F.coalesce(o, F.array().cast("array<string>")) for o in odd]))).withColumn("n_rules", F.when(rules >= 0, rules).otherwise(0)).withColumn("_there", F.col("doc").isNotNull()).drop("doc")


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def validate_pack(doc: DataFrame, modes: DataFrame, tuned: DataFrame, segments: DataFrame, replayed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(check_name, passed, detail) rows: the document against the table of modes, the tuned caps of its window size, the empirical cost schedule and the replay's conformance.

    ``modes``: mode, method, threshold.  ``tuned``: window_size, mode, coverage_cap, performance_cap.  ``segments``: lambda_start, method, threshold.  ``replayed``: exact_match.
    A missing or unknown key, a value of another type and an empty table are failed checks, never left out."""
    read = _read(doc)
    names = F.array(*[F.when(F.col(n).isNull(), F.lit(path)) for n, (path, _) in _VALUES.items()])
    missing = F.filter(names, lambda n: n.isNotNull())
    # all tables shrink to one row each before they meet the document
    by_mode = modes.groupBy().agg(*[
        a for m in MODES for own in [F.col("mode") == m]
        for a in (F.count_if(own).alias(f"{m}_rows"), F.array_sort(F.collect_set(F.when(own, F.col("method")))).alias(f"{m}_methods"), F.min(F.when(own, F.col("threshold"))).alias(f"{m}_least"), F.max(F.when(own, F.col("threshold"))).alias(f"{m}_most"))
    ])
    caps = tuned.join(F.broadcast(read.select(F.col("window_size").alias("_size"))), F.col("window_size") == F.col("_size")).groupBy().agg(
        F.count("*").alias("tuned_rows"), *[F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_tuned_{c}") for m in MODES for c in ("coverage_cap", "performance_cap")]
    )
    ends = segments.groupBy().agg(F.count("*").alias("n_segments"), *[f(F.struct("lambda_start", "method", "threshold")).alias(n) for f, n in ((F.min, "_low"), (F.max, "_high"))])
    exact = replayed.groupBy().agg(F.count("*").alias("n_replayed"), F.count_if(~F.col("exact_match")).alias("n_inexact"))
    row = read
    for table in (by_mode, caps, ends, exact):
        row = row.join(F.broadcast(table), F.lit(True))  # one row
    c = F.col
    checks: dict[str, tuple[Column, Column]] = {
        "keys_present": (F.size(missing) == 0, F.array_join(missing, ", ")), "keys_known": (F.col("_there") & (F.size("_unknown") == 0), F.array_join("_unknown", ", ")),
    }
    for m in MODES:
        checks |= {
            f"config_has_mode_{m}": (c(f"{m}_method").isNotNull(), c(f"{m}_method")),
            f"dual_mode_rows_for_{m}": (c(f"{m}_rows") > 0, c(f"{m}_rows").cast("string")),
            f"{m}_method_match": (F.array_compact(c(f"{m}_methods")) == F.array(f"{m}_method"), F.array_join(f"{m}_methods", ", ")),
            f"{m}_threshold_match": (is_close(c(f"{m}_least"), c(f"{m}_threshold")) & is_close(c(f"{m}_most"), c(f"{m}_threshold")), F.concat_ws(" to ", c(f"{m}_least").cast("string"), c(f"{m}_most").cast("string"))),
            f"tuned_row_for_{m}": (c(f"{m}_tuned_performance_cap").isNotNull(), c(f"{m}_tuned_performance_cap").cast("string")),
            f"{m}_coverage_cap_match": (_near(c("coverage_cap"), c(f"{m}_tuned_coverage_cap"), tolerance), c(f"{m}_tuned_coverage_cap").cast("string")),
            f"{m}_performance_cap_match": (_near(c(f"{m}_cap"), c(f"{m}_tuned_performance_cap"), tolerance), c(f"{m}_tuned_performance_cap").cast("string")),
        }
    checks |= {
        "tuned_thresholds_window_present": (c("tuned_rows") > 0, c("tuned_rows").cast("string")),
        "cost_schedule_rules_count": (c("n_rules") >= 2, c("n_rules").cast("string")),
        "empirical_schedule_segments": (c("n_segments") >= 2, c("n_segments").cast("string")),
        **{f"cost_schedule_{end}_rule_match": ((c(f"{end}_method") == c(f"_{end}.method")) & is_close(c(f"{end}_threshold"), c(f"_{end}.threshold")), F.concat_ws("@", c(f"_{end}.method"), c(f"_{end}.threshold").cast("string"))) for end in ("low", "high")},
        "cost_schedule_boundary_match": (_near(c("boundary"), c("_high.lambda_start"), tolerance), c("_high.lambda_start").cast("string")),
        "config_cost_schedule_contiguous": (_near(c("low_to"), c("high_from"), tolerance), F.concat_ws(" to ", c("low_to").cast("string"), c("high_from").cast("string"))),
        "replay_exact": ((c("n_replayed") > 0) & (c("n_inexact") == 0), F.concat_ws("/", c("n_inexact").cast("string"), c("n_replayed").cast("string"))),
    }
    each = [F.struct(F.lit(n).alias("check_name"), F.coalesce(ok, F.lit(False)).alias("passed"), F.coalesce(detail, F.lit("missing")).alias("detail")) for n, (ok, detail) in checks.items()]
    return row.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def compare_modes(doc: DataFrame, modes: DataFrame) -> DataFrame:
    """Each row of the table of modes beside the document's method and threshold for its mode."""
    wanted = _read(doc).select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_method").alias("config_method"), F.col(f"{m}_threshold").alias("config_threshold")) for m in MODES])).alias("w")).select("w.*")
    rows = modes.select("domain", "mode", F.col("method").alias("table_method"), F.col("threshold").alias("table_threshold")).join(F.broadcast(wanted), "mode")
    return rows.withColumn("method_match", F.coalesce(F.col("table_method") == F.col("config_method"), F.lit(False))).withColumn("threshold_match", F.coalesce(is_close(F.col("table_threshold"), F.col("config_threshold")), F.lit(False)))
