"""Referral policies: grids of candidates, constrained choices, schedules and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.scalars import joined, nearly_equal, rule_label, six
from ..sources.tables import settled
from .ranking import best_rows, gaps, islands, relax


def refer(a: Column, b: Column, stacked: Column, best: Column, threshold: Column | float) -> Column:
    """The stacked score where the models disagree by the threshold or more, else the best single one."""
    limit = F.lit(float(threshold)) if isinstance(threshold, float | int) else threshold
    return F.when(F.abs(b - a) >= limit, stacked).otherwise(best)


def refer_row(a: float, b: float, stacked: float, best: float, threshold: float) -> float:
    """:func:`refer` for one row, to check replays against."""
    return stacked if abs(b - a) >= threshold else best


def best_models(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, auc_a, auc_b, best_single_model): model A where its AUROC is at least B's; B if either is missing."""
    long = pairs.select(*groups, "label", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_prob").alias("p")) for m in "ab"])).alias("s")).select(*groups, "label", "s.*")
    each = metrics.auroc(long, [*groups, "model"], "label", "p", "auc")
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("auc")))
    return each.groupBy(*groups).agg(of("a").alias("auc_a"), of("b").alias("auc_b")).withColumn("best_single_model", F.when(F.col("auc_a") >= F.col("auc_b"), "a").otherwise("b"))


def best_single(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """``pairs`` with best_prob and best_single_model of :func:`best_models`."""
    out = pairs.join(best_models(pairs, groups), groups)
    return out.withColumn("best_prob", F.when(F.col("best_single_model") == "a", F.col("a_prob")).otherwise(F.col("b_prob")))


def candidates(pairs: DataFrame, thresholds) -> DataFrame:
    """Metrics of each (domain, method, threshold) and their differences to the best single model of the same method, rounded."""
    groups, keys = ["domain", "method"], ["domain", "method", "threshold"]
    based = settled(best_single(pairs, groups).select(*groups, "label", "a_prob", "b_prob", "stacked_prob", "best_prob", "best_single_model"), "based", small=False)
    gap = F.abs(F.col("b_prob") - F.col("a_prob"))
    referred = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(gap >= t).alias("n_referred")) for t in thresholds])
    counts = based.groupBy(*groups).agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), referred.alias("_r"), F.first("best_single_model").alias("best_single_model"))
    counts = counts.select("*", F.explode("_r").alias("_e")).select(*groups, "n", "n_positive", "best_single_model", "_e.*").withColumn("coverage", F.col("n_referred") / F.col("n"))
    # a threshold that no gap reaches is the best single model itself
    limits = F.explode(F.array(*[F.lit(float(t)) for t in thresholds], F.lit(float("inf"))))
    grid = based.withColumn("threshold", limits).select(*keys, "label", refer(F.col("a_prob"), F.col("b_prob"), F.col("stacked_prob"), F.col("best_prob"), F.col("threshold")).alias("policy_prob"))
    told = settled(metrics.summary(grid, keys, "label", "policy_prob", "policy_"), "told")
    reference = told.where(F.col("threshold") == float("inf")).select(*groups, *[F.col(f"policy_{m}").alias(f"best_{m}") for m in ("auc", "ece", "brier")])
    out = joined(joined(counts, told, keys), reference, groups)
    return out.select(
        *keys,
        "best_single_model",
        "n",
        "n_positive",
        "n_referred",
        six(F.col("coverage")).alias("coverage"),
        *[six(F.col(f"{p}_{m}")).alias(f"{p}_{m}") for p in ("policy", "best") for m in ("auc", "ece", "brier")],
        *[six(F.col(f"policy_{m}") - F.col(f"best_{m}")).alias(f"delta_{m}") for m in ("auc", "ece", "brier")],
    )


def ranking_first(grid: DataFrame, ece_cap: float = 0.02, least_coverage: float = 0.05) -> DataFrame:
    """Per domain: enough coverage, then a small rise in error, then the largest gain; each filter is lifted where nothing passes."""
    ok = relax(grid, ["domain"], F.col("coverage") >= least_coverage).drop("fallback")
    ok = relax(ok, ["domain"], F.col("delta_ece") <= ece_cap)
    return best_rows(ok, ["domain"], F.desc("delta_auc"), F.asc("delta_ece"), F.desc("coverage"), "method", "threshold")


def reliability_first(grid: DataFrame, auc_cap: float = 0.005, least_coverage: float = 0.05) -> DataFrame:
    """Per domain: enough coverage, then a small loss in ranking, then the lowest error."""
    ok = relax(grid, ["domain"], F.col("coverage") >= least_coverage).drop("fallback")
    ok = relax(ok, ["domain"], F.col("delta_auc") >= -auc_cap)
    return best_rows(ok, ["domain"], F.asc("delta_ece"), F.desc("delta_auc"), F.desc("coverage"), "method", "threshold")


def across_domains(grid: DataFrame) -> DataFrame:
    """Each (method, threshold) over the domains: counts, means and extremes of its differences."""
    return grid.groupBy("method", "threshold").agg(
        F.countDistinct("domain").alias("n_domains"),
        *[six(F.avg(f"delta_{m}")).alias(f"mean_delta_{m}") for m in ("auc", "ece", "brier")],
        F.min("delta_auc").alias("min_delta_auc"),
        F.max("delta_ece").alias("max_delta_ece"),
        six(F.avg("coverage")).alias("mean_coverage"),
    )


def default_policy(grid: DataFrame, ece_cap: float = 0.02, least_coverage: float = 0.05) -> DataFrame:
    """One rule for all domains: no domain loses ranking or gains more error than the cap; else the least bad."""
    rules = across_domains(grid.where(F.col("coverage") >= least_coverage)).withColumn("_all", F.lit(1))
    safe = relax(rules, ["_all"], (F.col("min_delta_auc") >= 0) & (F.col("max_delta_ece") <= ece_cap))
    order = (F.desc("n_domains"), F.desc("mean_delta_auc"), F.asc("mean_delta_ece"), F.desc("mean_coverage"), "method", "threshold")
    return best_rows(safe, ["_all"], *order).drop("_all")


def default_gap(grid: DataFrame, ece_cap: float = 0.02, least_coverage: float = 0.05) -> DataFrame:
    """What each domain loses by the default rule against its own ranking-first choice."""
    rule = default_policy(grid, ece_cap, least_coverage).select("method", "threshold")
    default = grid.join(F.broadcast(rule), ["method", "threshold"]).select("domain", F.col("delta_auc").alias("default_delta_auc"), F.col("delta_ece").alias("default_delta_ece"))
    own = ranking_first(grid, ece_cap, least_coverage).select("domain", "method", "threshold", "delta_auc", "delta_ece")
    return own.join(default, "domain").select("*", six(F.col("delta_auc") - F.col("default_delta_auc")).alias("auc_gap"), six(F.col("delta_ece") - F.col("default_delta_ece")).alias("ece_gap"))


def utilities(grid: DataFrame, lambdas, least_coverage: float = 0.0) -> DataFrame:
    """Every candidate at every cost: utility = gain in AUROC less cost times coverage; an empty choice is an error."""
    kept = grid.where(F.col("coverage") >= least_coverage)
    if kept.isEmpty():
        raise ValueError("no candidate has enough coverage")
    costs = F.explode(F.array(*[F.lit(float(x)) for x in lambdas]))
    return kept.withColumn("cost", costs).withColumn("utility", six(F.col("delta_auc") - F.col("cost") * F.col("coverage")))


def utility_best(scored: DataFrame) -> DataFrame:
    return best_rows(scored, ["cost", "domain"], F.desc("utility"), F.desc("delta_auc"), F.asc("coverage"), "method", "threshold")


def utility_default(scored: DataFrame) -> DataFrame:
    """The best rule over all domains at each cost; rules must exist in every domain, unless none does."""
    total = scored.agg(F.countDistinct("domain").alias("_total"))
    rules = scored.groupBy("cost", "method", "threshold").agg(
        F.countDistinct("domain").alias("n_domains"), six(F.avg("utility")).alias("mean_utility"), F.min("utility").alias("min_utility"), six(F.avg("delta_auc")).alias("mean_delta_auc"), six(F.avg("coverage")).alias("mean_coverage")
    )
    full = relax(rules.crossJoin(F.broadcast(total)), ["cost"], F.col("n_domains") == F.col("_total")).drop("_total", "fallback")
    return best_rows(full, ["cost"], F.desc("mean_utility"), F.desc("min_utility"), F.asc("mean_coverage"), "method", "threshold")


def utility_gap(scored: DataFrame) -> DataFrame:
    """Utility that each domain loses by the default rule at each cost."""
    rule = utility_default(scored).select("cost", "method", "threshold")
    default = scored.join(rule, ["cost", "method", "threshold"]).select("cost", "domain", F.col("utility").alias("default_utility"))
    best = utility_best(scored).select("cost", "domain", F.col("utility").alias("best_utility"))
    return best.join(default, ["cost", "domain"]).withColumn("gap", six(F.col("best_utility") - F.col("default_utility")))


def stability(defaults: DataFrame) -> DataFrame:
    """How often, and from which to which cost, each rule is the default."""
    return defaults.groupBy("method", "threshold").agg(F.count("*").alias("n_lambdas"), F.min("cost").alias("min_lambda"), F.max("cost").alias("max_lambda"))


def two_rules(scored: DataFrame) -> DataFrame:
    """At each cost the best assignment of domains to at most two rules.

    For a pair of rules each domain takes its better one, so pairs of rules are listed and not assignments."""
    rules = scored.select("cost", "domain", "utility", "coverage", rule_label(F.col("method"), F.col("threshold")).alias("rule"))
    names = rules.select("cost", "rule").distinct()
    pairs = names.select("cost", F.col("rule").alias("rule_1")).join(names.select("cost", F.col("rule").alias("rule_2")), "cost").where("rule_1 <= rule_2")
    left = rules.select("cost", "domain", F.col("rule").alias("rule_1"), F.col("utility").alias("u1"), F.col("coverage").alias("c1"))
    right = rules.select("cost", "domain", F.col("rule").alias("rule_2"), F.col("utility").alias("u2"), F.col("coverage").alias("c2"))
    each = pairs.join(left, ["cost", "rule_1"]).join(right, ["cost", "domain", "rule_2"])
    first = (F.col("u1") > F.col("u2")) | ((F.col("u1") == F.col("u2")) & (F.col("c1") <= F.col("c2")))
    each = each.withColumn("utility", F.when(first, F.col("u1")).otherwise(F.col("u2"))).withColumn("coverage", F.when(first, F.col("c1")).otherwise(F.col("c2")))
    total = each.groupBy("cost", "rule_1", "rule_2").agg(
        F.count("*").alias("n_domains"), six(F.avg("utility")).alias("mean_utility"), F.min("utility").alias("min_utility"), six(F.avg("coverage")).alias("mean_coverage")
    )
    return best_rows(total, ["cost"], F.desc("n_domains"), F.desc("mean_utility"), F.desc("min_utility"), F.asc("mean_coverage"), "rule_1", "rule_2")


def dual_modes(grid: DataFrame, threshold: float = 0.05, auc_tolerance: float = 0.005) -> DataFrame:
    """Per domain at one threshold: the method with the largest AUROC, and the one with the least error among those within a tolerance of it."""
    at = grid.where(F.abs(F.col("threshold") - threshold) <= 1e-8 + 1e-5 * threshold)
    columns = ["domain", "mode", "method", "threshold", "coverage", "policy_auc", "policy_ece", "policy_brier"]
    ranking = best_rows(at, ["domain"], F.desc("policy_auc"), F.asc("policy_ece"), "method").withColumn("mode", F.lit("ranking_first"))
    top = at.groupBy("domain").agg(F.max("policy_auc").alias("_top"))
    near = at.join(top, "domain").where(F.col("policy_auc") >= F.col("_top") - auc_tolerance)
    reliable = best_rows(near, ["domain"], F.asc("policy_ece"), F.desc("policy_auc"), "method").withColumn("mode", F.lit("reliability_first"))
    return ranking.select(*columns).unionByName(reliable.select(*columns))


def mode_summary(modes: DataFrame) -> DataFrame:
    means = [six(F.avg(c)).alias(f"mean_{c}") for c in ("coverage", "policy_auc", "policy_ece", "policy_brier")]
    return modes.groupBy("mode").agg(F.countDistinct("domain").alias("n_domains"), *means)


def schedule(defaults: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Segments of the cost axis, for each of the ``keys``, in which the default rule stays the same."""
    ruled = defaults.withColumn("_all", F.lit(1)).withColumn("rule", rule_label(F.col("method"), F.col("threshold")))
    return islands(ruled, [*keys, "_all"], "cost", "rule").groupBy(*keys, "island").agg(
        F.min("cost").alias("lambda_start"), F.max("cost").alias("lambda_end"), F.first("method").alias("method"), F.first("threshold").alias("threshold"), F.first("rule").alias("rule"),
        six(F.avg("mean_utility")).alias("mean_utility"), six(F.avg("mean_coverage")).alias("mean_coverage"),
    ).drop("island")


def schedule_integrity(segments: DataFrame) -> DataFrame:
    checked = gaps(segments.withColumn("_all", F.lit(1)), ["_all"], "lambda_start", "lambda_end").drop("_all")
    return checked.select("lambda_start", "lambda_end", "rule", six(F.col("gap")).alias("gap"), six(F.col("overlap")).alias("overlap"))


def rule_at(rows: DataFrame, segments: DataFrame, keys: list[str] = (), at: str = "cost") -> DataFrame:
    """``rows`` with the rule of the schedule of their ``keys``: a segment holds its start and all costs below the next segment's start, the last one its end too; other costs have a NULL rule.

    A segment is cut into bins as wide as the power of two below its length, so it lies in three at most; each distinct cost looks up one bin for each width that its schedule has.
    The join is by equality of keys, width and bin, and cuts exactly inside the bin."""
    keys, start, end = list(keys), F.col("lambda_start"), F.col("lambda_end")
    following = F.lead("lambda_start").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("lambda_start", "lambda_end"))
    ends = segments.select(*keys, "lambda_start", "lambda_end", "rule", following.alias("_next")).withColumn("_stop", F.coalesce("_next", end))
    ends = ends.where((F.col("_stop") > start) | (F.col("_next").isNull() & (F.col("_stop") == start)))
    most = F.greatest(F.abs(start), F.abs("_stop"), F.lit(1.0))
    ends = ends.withColumn("_width", F.greatest(F.floor(F.log2(F.greatest(F.col("_stop") - start, F.lit(1e-300)))), F.floor(F.log2(most)) - 50).cast("int"))
    place = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_width"))).cast("long")
    binned = ends.withColumn("_bin", F.explode(F.sequence(place(start), place(F.col("_stop")))))
    widths = ends.select(*keys, "_width").distinct()
    asked = rows.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at")).distinct()
    asked = joined(asked, widths, keys).withColumn("_bin", place(F.col("_at"))) if keys else asked.join(widths, F.lit(True)).withColumn("_bin", place(F.col("_at")))
    inside = (F.col("_at") >= start) & F.when(F.col("_next").isNull(), F.col("_at") <= end).otherwise(F.col("_at") < F.col("_next"))
    found = joined(asked, binned, [*keys, "_width", "_bin"]).where(inside).select(*keys, F.col("_at").alias(at), "rule")
    return joined(rows, found, [*keys, at], "left")


def replay(pairs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The log of two modes (raw scores for ranking, affine ones for reliability) with each row's policy score and referral."""
    based = best_single(pairs, ["domain", "method"])
    mode = F.when(F.col("method") == "raw", "ranking_first").otherwise("reliability_first")
    referred = (F.abs(F.col("b_prob") - F.col("a_prob")) >= threshold).cast("int")
    policy = refer(F.col("a_prob"), F.col("b_prob"), F.col("stacked_prob"), F.col("best_prob"), threshold)
    return based.select("event_id", "domain", mode.alias("mode"), "method", F.lit(threshold).alias("threshold"), "label", "a_prob", "b_prob", "stacked_prob", "best_prob", "best_single_model", policy.alias("policy_prob"), referred.alias("referral_flag"))


def conformance(log: DataFrame, expected: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Per domain and mode: rows whose policy score differs from a row-by-row replay, and observed less expected metrics."""
    row_wise = F.udf(refer_row, "double")(F.col("a_prob"), F.col("b_prob"), F.col("stacked_prob"), F.col("best_prob"), F.col("threshold"))
    checked = log.withColumn("_same", nearly_equal(F.col("policy_prob"), row_wise, tolerance))
    keys = ["domain", "mode"]
    counts = checked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((~F.col("_same")).cast("int")).alias("n_mismatch"), F.avg(F.col("referral_flag").cast("double")).alias("coverage"))
    seen = counts.join(metrics.summary(log, keys, "label", "policy_prob"), keys).join(expected, keys)
    return seen.select(
        *keys, "n", "n_mismatch", (F.col("n_mismatch") == 0).alias("exact_match"),
        *[six(F.col(o) - F.col(e)).alias(f"{o}_difference") for o, e in (("auc", "policy_auc"), ("ece", "policy_ece"), ("brier", "policy_brier"))],
        six(F.col("coverage") - F.col("expected_coverage")).alias("coverage_difference"),
    )
