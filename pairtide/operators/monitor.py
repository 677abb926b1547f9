"""Monitoring of replayed policies over count-based windows: metrics, alerts, caps, incidents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.scalars import joined, mode_metric, shift_magnitude, six
from ..sources.tables import settled
from .ranking import best_rows
from .windows import permutable, permuted_windows, window_summaries, windows_of


def baselines(log: DataFrame) -> DataFrame:
    keys = ["domain", "mode"]
    cover = log.groupBy(*keys).agg(F.avg(F.col("referral_flag").cast("double")).alias("baseline_coverage"))
    return cover.join(metrics.summary(log, keys, "label", "policy_prob", "baseline_").drop("baseline_brier"), keys)


def with_alerts(windows: DataFrame, auc_cap: float, ece_cap: float, coverage_cap: float) -> DataFrame:
    """Alert flags of windows: strictly above the caps; a missing metric raises none.  An unknown mode is watched by both metrics."""
    over = lambda c, cap: F.coalesce(F.col(c) > cap, F.lit(False))
    out = windows.withColumn("coverage_alert", F.coalesce(F.abs(F.col("coverage_drift")) > coverage_cap, F.lit(False)))
    out = out.withColumn("ranking_alert", over("auc_drop", auc_cap)).withColumn("reliability_alert", over("ece_uplift", ece_cap))
    performance = F.when(F.col("mode") == "ranking_first", F.col("ranking_alert")).when(F.col("mode") == "reliability_first", F.col("reliability_alert")).otherwise(F.col("ranking_alert") | F.col("reliability_alert"))
    return out.withColumn("performance_alert", performance).withColumn("any_alert", F.col("coverage_alert") | F.col("performance_alert"))


def window_metrics(log: DataFrame, sizes, auc_cap: float = 0.05, ece_cap: float = 0.05, coverage_cap: float = 0.2, order: list[str] = ("event_id",), extra: list[str] = (), base: DataFrame | None = None, permutations: int = 0) -> DataFrame:
    """Metrics of every full window of each size, their change against the whole log (or ``base``), and alerts; values rounded.

    With ``permutations`` the windows are those of as many hash orders (permutation_id) of the one column in ``order``.  A key without a baseline is an error.  Without coverage in the baseline there is no drift and no coverage alert."""
    own, columns = ["domain", "mode", *extra], ("label", "policy_prob", "referral_flag")
    rows = log.select(*{*own, *order, *columns})
    seen = permuted_windows(rows, own, order[0], permutations, sizes, *columns) if permutations else window_summaries(rows, own, list(order), sizes, *columns)
    groups = ["window_size", *own, *(["permutation_id"] if permutations else []), "window_id"]
    return _against(seen, groups, baselines(log if base is None else base), auc_cap, ece_cap, coverage_cap)


#: Rows that the permutations of a round have together; they travel as 17 bytes each.
ROUND = 1 << 27


def permuted_metrics(log: DataFrame, sizes, permutations: int, summed: Callable[[DataFrame], DataFrame], auc_cap: float = 0.05, ece_cap: float = 0.05, coverage_cap: float = 0.2, order: str = "event_id") -> DataFrame:
    """``summed`` of the windows that :func:`window_metrics` finds in hash orders, which must keep permutations apart.

    Permutations are worked out in rounds, so what lies in shuffle files at one time is some permutations of the log and not all of them; a round's windows are summed up before the next."""
    own, columns = ["domain", "mode"], ("label", "policy_prob", "referral_flag")
    rows = settled(permutable(log.select(*own, order, *columns), own, order, *columns), "rows", small=False, passed=True)
    base = settled(baselines(log), "baselines", passed=True)
    size, out = min(max(2, ROUND // max(rows.count(), 1)), permutations), None
    for at in range(0, permutations, size):
        seen = windows_of(rows, own, range(at, min(at + size, permutations)), sizes)
        seen = _against(seen, ["window_size", *own, "permutation_id", "window_id"], F.broadcast(base), auc_cap, ece_cap, coverage_cap)  # a row for each group
        one = settled(summed(seen), "round", passed=True)
        out = one if out is None else out.unionByName(one)
    return out


def _against(seen: DataFrame, groups: list[str], base: DataFrame, auc_cap: float, ece_cap: float, coverage_cap: float) -> DataFrame:
    """Windows against baselines."""
    keys = ["domain", "mode"]
    seen = seen.where(F.col("window_ece").isNotNull()).join(base, keys, "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no baseline for"), *keys)).cast("double")
    base_coverage = F.col("baseline_coverage")
    drift = F.when(base_coverage.isNull(), missing).when(base_coverage > 0, (F.col("window_coverage") - base_coverage) / F.greatest(base_coverage, F.lit(1e-8)))
    out = seen.select(
        *groups, "n", six(F.col("window_auc")).alias("window_auc"), six(F.col("window_ece")).alias("window_ece"), six(F.col("window_coverage")).alias("window_coverage"),
        six(F.col("baseline_auc") - F.col("window_auc")).alias("auc_drop"), six(F.col("window_ece") - F.col("baseline_ece")).alias("ece_uplift"), six(drift).alias("coverage_drift"),
    )
    return with_alerts(out, auc_cap, ece_cap, coverage_cap)


def signal(windows: DataFrame) -> DataFrame:
    return windows.withColumn("signal", mode_metric(F.col("mode"), F.col("auc_drop"), F.col("ece_uplift")))


def window_summary(windows: DataFrame) -> DataFrame:
    """Per size, domain and mode: alert rates, quantiles, the share of missing metrics and recommended caps."""
    keys = ["window_size", "domain", "mode"]
    rate = lambda c: six(F.avg(F.col(c).cast("double"))).alias(f"{c}_rate")
    out = windows.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), rate("coverage_alert"), rate("performance_alert"), rate("any_alert"),
        six(F.avg(F.when(F.col("window_auc").isNull(), 1.0).otherwise(0.0))).alias("missing_auc"), six(F.avg("auc_drop")).alias("mean_auc_drop"), F.max("auc_drop").alias("max_auc_drop"),
    )
    each = {"auc_drop": F.col("auc_drop"), "ece_uplift": F.col("ece_uplift"), "drift": F.abs("coverage_drift")}
    long = windows.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c.alias("x")) for n, c in each.items()])).alias("_e")).select(*keys, "_e.*")
    found = metrics.quantiles(long, [*keys, "what"], "x", [0.5, 0.95])
    of = lambda name, i: six(F.max(F.when(F.col("what") == name, F.col("quantiles")[i])))
    found = found.groupBy(*keys).agg(of("auc_drop", 0).alias("median_auc_drop"), of("auc_drop", 1).alias("p95_auc_drop"), of("ece_uplift", 1).alias("p95_ece_uplift"), of("drift", 1).alias("p95_drift"))
    return joined(out, found, keys, "left")


def mode_aggregate(windows: DataFrame) -> DataFrame:
    return windows.groupBy("window_size", "mode").agg(
        F.count("*").alias("n_windows"), F.count("window_auc").alias("n_auc"), six(F.avg(F.abs("coverage_drift"))).alias("mean_abs_drift"), six(F.avg(F.col("any_alert").cast("double"))).alias("any_alert_rate")
    )


def quantile_grid(points: int = 80, low: float = 0.70, high: float = 0.999) -> list[float]:
    return [round(low + (high - low) * i / (points - 1), 6) for i in range(points)]


def _caps(windows: DataFrame, column: str, quantiles: list[float], name: str) -> DataFrame:
    caps = metrics.quantiles(windows, ["window_size", "mode"], column, quantiles)
    grid = caps.select("window_size", "mode", F.posexplode("quantiles").alias("_i", name))
    q = F.element_at(F.array(*[F.lit(q) for q in quantiles]), F.col("_i") + 1)
    return grid.select("window_size", "mode", q.alias(f"{name}_quantile"), six(F.col(name)).alias(name))


def tune_caps(windows: DataFrame, target: float = 0.05, points: int = 80) -> DataFrame:
    """Per size and mode the pair of caps, of a quantile grid, with the alert rate nearest to but not over the target; else the lowest rate.

    Windows are first counted by how many cut-offs of either kind they exceed, so a
    grid point is a sum over at most (points + 1)² counts and not over windows."""
    keys = ["window_size", "mode"]
    rows = signal(windows).withColumn("drift", F.abs("coverage_drift")).where("signal is not null and drift is not null")
    quantiles = quantile_grid(points)
    cover, perform = _caps(rows, "drift", quantiles, "coverage_cap"), _caps(rows, "signal", quantiles, "performance_cap")
    lists = cover.groupBy(*keys).agg(F.array_sort(F.collect_set("coverage_cap")).alias("cs")).join(perform.groupBy(*keys).agg(F.array_sort(F.collect_set("performance_cap")).alias("ps")), keys)
    above = rows.join(F.broadcast(lists), keys).select(*keys, F.size(F.filter("cs", lambda c: c < F.col("drift"))).alias("i"), F.size(F.filter("ps", lambda c: c < F.col("signal"))).alias("j"))
    counts = above.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n_windows"))
    points_c = lists.select(*keys, F.posexplode("cs").alias("ci", "coverage_cap"))
    points_p = lists.select(*keys, F.posexplode("ps").alias("pi", "performance_cap"))
    # No alert at (ci, pi) for windows that exceed at most ci and pi of the caps: a two-dimensional running sum.
    full = points_c.join(points_p, keys)
    cells = full.join(counts.select(*keys, F.col("i").alias("ci"), F.col("j").alias("pi"), "n"), [*keys, "ci", "pi"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    down = Window.partitionBy(*keys, "pi").orderBy("ci").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(*keys, "ci").orderBy("pi").rowsBetween(Window.unboundedPreceding, 0)
    quiet = cells.withColumn("_d", F.sum("n").over(down)).withColumn("_q", F.sum("_d").over(right))
    rated = quiet.join(total, keys).withColumn("alert_rate", six(1.0 - F.col("_q") / F.col("n_windows"))).withColumn("feasible", F.col("alert_rate") <= target + 1e-12)
    order = (F.desc("feasible"), F.when(F.col("feasible"), target - F.col("alert_rate")).otherwise(F.col("alert_rate")), "coverage_cap", "performance_cap")
    return best_rows(rated, keys, *order).select(*keys, "coverage_cap", "performance_cap", "alert_rate", "feasible", "n_windows")


def tune_performance_cap(windows: DataFrame, coverage_cap: float = 0.2, target: float = 0.05, points: int = 80) -> DataFrame:
    """At a fixed coverage cap the smallest performance cap that keeps the target; if none does, the smallest of all, flagged."""
    keys = ["window_size", "mode"]
    rows = signal(windows).where("signal is not null and coverage_drift is not null")
    caps = _caps(rows, "signal", quantile_grid(points), "performance_cap").select(*keys, "performance_cap").distinct()
    hit = (F.abs("coverage_drift") > coverage_cap) | (F.col("signal") > F.col("performance_cap"))
    rates = rows.join(F.broadcast(caps), keys).groupBy(*keys, "performance_cap").agg(six(F.avg(hit.cast("double"))).alias("alert_rate"))
    rates = rates.withColumn("feasible", F.col("alert_rate") <= target + 1e-12)
    return best_rows(rates, keys, F.desc("feasible"), "performance_cap")


def incidents(windows: DataFrame, profiles: DataFrame, coverage_shifts, performance_shifts) -> DataFrame:
    """Alert rate under every shift of coverage and performance, for each profile (profile, coverage_cap, performance_cap)."""
    rows = signal(windows).where("signal is not null and coverage_drift is not null")
    grid = rows.crossJoin(F.broadcast(profiles))
    grid = grid.withColumn("coverage_shift", F.explode(F.array(*[F.lit(float(x)) for x in coverage_shifts]))).withColumn("performance_shift", F.explode(F.array(*[F.lit(float(x)) for x in performance_shifts])))
    moved = F.abs(shift_magnitude(F.col("coverage_drift"), F.col("coverage_shift"))) > F.col("coverage_cap")
    worse = F.col("signal") + F.col("performance_shift") > F.col("performance_cap")
    return grid.groupBy("window_size", "mode", "profile", "coverage_shift", "performance_shift").agg(F.count("*").alias("n_windows"), six(F.avg((moved | worse).cast("double"))).alias("alert_rate"))


def incident_matrix(power: DataFrame, shifts) -> DataFrame:
    """Alert rates with performance shifts as columns, averaged over sizes."""
    names = {float(s): "shift_" + f"{s:.3f}".replace(".", "_") for s in shifts}
    out = power.groupBy("mode", "profile", "coverage_shift").pivot("performance_shift", list(names)).agg(six(F.avg("alert_rate")))
    return out.toDF("mode", "profile", "coverage_shift", *names.values())


def consecutive_alerts(flags: DataFrame, groups: list[str], order: str, flag: str = "any_alert") -> DataFrame:
    """Per sequence: whether two alerts follow each other, and the place from 1 of the first second one."""
    along = Window.partitionBy(*groups).orderBy(order)
    both = F.col(flag) & F.coalesce(F.lag(flag).over(along), F.lit(False))
    marked = flags.withColumn("_p", F.row_number().over(along)).withColumn("_b", both)
    return marked.groupBy(*groups).agg(F.bool_or("_b").alias("detected"), F.min(F.when(F.col("_b"), F.col("_p"))).alias("first_detection"))


def soft_alerts(flags: DataFrame, groups: list[str], order: str, flag: str = "any_alert", least: int = 3, of: int = 5) -> DataFrame:
    """``flags`` with ``soft_alert``: ``least`` or more alerts among the last ``of`` windows."""
    recent = Window.partitionBy(*groups).orderBy(order).rowsBetween(1 - of, 0)
    return flags.withColumn("soft_alert", F.sum(F.col(flag).cast("int")).over(recent) >= least)
