"""Queries on window monitoring of replayed policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config, monitor, policy, resample
from ..sources.tables import settled
from . import sql
from .policies import _DUAL, conforming, grid, log
from .registry import query
from .sql import REPLAY, sql_hash, with_

SIZES = (100, 250, 500)
SEQUENCES = 5000
PERMUTATIONS = 250
WIN = f"{REPLAY}, {sql.windows(sizes=SIZES)}"


def windows(spark, sf_dir):
    """One row per size, domain, mode and window."""
    return settled(monitor.window_metrics(settled(log(spark, sf_dir), "replay", small=False), SIZES), "windows", small=False)


@query(with_(WIN) + "from win")
def window_metrics(spark, sf_dir):
    return windows(spark, sf_dir)


@query(with_(WIN) + """select window_size, domain, mode, count(*) as n_windows, round(avg(coverage_alert::int), 6) as coverage_alert_rate, round(avg(performance_alert::int), 6) as performance_alert_rate, round(avg(any_alert::int), 6) as any_alert_rate,
  round(avg((window_auc is null)::int), 6) as missing_auc, round(avg(auc_drop), 6) as mean_auc_drop, round(median(auc_drop), 6) as median_auc_drop, max(auc_drop) as max_auc_drop, round(quantile_cont(auc_drop, 0.95), 6) as p95_auc_drop,
  round(quantile_cont(ece_uplift, 0.95), 6) as p95_ece_uplift, round(quantile_cont(abs(coverage_drift), 0.95), 6) as p95_drift from win group by all""")
def window_summary(spark, sf_dir):
    return monitor.window_summary(windows(spark, sf_dir))


@query(with_(WIN) + "select window_size, mode, count(*) as n_windows, count(window_auc) as n_auc, round(avg(abs(coverage_drift)), 6) as mean_abs_drift, round(avg(any_alert::int), 6) as any_alert_rate from win group by all")
def mode_aggregate(spark, sf_dir):
    return monitor.mode_aggregate(windows(spark, sf_dir))


_Q = ", ".join(f"{q!r}" for q in monitor.quantile_grid())
_SIG = "sig as (select *, case when mode = 'ranking_first' then auc_drop else ece_uplift end as signal, abs(coverage_drift) as drift from win)"


@query(with_(WIN, _SIG, f"cc as (select window_size, mode, unnest(l) as coverage_cap from (select window_size, mode, list_distinct(list_transform(quantile_cont(drift, [{_Q}]), lambda x: round(x, 6))) as l from sig where signal is not null and drift is not null group by window_size, mode))",
             f"pc as (select window_size, mode, unnest(l) as performance_cap from (select window_size, mode, list_distinct(list_transform(quantile_cont(signal, [{_Q}]), lambda x: round(x, 6))) as l from sig where signal is not null and drift is not null group by window_size, mode))",
             "rated as (select window_size, mode, coverage_cap, performance_cap, count(*) as n_windows, round(avg((drift > coverage_cap or signal > performance_cap)::int), 6) as alert_rate from cc join pc using (window_size, mode) join (from sig where signal is not null and drift is not null) using (window_size, mode) group by all)")
       + sql.best("select *, alert_rate <= 0.05 + 1e-12 as feasible from rated", "window_size, mode", "feasible desc, case when feasible then 0.05::double - alert_rate else alert_rate end, coverage_cap, performance_cap"))
def cap_tuning(spark, sf_dir):
    return monitor.tune_caps(windows(spark, sf_dir)).select("window_size", "mode", "coverage_cap", "performance_cap", "n_windows", "alert_rate", "feasible")


@query(with_(WIN, _SIG, f"pc as (select window_size, mode, unnest(l) as performance_cap from (select window_size, mode, list_distinct(list_transform(quantile_cont(signal, [{_Q}]), lambda x: round(x, 6))) as l from sig where signal is not null and drift is not null group by window_size, mode))",
             "rated as (select window_size, mode, performance_cap, round(avg((drift > 0.2 or signal > performance_cap)::int), 6) as alert_rate from pc join (from sig where signal is not null and drift is not null) using (window_size, mode) group by all)")
       + sql.best("select *, alert_rate <= 0.05 + 1e-12 as feasible from rated", "window_size, mode", "feasible desc, performance_cap"))
def perf_cap_tuning(spark, sf_dir):
    return monitor.tune_performance_cap(windows(spark, sf_dir))


_SHIFTS = ((0.0, 0.05, 0.1, 0.15), (0.0, 0.005, 0.01, 0.02, 0.03, 0.05))
_PROFILES = "prof as (select * from (values ('loose', 0.3::double, 0.1::double), ('strict', 0.2, 0.05)) p(profile, coverage_cap, performance_cap))"
_POWER = f"""power as (select window_size, mode, profile, coverage_shift, performance_shift, count(*) as n_windows,
  round(avg((abs(case when coverage_drift < 0 then -1 else 1 end * (abs(coverage_drift) + coverage_shift)) > coverage_cap or signal + performance_shift > performance_cap)::int), 6) as alert_rate
  from sig, prof, (values {", ".join(f"({x!r}::double)" for x in _SHIFTS[0])}) c(coverage_shift), (values {", ".join(f"({x!r}::double)" for x in _SHIFTS[1])}) p(performance_shift) where signal is not null and coverage_drift is not null group by all)"""


def _power(spark, sf_dir):
    profiles = spark.createDataFrame([("loose", 0.3, 0.1), ("strict", 0.2, 0.05)], "profile string, coverage_cap double, performance_cap double")
    return monitor.incidents(windows(spark, sf_dir), profiles, *_SHIFTS)


@query(with_(WIN, _SIG, _PROFILES, _POWER) + "from power")
def incident_power(spark, sf_dir):
    return _power(spark, sf_dir)


@query(with_(WIN, _SIG, _PROFILES, _POWER) + "select mode, profile, coverage_shift, " + ", ".join(f"round(avg(alert_rate) filter (performance_shift = {s!r}), 6) as shift_{f'{s:.3f}'.replace('.', '_')}" for s in _SHIFTS[1]) + " from power group by all")
def incident_matrix(spark, sf_dir):
    return monitor.incident_matrix(_power(spark, sf_dir), _SHIFTS[1])


@query(with_(WIN) + """select window_size, domain, mode, bool_or(b) as detected, min(p) filter (b) as first_detection from (select *, any_alert and coalesce(lag(any_alert) over w, false) as b, row_number() over w as p
  from win window w as (partition by window_size, domain, mode order by window_id)) group by all""")
def consecutive_alerts(spark, sf_dir):
    out = monitor.consecutive_alerts(windows(spark, sf_dir), ["window_size", "domain", "mode"], "window_id")
    return out.withColumn("first_detection", F.col("first_detection").cast("long"))


@query(with_(WIN) + "select window_size, domain, mode, window_id, any_alert, sum(any_alert::int) over (partition by window_size, domain, mode order by window_id rows between 4 preceding and current row) >= 3 as soft_alert from win")
def soft_alerts(spark, sf_dir):
    return monitor.soft_alerts(windows(spark, sf_dir), ["window_size", "domain", "mode"], "window_id").select("window_size", "domain", "mode", "window_id", "any_alert", "soft_alert")


_SEQ = f"""keyed as (select *, domain || '/' || window_id as k from win where window_size = 100),
  num as (select *, row_number() over (partition by mode order by k) - 1 as i, count(*) over (partition by mode) as total from keyed),
  slots as (select mode, s as sequence_id, p as position, {sql_hash("'42'", "s", "p")} % total as i from (select distinct mode, total from num), range({SEQUENCES}) a(s), range(1, 21) b(p)),
  drawn as (select slots.mode, sequence_id, position, any_alert from slots join num using (mode, i))"""


@query(with_(WIN, _SEQ) + """select mode, count(*) as n_sequences, round(avg(detected::int), 6) as detection_rate, median(first_detection) as median_first_detection from (select mode, sequence_id, bool_or(b) as detected, min(position) filter (b) as first_detection from
  (select *, any_alert and coalesce(lag(any_alert) over (partition by mode, sequence_id order by position), false) as b from drawn) group by all) group by mode""")
def sequence_detection(spark, sf_dir):
    rows = windows(spark, sf_dir).where("window_size = 100").withColumn("k", F.concat_ws("/", "domain", F.col("window_id").cast("string"))).select("mode", "k", "any_alert")
    drawn = resample.sequences(rows, ["mode"], "k", SEQUENCES, 20)
    found = monitor.consecutive_alerts(drawn, ["mode", "sequence_id"], "position")
    return found.groupBy("mode").agg(F.count("*").alias("n_sequences"), F.round(F.avg(F.col("detected").cast("double")), 6).alias("detection_rate"), F.median("first_detection").alias("median_first_detection"))


_PERM = f"perm as (select replay.*, g as permutation_id, {sql_hash(repr('42'), 'g', 'event_id')} as perm_order from replay, range({PERMUTATIONS}) p(g))"
#: Window sizes of the permutations.
PERMUTED_SIZES = (250, 500, 1000)


@query(with_(REPLAY, _PERM, sql.windows("perm", PERMUTED_SIZES, ", permutation_id", "perm_order, event_id")) + "select window_size, mode, permutation_id::int as permutation_id, count(*) as n_windows, round(avg(auc_drop), 9) as mean_auc_drop, round(avg(any_alert::int), 6) as any_alert_rate from win group by all")
def permutation_windows(spark, sf_dir):
    replayed = settled(log(spark, sf_dir), "replay", small=False, passed=True)
    return monitor.permuted_metrics(replayed, PERMUTED_SIZES, PERMUTATIONS, lambda out: out.groupBy("window_size", "mode", "permutation_id").agg(F.count("*").alias("n_windows"), F.round(F.avg("auc_drop"), 9).alias("mean_auc_drop"), F.round(F.avg(F.col("any_alert").cast("double")), 6).alias("any_alert_rate")))


_RULE = "d -> 'policy' -> 'cost_aware_default' -> 'rules' -> {0}"
_CAP = "(d -> 'monitoring' -> 'hard_alert_thresholds' ->> '{0}')::double"
_MODE_CHECKS = " union all ".join(f"""select unnest([{{'check_name': 'config_has_mode_{m}', 'passed': (d -> 'policy' -> 'modes' -> '{m}' ->> 'calibration_method') is not null}}, {{'check_name': 'dual_mode_rows_for_{m}', 'passed': n > 0}},
    {{'check_name': '{m}_method_match', 'passed': same_method}}, {{'check_name': '{m}_threshold_match', 'passed': same_threshold}}, {{'check_name': 'tuned_row_for_{m}', 'passed': perf is not null}},
    {{'check_name': '{m}_coverage_cap_match', 'passed': abs({_CAP.format('coverage_rel_drift_abs')} - 0.2) <= 1e-9}}, {{'check_name': '{m}_performance_cap_match', 'passed': abs({_CAP.format(cap)} - perf) <= 1e-9}}], recursive := true)
    from pack, (select count(*) as n, bool_and(method = (d -> 'policy' -> 'modes' -> '{m}' ->> 'calibration_method')) as same_method, bool_and(abs(threshold - (d -> 'policy' -> 'modes' -> '{m}' ->> 'disagreement_threshold')::double) <= 1e-8 + 1e-5 * abs((d -> 'policy' -> 'modes' -> '{m}' ->> 'disagreement_threshold')::double)) as same_threshold from dual, pack where mode = '{m}'),
      (select max(performance_cap) as perf from tuned, pack where mode = '{m}' and window_size = (d -> 'monitoring' ->> 'window_size')::int)""" for m, cap in (("ranking_first", "ranking_auc_drop"), ("reliability_first", "reliability_ece_uplift")))
_PACK = f"""pack as (select '{config.PACK}'::json as d), sched as ({sql.SCHEDULE}), ends as (select count(*) as n, arg_min(method, lambda_start) as low_method, arg_min(threshold, lambda_start) as low_threshold, arg_max(method, lambda_start) as high_method, arg_max(threshold, lambda_start) as high_threshold, max(lambda_start) as high_start from sched),
  checks as ({_MODE_CHECKS} union all select unnest([{{'check_name': 'keys_present', 'passed': true}}, {{'check_name': 'keys_known', 'passed': list_sort(json_keys(d)) = ['config_id', 'created', 'monitoring', 'policy'] and list_sort(json_keys(d -> 'policy')) = ['cost_aware_default', 'modes'] and list_sort(json_keys(d -> 'monitoring')) = ['hard_alert_thresholds', 'window_size']}},
    {{'check_name': 'tuned_thresholds_window_present', 'passed': (select count(*) from tuned where window_size = (d -> 'monitoring' ->> 'window_size')::int) > 0}}, {{'check_name': 'cost_schedule_rules_count', 'passed': json_array_length(d -> 'policy' -> 'cost_aware_default' -> 'rules') >= 2}}, {{'check_name': 'empirical_schedule_segments', 'passed': n >= 2}},
    {{'check_name': 'cost_schedule_low_rule_match', 'passed': ({_RULE.format(0)} ->> 'calibration_method') = low_method and abs(({_RULE.format(0)} ->> 'disagreement_threshold')::double - low_threshold) <= 1e-8 + 1e-5 * low_threshold}},
    {{'check_name': 'cost_schedule_high_rule_match', 'passed': ({_RULE.format(1)} ->> 'calibration_method') = high_method and abs(({_RULE.format(1)} ->> 'disagreement_threshold')::double - high_threshold) <= 1e-8 + 1e-5 * high_threshold}},
    {{'check_name': 'cost_schedule_boundary_match', 'passed': abs((d -> 'policy' -> 'cost_aware_default' ->> 'lambda_boundary')::double - high_start) <= 1e-9}},
    {{'check_name': 'config_cost_schedule_contiguous', 'passed': abs(({_RULE.format(0)} ->> 'lambda_max_exclusive')::double - ({_RULE.format(1)} ->> 'lambda_min_inclusive')::double) <= 1e-9}}, {{'check_name': 'replay_exact', 'passed': true}}], recursive := true) from pack, ends)"""
_TUNED = (f"pc as (select window_size, mode, unnest(l) as performance_cap from (select window_size, mode, list_distinct(list_transform(quantile_cont(signal, [{_Q}]), lambda x: round(x, 6))) as l from sig where signal is not null and drift is not null group by window_size, mode)), "
          "prated as (select window_size, mode, performance_cap, round(avg((drift > 0.2 or signal > performance_cap)::int), 6) as alert_rate from pc join (from sig where signal is not null and drift is not null) using (window_size, mode) group by all), "
          f"tuned as ({sql.best('select *, alert_rate <= 0.05 + 1e-12 as feasible from prated', 'window_size, mode', 'feasible desc, performance_cap')})")


def _pack_checks(spark, sf_dir):
    g, replayed = grid(spark, sf_dir), settled(log(spark, sf_dir), "replay", small=False)
    tuned = monitor.tune_performance_cap(settled(monitor.window_metrics(replayed, SIZES), "windows", small=False)).withColumn("coverage_cap", F.lit(0.2))
    segments = policy.schedule(policy.utility_default(policy.utilities(g, sql.COSTS)))
    return config.validate_pack(config.pack(spark), policy.dual_modes(g), tuned, segments, conforming(g, replayed))


@query(with_(sql.SCORED, _DUAL, sql.REPLAY_ROWS, sql.windows(sizes=SIZES), _SIG, _TUNED, _PACK) + "select check_name, coalesce(passed, false) as passed from checks")
def config_pack(spark, sf_dir):
    """A deployment document against the modes, tuned caps, cost schedule and replay that the tables give."""
    return _pack_checks(spark, sf_dir).select("check_name", "passed")
