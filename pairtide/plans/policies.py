"""Queries on referral policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_number, six
from ..operators import config, policy
from ..sources import views
from ..sources.tables import settled
from . import sql
from .registry import query
from .sql import GRID, REPLAY, SCORED, sql_hash, with_


def grid(spark, sf_dir):
    """One row per domain, method and threshold."""
    return settled(policy.candidates(views.calibrated(views.scored_pairs(spark, sf_dir)), views.THRESHOLDS), "grid")


def scored(spark, sf_dir):
    return policy.utilities(grid(spark, sf_dir), sql.COSTS)


@query(with_(GRID) + "from grid")
def candidate_grid(spark, sf_dir):
    return policy.candidates(views.calibrated(views.scored_pairs(spark, sf_dir)), views.THRESHOLDS)


@query(with_(GRID) + f"select 'ranking_first' as objective, * from ({sql.RANKING}) union all by name select 'reliability_first' as objective, * from ({sql.RELIABILITY})")
def objective_selection(spark, sf_dir):
    g = grid(spark, sf_dir)
    return policy.ranking_first(g).withColumn("objective", F.lit("ranking_first")).unionByName(policy.reliability_first(g).withColumn("objective", F.lit("reliability_first")))


@query(with_(GRID) + sql.DEFAULT)
def default_policy(spark, sf_dir):
    return policy.default_policy(grid(spark, sf_dir))


@query(with_(GRID) + f"""select o.domain, o.method, o.threshold, o.delta_auc, o.delta_ece, g.delta_auc as default_delta_auc, g.delta_ece as default_delta_ece, round(o.delta_auc - g.delta_auc, 6) as auc_gap, round(o.delta_ece - g.delta_ece, 6) as ece_gap
  from ({sql.RANKING}) o join ({sql.DEFAULT}) d on true join grid g on g.domain = o.domain and g.method = d.method and g.threshold = d.threshold""")
def default_gap(spark, sf_dir):
    return policy.default_gap(grid(spark, sf_dir))


@query(with_(GRID) + sql.ACROSS.format("(from grid where coverage >= 0.05)"))
def default_grid_summary(spark, sf_dir):
    return policy.across_domains(grid(spark, sf_dir).where("coverage >= 0.05"))


@query(with_(SCORED) + sql.UBEST)
def utility_sweep(spark, sf_dir):
    return policy.utility_best(scored(spark, sf_dir))


@query(with_(SCORED) + sql.UDEFAULT)
def utility_default(spark, sf_dir):
    return policy.utility_default(scored(spark, sf_dir))


@query(with_(SCORED) + f"""select b.cost, b.domain, b.utility as best_utility, s.utility as default_utility, round(b.utility - s.utility, 6) as gap from ({sql.UBEST}) b join ({sql.UDEFAULT}) d using (cost)
  join scored s on s.cost = b.cost and s.domain = b.domain and s.method = d.method and s.threshold = d.threshold""")
def utility_gap(spark, sf_dir):
    return policy.utility_gap(scored(spark, sf_dir))


@query(with_(SCORED) + f"select method, threshold, count(*) as n_lambdas, min(cost) as min_lambda, max(cost) as max_lambda from ({sql.UDEFAULT}) group by method, threshold")
def utility_stability(spark, sf_dir):
    return policy.stability(policy.utility_default(scored(spark, sf_dir)))


@query(with_(SCORED, "rules as (select cost, domain, utility, coverage, printf('%s@%.2f', method, threshold) as rule from scored)") + sql.best(
    """select cost, rule_1, rule_2, count(*) as n_domains, round(avg(u), 6) as mean_utility, min(u) as min_utility, round(avg(c), 6) as mean_coverage from (
  select x.cost, x.domain, x.rule as rule_1, y.rule as rule_2, case when x.utility > y.utility or (x.utility = y.utility and x.coverage <= y.coverage) then x.utility else y.utility end as u,
  case when x.utility > y.utility or (x.utility = y.utility and x.coverage <= y.coverage) then x.coverage else y.coverage end as c
  from rules x join rules y on x.cost = y.cost and x.domain = y.domain and x.rule <= y.rule) group by all""", "cost", "n_domains desc, mean_utility desc, min_utility desc, mean_coverage, rule_1, rule_2"))
def two_rule(spark, sf_dir):
    return policy.two_rules(scored(spark, sf_dir))


_DUAL = f"""dual as (select domain, 'ranking_first' as mode, method, threshold, coverage, policy_auc, policy_ece, policy_brier from ({sql.best("from grid where threshold = 0.05", "domain", "policy_auc desc, policy_ece, method")})
  union all select domain, 'reliability_first' as mode, method, threshold, coverage, policy_auc, policy_ece, policy_brier from ({sql.best("select * from (select *, max(policy_auc) over (partition by domain) as top from grid where threshold = 0.05) where policy_auc >= top - 0.005::double", "domain", "policy_ece, policy_auc desc, method")}))"""


@query(with_(GRID, _DUAL) + "from dual")
def dual_mode(spark, sf_dir):
    return policy.dual_modes(grid(spark, sf_dir))


@query(with_(GRID, _DUAL) + "select mode, count(distinct domain) as n_domains, round(avg(coverage), 6) as mean_coverage, round(avg(policy_auc), 6) as mean_policy_auc, round(avg(policy_ece), 6) as mean_policy_ece, round(avg(policy_brier), 6) as mean_policy_brier from dual group by mode")
def mode_summary(spark, sf_dir):
    return policy.mode_summary(policy.dual_modes(grid(spark, sf_dir)))


@query(with_(SCORED) + sql.SCHEDULE)
def cost_schedule(spark, sf_dir):
    return policy.schedule(policy.utility_default(scored(spark, sf_dir)))


@query(with_(SCORED, f"sched as ({sql.SCHEDULE})") + """select lambda_start, lambda_end, rule, round(case when step > 1e-12 then step else 0 end, 6)::double as gap, round(case when -step > 1e-12 then -step else 0 end, 6)::double as overlap from
  (select *, coalesce(lambda_start - lag(lambda_end) over (order by lambda_start, lambda_end), 0) as step from sched)""")
def schedule_integrity(spark, sf_dir):
    return policy.schedule_integrity(policy.schedule(policy.utility_default(scored(spark, sf_dir))))


_LOOK = "(values (0.0::double), (0.001), (0.006), (0.0125), (0.014), (0.015), (0.02), (0.03), (0.04)) t(cost)"


@query(with_(SCORED, f"sched as ({sql.SCHEDULE})") + f"select cost, rule from {_LOOK} left join (select *, lead(lambda_start) over (order by lambda_start, lambda_end) as following from sched) on cost >= lambda_start and case when following is null then cost <= lambda_end else cost < following end")
def lambda_lookup(spark, sf_dir):
    costs = spark.createDataFrame([(x,) for x in (0.0, 0.001, 0.006, 0.0125, 0.014, 0.015, 0.02, 0.03, 0.04)], "cost double")
    return policy.rule_at(costs, policy.schedule(policy.utility_default(scored(spark, sf_dir)))).select("cost", "rule")


def _own_schedule(version: int, least: str) -> str:
    best = sql.best(f"from scored where coverage >= {least}", "cost, domain", "utility desc, delta_auc desc, coverage, method, threshold")
    return f"""select domain, {version} as version, min(cost) as lambda_start, max(cost) as lambda_end, any_value(rule) as rule from (select *, sum(new) over (partition by domain order by cost) as island from
      (select *, case when lag(rule) over (partition by domain order by cost) = rule then 0 else 1 end as new from (select *, printf('%s@%.2f', method, threshold) as rule from ({best})))) group by domain, island"""


_ASKED = f"asked as (select event_id, domain, (event_id % 2)::int as version, h % 400 / 10000.0::double as cost from (select event_id, domain, {sql_hash(repr('cost'), 'event_id')} as h from oof))"


@query(with_(SCORED, f"own as ({_own_schedule(0, '0')} union all {_own_schedule(1, '0.05')})", _ASKED) + """select event_id, domain, version, cost, rule from asked left join
  (select *, lead(lambda_start) over (partition by domain, version order by lambda_start, lambda_end) as following from own) using (domain, version) where rule is null or (cost >= lambda_start and case when following is null then cost <= lambda_end else cost < following end)
  union all select event_id, domain, version, cost, null from asked where cost > (select max(lambda_end) from own where own.domain = asked.domain and own.version = asked.version)""")
def event_rules(spark, sf_dir):
    """The rule that each event's cost has in the schedule of its domain and version: of all candidates, or of those with enough coverage."""
    g, schedules = grid(spark, sf_dir), None
    for version, least in enumerate((0.0, 0.05)):
        best = policy.utility_best(policy.utilities(g, sql.COSTS, least)).withColumn("mean_utility", F.col("utility")).withColumn("mean_coverage", F.col("coverage"))
        own = policy.schedule(best, ["domain"]).withColumn("version", F.lit(version))
        schedules = own if schedules is None else schedules.unionByName(own)
    costs = views.scored_pairs(spark, sf_dir).select("event_id", "domain", (F.col("event_id") % 2).cast("int").alias("version"), (hash_number("cost", F.col("event_id")) % 400 / F.lit(10000.0)).alias("cost"))
    return policy.rule_at(costs, settled(schedules, "schedules"), ["domain", "version"]).select("event_id", "domain", "version", "cost", "rule")


@query(with_(SCORED, f"rules as (select distinct method, threshold from ({sql.UDEFAULT}))") + """select method, threshold, count(*) as n_domains, round(avg(policy_auc), 6) as mean_auc, round(avg(policy_ece), 6) as mean_ece, round(avg(coverage), 6) as mean_coverage
  from grid join rules using (method, threshold) group by all""")
def rule_replay(spark, sf_dir):
    g = grid(spark, sf_dir)
    rules = policy.utility_default(policy.utilities(g, sql.COSTS)).select("method", "threshold").dropDuplicates()
    return g.join(F.broadcast(rules), ["method", "threshold"]).groupBy("method", "threshold").agg(
        F.count("*").alias("n_domains"), six(F.avg("policy_auc")).alias("mean_auc"), six(F.avg("policy_ece")).alias("mean_ece"), six(F.avg("coverage")).alias("mean_coverage")
    )


def log(spark, sf_dir):
    return policy.replay(views.calibrated(views.scored_pairs(spark, sf_dir)))


@query(with_(GRID, sql.REPLAY_ROWS) + f"""select domain, mode, n, n_mismatch, n_mismatch = 0 as exact_match, {", ".join(f"round(seen.{m} - policy_{m}, 6) + 0.0::double as {m}_difference" for m in ("auc", "ece", "brier"))}, round(seen.coverage - grid.coverage, 6) + 0.0::double as coverage_difference from
  (select * from (select r.domain, r.mode, r.method, count(*) as n, avg(referral_flag) as coverage,
    count(*) filter (abs(r.policy_prob - case when abs(b_prob - a_prob) >= 0.05::double then stacked_prob else best_prob end) > 1e-12) as n_mismatch from replay r join based using (event_id, method) group by all)
    join ({sql.summary("replay", "domain, mode", "label", "policy_prob")}) using (domain, mode)) seen join (select * exclude (n) from grid where threshold = 0.05) grid using (domain, method)""")
def conformance(spark, sf_dir):
    return conforming(grid(spark, sf_dir), log(spark, sf_dir))


def conforming(grid_, log_):
    mode = F.when(F.col("method") == "raw", "ranking_first").otherwise("reliability_first")
    expected = grid_.where("threshold = 0.05").select("domain", mode.alias("mode"), "policy_auc", "policy_ece", "policy_brier", F.col("coverage").alias("expected_coverage"))
    out = policy.conformance(log_, expected)
    return out.select("domain", "mode", "n", "n_mismatch", "exact_match", "auc_difference", "ece_difference", "brier_difference", "coverage_difference")


_WATCH = "(d -> 'monitoring' ->> '{0}')::double"
_CHECKS = f"""doc as (select '{config.DOCUMENT}'::json as d), checks as (select unnest([
    {{'check_name': 'has_version', 'passed': d ->> 'version' is not null}}, {{'check_name': 'default_mode_known', 'passed': d ->> 'default_mode' in ('ranking_first', 'reliability_first')}},
    {{'check_name': 'rules_present', 'passed': json_array_length(d -> 'cost_rules') >= 1}},
    {{'check_name': 'rules_ordered', 'passed': list_bool_and(list_transform((d -> 'cost_rules')::json[], lambda r: (r ->> 'lambda_min')::double < (r ->> 'lambda_max')::double))}},
    {{'check_name': 'rules_contiguous', 'passed': case when json_array_length(d -> 'cost_rules') > 1 then list_bool_and(list_transform(range(1, json_array_length(d -> 'cost_rules')::bigint), lambda i: abs((d -> 'cost_rules' -> (i - 1)::int ->> 'lambda_max')::double - (d -> 'cost_rules' -> i::int ->> 'lambda_min')::double) <= 1e-8 + 1e-5 * abs((d -> 'cost_rules' -> i::int ->> 'lambda_min')::double))) else true end}},
    {{'check_name': 'rules_start_at_zero', 'passed': abs((d -> 'cost_rules' -> 0 ->> 'lambda_min')::double) <= 1e-8}}, {{'check_name': 'window_positive', 'passed': {_WATCH.format('window_size')} > 0}},
    {{'check_name': 'caps_positive', 'passed': {_WATCH.format('coverage_cap')} > 0 and {_WATCH.format('auc_drop_cap')} > 0 and {_WATCH.format('ece_uplift_cap')} > 0}},
    {{'check_name': 'soft_within_windows', 'passed': {_WATCH.format('soft_alerts')} <= {_WATCH.format('soft_windows')}}}, {{'check_name': 'hard_consecutive', 'passed': coalesce({_WATCH.format('hard_consecutive')}, 2) >= 2}}], recursive := true) from doc
  union all select mode || '_threshold', bool_and(abs(threshold - (d -> 'modes' -> mode ->> 'threshold')::double) <= 1e-8 + 1e-5 * abs((d -> 'modes' -> mode ->> 'threshold')::double)) from dual, doc group by mode
  union all select mode || '_method', bool_and(method = (d -> 'modes' -> mode ->> 'method')) from dual, doc group by mode)"""


@query(with_(GRID, _DUAL, _CHECKS) + "select check_name, passed from checks")
def config_validation(spark, sf_dir):
    return config.validate(config.document(spark), policy.dual_modes(grid(spark, sf_dir))).select("check_name", "passed")


@query(with_(GRID, _DUAL, _CHECKS) + "select count(*) as n_checks, count_if(passed)::bigint as n_passed, bool_and(passed) as all_passed from checks")
def config_validation_summary(spark, sf_dir):
    return config.validation_summary(config.validate(config.document(spark), policy.dual_modes(grid(spark, sf_dir))))
