"""SQL texts for another engine that the queries' results are compared with."""

from __future__ import annotations

from ..functions.metrics import EDGES
from ..sources.views import THRESHOLDS

OOF = """oof as (select *, (a_prob + b_prob) / 2.0::double as stacked_prob,
  case when (h % 1000) / 1000.0::double < 0.1::double + 0.5::double * (0.6::double * a_prob + 0.4::double * b_prob) then 1 else 0 end as label
  from (select event_id, ts, 'd' || (user_id % 3) as domain, user_id as source_id, value / (value + 50.0::double) as a_prob,
  json_extract_string(props, '$.k')::double / 100.0::double as b_prob, hour(ts) / 24.0::double as base_prob,
  ('0x' || substr(md5('label|' || event_id), 1, 8))::bigint as h from events))"""
_AFFINE = "case when method = 'affine' then 0.1::double + 0.5::double * {0} else {0} end as {0}"
CAL = f"""cal as (select event_id, domain, source_id, label, method, {", ".join(_AFFINE.format(c) for c in ("a_prob", "b_prob", "stacked_prob"))}
  from oof, (values ('raw'), ('affine')) m(method))"""
EXPR = "expr as (select l_orderkey as cell_id, l_partkey as gene_id, sum(l_quantity) as value from lineitem group by all)"
STATS = """stats as (select gene_id, s / n as mean, greatest(q / n - (s / n) * (s / n), 0) as variance, d / n as detection from
  (select gene_id, sum(value) as s, sum(value * value) as q, count(*) filter (value > 0) as d from expr group by gene_id),
  (select count(distinct cell_id)::double as n from expr))"""
POSITIVES = """positives as (select distinct a.l_partkey as source, b.l_partkey as target from lineitem a join lineitem b using (l_orderkey)
  where a.l_partkey % 20 = 0 and a.l_partkey <> b.l_partkey)"""
NEGATIVES = """srcs as (select source, row_number() over (order by ('0x' || substr(md5(source::varchar), 1, 8))::bigint % 1024, source) - 1 as i from (select distinct source from positives)),
  tgts as (select target, row_number() over (order by ('0x' || substr(md5(target::varchar), 1, 8))::bigint % 1024, target) - 1 as i from (select distinct target from positives)),
  facts as (select (select count(*) from srcs) as s, (select count(*) from tgts) as t, (select count(*) from positives) as p),
  drawn as (select source, target, min(d) as d from (select d, ('0x' || substr(h, 1, 8))::bigint % s as i, ('0x' || substr(h, 9, 8))::bigint % t as j from
    (select d, md5('42|' || d) as h from range((select 16 * count(*) from positives)) r(d)), facts) x join srcs on srcs.i = x.i join tgts on tgts.i = x.j group by all),
  listed as (select source, target, d from drawn, facts where s * t > 16 * p union all
    select source, target, ('0x' || substr(md5('42|' || source || '|' || target), 1, 8))::bigint from srcs, tgts, facts where s * t <= 16 * p),
  negatives as (select source, target from listed where source <> target and (source, target) not in (select (source, target) from positives)
    order by d, source, target limit (select 3 * count(*) from positives))"""
VECS = "vecs as (select vec_id, label, embedding::double[] as v from embeddings)"
VPAIRS = """vpairs as (select a.vec_id as source_idx, b.vec_id as target_idx, a.vec_id % 25 as source_id, case when a.label = b.label then 1 else 0 end as label, a.v as a, b.v as b
  from vecs a join vecs b on b.vec_id - a.vec_id between 1 and 20)"""


def auroc(src: str, keys: str, y: str, p: str, name: str = "auroc") -> str:
    by = f"partition by {keys}" if keys else ""
    head, tail = (f"{keys}, ", f"group by {keys}") if keys else ("", "")
    also = f"{keys}, {p}" if keys else p
    return f"""select {head}((sum(case when {y} = 1 then rk end) - sum({y}) * (sum({y}) + 1) / 2.0::double) / nullif(sum({y}) * (count(*) - sum({y})), 0))::double as {name}
      from (select *, rank() over ({by} order by {p}) + (count(*) over (partition by {also}) - 1) / 2.0::double as rk from {src} where {p} is not null) {tail}"""


def aupr(src: str, keys: str, y: str, p: str, name: str = "aupr") -> str:
    return f"""select {keys}, case when max(tp_all) > 0 and max(fp_all) > 0 then sum(pos / tp_all * tp / (tp + fp)) end as {name} from (
      select {keys}, pos, sum(pos) over (partition by {keys}) as tp_all, sum(neg) over (partition by {keys}) as fp_all,
        sum(pos) over (partition by {keys} order by x desc) as tp, sum(neg) over (partition by {keys} order by x desc) as fp
      from (select {keys}, {p} as x, sum({y})::double as pos, sum(1 - {y})::double as neg from {src} group by {keys}, x)) group by {keys}"""


def bin_of(p: str, closed: str = "left") -> str:
    if closed == "left":
        return " + ".join(f"({p} >= {e!r}::double)::int" for e in EDGES[1:-1])
    return "least(greatest(" + " + ".join(f"({p} > {e!r}::double)::int" for e in EDGES) + " - 1, 0), 9)"


def ece(src: str, keys: str, y: str, p: str, name: str = "ece", closed: str = "left") -> str:
    return f"""select {keys}, sum(n * abs(acc - conf)) / sum(n) as {name} from (select {keys}, {bin_of(p, closed)} as bin, count(*) as n, avg({y}) as acc, avg({p}) as conf
      from {src} group by {keys}, bin) group by {keys}"""


def summary(src: str, keys: str, y: str, p: str, prefix: str = "") -> str:
    return f"""select * from (select {keys}, avg(({p} - {y}) * ({p} - {y})) as {prefix}brier from {src} group by {keys})
      left join ({auroc(src, keys, y, p, prefix + "auc")}) using ({keys}) left join ({ece(src, keys, y, p, prefix + "ece")}) using ({keys})"""


BASED = f"""auc_a as ({auroc("cal", "domain, method", "label", "a_prob", "auc_a")}), auc_b as ({auroc("cal", "domain, method", "label", "b_prob", "auc_b")}),
  based as (select cal.*, case when auc_a >= auc_b then 'a' else 'b' end as best_single_model, case when auc_a >= auc_b then a_prob else b_prob end as best_prob
  from cal join auc_a using (domain, method) join auc_b using (domain, method))"""
_M = ("auc", "ece", "brier")
def grid_of(cal: str, thresholds) -> str:
    """The candidate grid over the CTE ``cal``, whose text ends ``cal``."""
    return f"""{cal}, {BASED},
  long as (select based.*, threshold, (abs(b_prob - a_prob) >= threshold)::int as referred, case when abs(b_prob - a_prob) >= threshold then stacked_prob else best_prob end as policy_prob
    from based, (values {", ".join(f"({t!r}::double)" for t in thresholds)}) t(threshold)),
  grid as (select domain, method, threshold, best_single_model, n, n_positive, n_referred, round(coverage, 6) as coverage,
    {", ".join(f"round({p}_{m}, 6) as {p}_{m}" for p in ("policy", "best") for m in _M)}, {", ".join(f"round(policy_{m} - best_{m}, 6) + 0.0::double as delta_{m}" for m in _M)}
    from (select domain, method, threshold, count(*) as n, sum(label)::bigint as n_positive, sum(referred)::bigint as n_referred, avg(referred) as coverage, any_value(best_single_model) as best_single_model
      from long group by all) join ({summary("long", "domain, method, threshold", "label", "policy_prob", "policy_")}) using (domain, method, threshold)
      join ({summary("based", "domain, method", "label", "best_prob", "best_")}) using (domain, method))"""


GRID = grid_of(f"{OOF}, {CAL}", THRESHOLDS)


def best(src: str, keys: str, order: str, k: int = 1) -> str:
    return f"select * exclude (_r) from (select *, row_number() over (partition by {keys} order by {order}) as _r from ({src})) where _r <= {k}"


def relaxed(src: str, keys: str, ok: str) -> str:
    return f"""select * exclude (_ok, _any), _any = 0 as fallback from (select *, max(_ok) over (partition by {keys}) as _any from
      (select *, coalesce(({ok})::int, 0) as _ok from ({src}))) where _ok = 1 or _any = 0"""


RANKING = best(relaxed(f"select * exclude (fallback) from ({relaxed('grid', 'domain', 'coverage >= 0.05')})", "domain", "delta_ece <= 0.02"), "domain", "delta_auc desc, delta_ece, coverage desc, method, threshold")
RELIABILITY = best(relaxed(f"select * exclude (fallback) from ({relaxed('grid', 'domain', 'coverage >= 0.05')})", "domain", "delta_auc >= -0.005"), "domain", "delta_ece, delta_auc desc, coverage desc, method, threshold")
ACROSS = """select method, threshold, count(distinct domain) as n_domains, round(avg(delta_auc), 6) as mean_delta_auc, round(avg(delta_ece), 6) as mean_delta_ece,
  round(avg(delta_brier), 6) as mean_delta_brier, min(delta_auc) as min_delta_auc, max(delta_ece) as max_delta_ece, round(avg(coverage), 6) as mean_coverage from {0} group by method, threshold"""
DEFAULT = f"""select * exclude (one) from ({best(relaxed("select *, 1 as one from (" + ACROSS.format("(from grid where coverage >= 0.05)") + ")", "one", "min_delta_auc >= 0 and max_delta_ece <= 0.02"), "one", "n_domains desc, mean_delta_auc desc, mean_delta_ece, mean_coverage desc, method, threshold")})"""
COSTS = (0.0, 0.0025, 0.005, 0.0075, 0.01, 0.0125, 0.015, 0.0175, 0.02, 0.025, 0.03)
SCORED = f"""{GRID}, scored as (select grid.*, cost, round(delta_auc - cost * coverage, 6) as utility from grid, (values {", ".join(f"({x!r}::double)" for x in COSTS)}) t(cost))"""
UBEST = best("from scored", "cost, domain", "utility desc, delta_auc desc, coverage, method, threshold")
UDEFAULT = f"""select * exclude (fallback) from ({best(relaxed('''select cost, method, threshold, count(distinct domain) as n_domains, round(avg(utility), 6) as mean_utility, min(utility) as min_utility,
  round(avg(delta_auc), 6) as mean_delta_auc, round(avg(coverage), 6) as mean_coverage from scored group by all''', 'cost', 'n_domains = (select count(distinct domain) from scored)'), 'cost', 'mean_utility desc, min_utility desc, mean_coverage, method, threshold')})"""
SCHEDULE = f"""select min(cost) as lambda_start, max(cost) as lambda_end, any_value(method) as method, any_value(threshold) as threshold, any_value(rule) as rule,
  round(avg(mean_utility), 6) as mean_utility, round(avg(mean_coverage), 6) as mean_coverage from (select *, sum(new) over (order by cost) as island from
  (select *, case when lag(rule) over (order by cost) = rule then 0 else 1 end as new from (select *, printf('%s@%.2f', method, threshold) as rule from ({UDEFAULT})))) group by island"""
REPLAY_ROWS = """replay as (select event_id, domain, case when method = 'raw' then 'ranking_first' else 'reliability_first' end as mode, method, label,
  case when abs(b_prob - a_prob) >= 0.05::double then stacked_prob else best_prob end as policy_prob, (abs(b_prob - a_prob) >= 0.05::double)::int as referral_flag from based)"""
REPLAY = f"{OOF}, {CAL}, {BASED}, {REPLAY_ROWS}"


def windows(src: str = "replay", sizes=(100, 250, 500), extra: str = "", order: str = "event_id") -> str:
    """CTEs base, cut and win over a replay log."""
    k = f"domain, mode{extra}"
    return f"""base as (select * from (select domain, mode, avg(referral_flag) as baseline_coverage from replay group by all) join ({summary("replay", "domain, mode", "label", "policy_prob", "baseline_")}) using (domain, mode)),
  cut as (select * from (select {src}.*, window_size, (row_number() over (partition by window_size, {k} order by {order}) - 1) // window_size as window_id,
    count(*) over (partition by window_size, {k}) // window_size as n_full from {src}, (values {", ".join(f"({s})" for s in sizes)}) s(window_size)) where window_id < n_full),
  win as (select *, coverage_alert or performance_alert as any_alert from (select *, case when mode = 'ranking_first' then ranking_alert else reliability_alert end as performance_alert from (
    select *, coalesce(abs(coverage_drift) > 0.2, false) as coverage_alert, coalesce(auc_drop > 0.05, false) as ranking_alert, coalesce(ece_uplift > 0.05, false) as reliability_alert from (
    select window_size, {k}, window_id, n, round(window_auc, 6) as window_auc, round(window_ece, 6) as window_ece, round(window_coverage, 6) as window_coverage, round(baseline_auc - window_auc, 6) as auc_drop,
      round(window_ece - baseline_ece, 6) as ece_uplift, round((window_coverage - baseline_coverage) / case when baseline_coverage > 0 then greatest(baseline_coverage, 1e-8) end, 6) as coverage_drift
    from (select window_size, {k}, window_id, count(*) as n, avg(referral_flag) as window_coverage from cut group by all)
      join ({summary("cut", f"window_size, {k}, window_id", "label", "policy_prob", "window_")}) using (window_size, {k}, window_id) join base using (domain, mode)))))"""


def with_(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def sql_hash(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::bigint"


def _solved(d: int, source: str) -> str:
    """A subquery that solves h x = g for ``d`` unknowns by eliminating one after the other; its columns are those named in ``source`` and x0, x1, ..."""
    cells = [(i, j) for i in range(d) for j in range(d)]
    for k in range(d):
        kept = ", ".join([*(f"h{i}{j} - h{i}{k} / h{k}{k} * h{k}{j} as h{i}{j}" if i != k else f"h{i}{j}" for i, j in cells), *(f"g{i} - h{i}{k} / h{k}{k} * g{k} as g{i}" if i != k else f"g{i}" for i in range(d))])
        source = f"(select fit, {kept} from {source})"
    return f"(select fit, {', '.join(f'g{i} / h{i}{i} as x{i}' for i in range(d))} from {source})"


def cross_predicted(name: str, rows: str, groups: str, key: str, models: dict[str, list[str]], folds: int = 5, steps: int = 12, dealt: bool = False) -> str:
    """CTEs name_k (groups, n, n_positive, k) and name_p (groups, key, label, model, p): out-of-fold probabilities of balanced logistic fits with standardised features
    and half the squared slopes, by Newton steps; the last unknown is the intercept.  ``dealt``: the rows have their fold and the number k of folds."""
    d = max(map(len, models.values()))
    xs, zs = [f"x{i}" for i in range(d)], [*(f"z{i}" for i in range(d)), "1.0::double"]
    own = ", ".join(f"r.{g.strip()}" for g in groups.split(","))
    picked = ", ".join(f"case model {' '.join(f'when {m!r} then {fs[i]}' for m, fs in models.items() if i < len(fs))} else 0 end as x{i}" for i in range(d))
    line = " + ".join(f"b{i} * {z}" for i, z in enumerate(zs))
    fit = f"{groups}, model, held"
    gradient = [f"sum(w * (p - label) * {z})" + (f" + b{i}" if i < d else "") + f" as g{i}" for i, z in enumerate(zs)]
    hessian = [f"sum(w * p * (1 - p) * {zs[i]} * {zs[j]})" + (" + 1" if i == j < d else "") + f" as h{i}{j}" for i in range(d + 1) for j in range(d + 1)]
    betas = [f"b{i}" for i in range(d + 1)]
    at = "{" + ", ".join(f"'{c}': {c}" for c in [c.strip() for c in fit.split(",")] + ["it", *betas]) + "} as fit"
    sums = f"(select {at}, {', '.join(gradient + hessian)} from (select *, 1 / (1 + exp(-({line}))) as p from {name}_n join {name}_z using ({fit}) where it < {steps} and fold <> held) group by {fit}, it, {', '.join(betas)})"
    dealt_ = f"{name}_f as (from {rows})" if dealt else f"""{name}_k as (select {groups}, count(*) as n, sum(label)::bigint as n_positive, least({folds}, sum(label), count(*) - sum(label)) as k from {rows} group by all),
  {name}_f as (select r.*, k, (row_number() over (partition by {own}, r.label order by {sql_hash("'42'", "0", key)}, {key}) - 1) % k as fold from {rows} r join {name}_k using ({groups}) where k >= 2)"""
    return f"""{dealt_},
  {name}_t as (select {groups}, {key}, label, fold, model, held::int as held, {picked} from {name}_f, range({folds}) h(held), (values {", ".join(f"({m!r})" for m in models)}) m(model) where held < k),
  {name}_s as (select {fit}, {", ".join(f"avg({x}) as m{i}, case when stddev_pop({x}) > 1e-12 then stddev_pop({x}) else 1 end as s{i}" for i, x in enumerate(xs))}, count(*) / 2.0::double / greatest(sum(label), 1) as w1, count(*) / 2.0::double / greatest(sum(1 - label), 1) as w0 from {name}_t where fold <> held group by all),
  {name}_z as (select {fit}, {key}, label, fold, {", ".join(f"({x} - m{i}) / s{i} as z{i}" for i, x in enumerate(xs))}, case when label = 1 then w1 else w0 end as w from {name}_t join {name}_s using ({fit})),
  {name}_n as (select {fit}, 0 as it, {", ".join(f"0.0::double as {b}" for b in betas)} from {name}_s union all
    select {", ".join(f"fit.{c.strip()}" for c in fit.split(","))}, fit.it + 1, {", ".join(f"fit.{b} - x{i}" for i, b in enumerate(betas))} from {_solved(d + 1, sums)}),
  {name}_p as (select {groups}, {key}, label, model, 1 / (1 + exp(-({line}))) as p from {name}_z join {name}_n using ({fit}) where it = {steps} and fold = held)"""


def incremental(name: str, groups: str, features: list[str]) -> str:
    """Gains over the model ``base`` from the CTEs of :func:`cross_predicted`; too small groups have NULLs."""
    of = lambda m: f"case when n >= 8 and n_positive >= 2 and n - n_positive >= 2 then max(auc) filter (model = '{m}') end"
    columns = [f"round({of(m)}, 6) as auc_{m}" for m in ("base", *features)] + [f"round({of(m)} - {of('base')}, 6) as gain_{m}" for m in features]
    return f"select {groups}, n, n_positive, {', '.join(columns)} from {name}_k left join ({auroc(f'{name}_p', f'{groups}, model', 'label', 'p', 'auc')}) using ({groups}) group by {groups}, n, n_positive"
