"""Queries on ranking and calibration metrics of scored pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics, scalars
from ..functions.scalars import six
from ..operators import policy, ranking
from ..sources import views
from ..sources.tables import settled
from . import sql
from .registry import query
from .sql import CAL, OOF, with_


def _stacked(spark, sf_dir, *more):
    """Scores of both models and the stack in one column, by model; ``more`` columns go along."""
    return views.scored_pairs(spark, sf_dir).select(
        "event_id", "domain", "source_id", "label", *more,
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_prob").alias("p")) for m in ("a", "b", "stacked", "base")])).alias("s"),
    ).select("event_id", "domain", "source_id", "label", *more, "s.model", "s.p")


LONG = "long as (" + " union all ".join(f"select event_id, domain, source_id, label, '{m}' as model, {m}_prob as p from oof" for m in ("a", "b", "stacked", "base")) + ")"


@query(with_(OOF, CAL, sql.BASED, "policy as (select domain, label, (abs(b_prob - a_prob) >= 0.05::double)::int as referred, case when abs(b_prob - a_prob) >= 0.05::double then stacked_prob else best_prob end as p from based where method = 'raw')")
       + f"select domain, n, n_referred, round(coverage, 6) as coverage, round(auc, 6) as auc, round(ece, 6) as ece, round(brier, 6) as brier from (select domain, count(*) as n, sum(referred)::bigint as n_referred, avg(referred) as coverage from policy group by domain) join ({sql.summary('policy', 'domain', 'label', 'p')}) using (domain)")
def policy_metrics(spark, sf_dir):
    log = policy.replay(views.scored_pairs(spark, sf_dir).withColumn("method", F.lit("raw")))
    counts = log.groupBy("domain").agg(F.count("*").alias("n"), F.sum("referral_flag").alias("n_referred"), six(F.avg(F.col("referral_flag").cast("double"))).alias("coverage"))
    out = metrics.summary(log, ["domain"], "label", "policy_prob")
    return counts.join(out.select("domain", *[six(F.col(c)).alias(c) for c in ("auc", "ece", "brier")]), "domain")


@query(with_(OOF, LONG) + f"select domain, model, round(auroc, 6) as auroc from ({sql.auroc('long', 'domain, model', 'label', 'p')})")
def auroc_by_domain(spark, sf_dir):
    out = metrics.auroc(_stacked(spark, sf_dir), ["domain", "model"], "label", "p")
    return out.select("domain", "model", six(F.col("auroc")).alias("auroc"))


@query(with_(OOF, LONG) + f"select domain, model, round(aupr, 6) as aupr from ({sql.aupr('long', 'domain, model', 'label', 'p')})")
def aupr_by_domain(spark, sf_dir):
    out = metrics.average_precision(_stacked(spark, sf_dir), ["domain", "model"], "label", "p")
    return out.select("domain", "model", six(F.col("aupr")).alias("aupr"))


@query(with_(OOF, LONG) + f"select domain, model, round(ece, 6) as ece from ({sql.ece('long', 'domain, model', 'label', 'p')})")
def ece_left(spark, sf_dir):
    return metrics.ece(_stacked(spark, sf_dir), ["domain", "model"], "label", "p").select("domain", "model", six(F.col("ece")).alias("ece"))


@query(with_(OOF, LONG) + f"select domain, model, round(ece, 6) as ece from ({sql.ece('long', 'domain, model', 'label', 'p', closed='right')})")
def ece_right(spark, sf_dir):
    return metrics.ece(_stacked(spark, sf_dir), ["domain", "model"], "label", "p", closed="right").select("domain", "model", six(F.col("ece")).alias("ece"))


@query(with_(OOF, LONG) + f"""select domain, model, bin, coalesce(n, 0) as n, round(acc, 6) as acc, round(conf, 6) as conf from (select domain, model, unnest(range(10))::int as bin from (select distinct domain, model from long where model <> 'base'))
  left join (select domain, model, {sql.bin_of("p")} as bin, count(*) as n, avg(label) as acc, avg(p) as conf from long group by all) using (domain, model, bin)""")
def reliability_bins(spark, sf_dir):
    out = metrics.reliability(_stacked(spark, sf_dir).where("model <> 'base'"), ["domain", "model"], "label", "p")
    return out.select("domain", "model", "bin", "n", six(F.col("acc")).alias("acc"), six(F.col("conf")).alias("conf"))


@query(with_(OOF, LONG) + "select domain, model, count(*) as n, round(avg((p - label) * (p - label)), 6) as brier, round(avg(label), 6) as positive_rate, round(avg(p), 6) as mean_score from long group by all")
def brier_and_rates(spark, sf_dir):
    return _stacked(spark, sf_dir).groupBy("domain", "model").agg(
        F.count("*").alias("n"), six(metrics.brier(F.col("label"), F.col("p"))).alias("brier"), six(F.avg(F.col("label").cast("double"))).alias("positive_rate"), six(F.avg("p")).alias("mean_score")
    )


_SUBSETS = "sub as (select domain, 'all' as subset, a_prob, b_prob from oof union all select domain, 'positive', a_prob, b_prob from oof where label = 1 union all select domain, 'negative', a_prob, b_prob from oof where label = 0)"


@query(with_(OOF, _SUBSETS) + """select domain, subset, count(*) as n, round(case when count(*) >= 3 then corr(a_prob, b_prob) end, 6) as pearson, round(case when count(*) >= 3 then corr(ra, rb) end, 6) as spearman from
  (select *, rank() over (partition by domain, subset order by a_prob) + (count(*) over (partition by domain, subset, a_prob) - 1) / 2.0::double as ra,
  rank() over (partition by domain, subset order by b_prob) + (count(*) over (partition by domain, subset, b_prob) - 1) / 2.0::double as rb from sub) group by all""")
def pearson_spearman(spark, sf_dir):
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("label") == 1, "positive").otherwise("negative")))
    rows = views.scored_pairs(spark, sf_dir).select("domain", "a_prob", "b_prob", subset.alias("subset"))
    out = metrics.correlations(rows, ["domain", "subset"], "a_prob", "b_prob")
    return out.select("domain", "subset", "n", six(F.col("pearson")).alias("pearson"), six(F.col("spearman")).alias("spearman"))


def _disagreement(spark, sf_dir):
    pairs = views.scored_pairs(spark, sf_dir)
    spread = pairs.groupBy("domain").agg(*[f(c).alias(f"{n}_{c}") for c in ("a_prob", "b_prob") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)
    out = pairs.join(F.broadcast(spread), "domain")  # one row per domain
    return out.withColumn("disagreement", F.round(F.abs(z("a_prob") - z("b_prob")), 9))


DISAGREE = """dis as (select oof.*, round(abs(case when sa > 0 then (a_prob - ma) / sa else 0 end - case when sb > 0 then (b_prob - mb) / sb else 0 end), 9) as disagreement
  from oof join (select domain, avg(a_prob) as ma, stddev_pop(a_prob) as sa, avg(b_prob) as mb, stddev_pop(b_prob) as sb from oof group by domain) using (domain))"""
DECILES = """edges as (select domain, list_distinct(quantile_cont(disagreement, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as e from dis group by domain),
  dec as (select dis.*, greatest(len(list_filter(e, lambda x: x < disagreement)) - 1, 0)::int as decile from dis join edges using (domain))"""


@query(with_(OOF, DISAGREE) + "select domain, count(*) as n, round(avg(disagreement), 6) as mean, round(max(disagreement), 6) as max from dis group by domain")
def zscore_disagreement(spark, sf_dir):
    return _disagreement(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), six(F.avg("disagreement")).alias("mean"), six(F.max("disagreement")).alias("max"))


def _deciles(spark, sf_dir):
    return ranking.frequency_bins(_disagreement(spark, sf_dir), ["domain"], "disagreement", 10, "decile")


@query(with_(OOF, DISAGREE, DECILES) + "select domain, decile, count(*) as n, round(avg(label), 6) as positive_rate, round(avg(a_prob), 6) as mean_a, round(avg(b_prob), 6) as mean_b, round(avg(disagreement), 6) as mean_disagreement from dec group by all")
def disagreement_deciles(spark, sf_dir):
    return _deciles(spark, sf_dir).groupBy("domain", "decile").agg(
        F.count("*").alias("n"), six(F.avg(F.col("label").cast("double"))).alias("positive_rate"), six(F.avg("a_prob")).alias("mean_a"), six(F.avg("b_prob")).alias("mean_b"), six(F.avg("disagreement")).alias("mean_disagreement")
    )


def _enrichment(spark, sf_dir, least=8, least_top=2):
    counts = _deciles(spark, sf_dir).groupBy("domain", "source_id").agg(F.count("*").alias("n"), F.count_if(F.col("decile") == 9).alias("n_top"))
    total = counts.groupBy("domain").agg(F.sum("n").alias("_n"), F.sum("n_top").alias("_t"))
    out = counts.join(F.broadcast(total), "domain").where(f"n >= {least} and n_top >= {least_top}")
    share, top = F.col("n") / scalars.at_least(F.col("_n"), 1), F.col("n_top") / scalars.at_least(F.col("_t"), 1)
    return out.select("domain", "source_id", "n", "n_top", six(share).alias("share"), six(top).alias("top_share"), six(top / F.greatest(share, F.lit(1e-12))).alias("enrichment"))


def _enrich(least: int = 8, least_top: int = 2) -> str:
    return f"""counts as (select domain, source_id, count(*) as n, count(*) filter (decile = 9) as n_top from dec group by all),
  enr as (select domain, source_id, n, n_top, round(n / greatest(sn, 1), 6) as share, round(n_top / greatest(st, 1), 6) as top_share, round((n_top / greatest(st, 1)) / greatest(n / greatest(sn, 1), 1e-12), 6) as enrichment
  from counts join (select domain, sum(n)::bigint as sn, sum(n_top)::bigint as st from counts group by domain) using (domain) where n >= {least} and n_top >= {least_top})"""


_ENRICH = _enrich()


@query(with_(OOF, DISAGREE, DECILES, _ENRICH) + "from enr")
def source_enrichment(spark, sf_dir):
    return _enrichment(spark, sf_dir)


@query(with_(OOF, DISAGREE, DECILES, _ENRICH) + sql.best("from enr", "domain", "enrichment desc, n_top desc, source_id", 10))
def source_topk(spark, sf_dir):
    return ranking.best_rows(_enrichment(spark, sf_dir), ["domain"], F.desc("enrichment"), F.desc("n_top"), "source_id", k=10)


#: Rows that a source must have, and those among them in the top decile.
FLOORS = (20, 5)


@query(with_(OOF, DISAGREE, DECILES, _enrich(*FLOORS)) + "from enr")
def source_enrichment_supported(spark, sf_dir):
    """Enrichment of well supported sources only."""
    return _enrichment(spark, sf_dir, *FLOORS)


@query(with_(OOF, DISAGREE, DECILES, _ENRICH) + "select * exclude (_r) from (select *, row_number() over (partition by source_id order by enrichment desc, n_top desc, source_id, domain) as _r from enr) where _r = 1 order by enrichment desc, n_top desc, source_id, domain limit 25")
def global_source_topk(spark, sf_dir):
    """The 25 most enriched sources over all domains, each once with its best domain."""
    return ranking.global_top(_enrichment(spark, sf_dir), "source_id", F.desc("enrichment"), F.desc("n_top"), "source_id", "domain", k=25)


_TOP = "top as (select domain, source_id, row_number() over (partition by domain order by n desc, source_id) as r from (select domain, source_id, count(*) as n from oof group by all))"


@query(with_(OOF, _TOP) + """select domain, scenario, count(*) as n, sum(label)::bigint as n_positive from (select oof.domain, label, scenario from oof, (values (0), (5), (10), (20), (50)) s(scenario)
  where not exists (select 1 from top where top.domain = oof.domain and top.source_id = oof.source_id and r <= scenario)) group by all""")
def source_ablation_counts(spark, sf_dir):
    pairs = views.scored_pairs(spark, sf_dir)
    counts = pairs.groupBy("domain", "source_id").agg(F.count("*").alias("n"))
    numbered = counts.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "source_id"))).where("r <= 50").drop("n")
    scenario = F.explode(F.array(*[F.lit(k) for k in (0, 5, 10, 20, 50)]))
    gone = numbered.withColumn("scenario", scenario).where("r <= scenario").select("domain", "source_id", "scenario")
    return pairs.select("domain", "source_id", "label").withColumn("scenario", scenario).join(gone, ["domain", "source_id", "scenario"], "left_anti").groupBy("domain", "scenario").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"))


@query(with_(OOF, "daily as (select *, 'day' || (dayofyear(ts) % 3) as replicate from oof)", f"m as ({sql.auroc('daily', 'domain, replicate', 'label', 'a_prob', 'auc')})")
       + """select domain, count(distinct replicate) as n_replicates, round(avg(auc), 6) as mean_auc, round(stddev_samp(auc), 6) as sd_auc, round(min(auc), 6) as min_auc, round(max(auc), 6) as max_auc,
  round(avg((auc > 0.5)::int), 6) as robust_fraction, arg_max(replicate, round(auc, 6)) as best_replicate from m group by domain""")
def replicate_aggregate(spark, sf_dir):
    daily = views.scored_pairs(spark, sf_dir).withColumn("replicate", F.concat(F.lit("day"), (F.dayofyear("ts") % 3).cast("string")))
    m = metrics.auroc(daily, ["domain", "replicate"], "label", "a_prob", "auc")
    means = m.groupBy("domain").agg(F.countDistinct("replicate").alias("n_replicates"), six(F.avg("auc")).alias("mean_auc"), six(F.stddev_samp("auc")).alias("sd_auc"), six(F.min("auc")).alias("min_auc"), six(F.max("auc")).alias("max_auc"))
    shares = m.groupBy("domain").agg(six(F.avg((F.col("auc") > 0.5).cast("double"))).alias("robust_fraction"), F.max_by("replicate", six(F.col("auc"))).alias("best_replicate"))
    return means.join(shares, "domain", "left")


@query(with_(OOF) + f"""select domain, threshold, count(*) as n, sum(label)::bigint as n_positive, any_value(round(auc, 6)) as auc from
  (select domain, threshold, label from oof, (values (0.05::double), (0.1), (0.2), (0.3), (0.4), (0.5)) t(threshold) where abs(b_prob - a_prob) >= threshold)
  join ({sql.auroc('(select * from oof, (values (0.05::double), (0.1), (0.2), (0.3), (0.4), (0.5)) t(threshold) where abs(b_prob - a_prob) >= threshold)', 'domain, threshold', 'label', 'stacked_prob', 'auc')}) using (domain, threshold) group by all""")
def disagreement_subset(spark, sf_dir):
    rows = views.scored_pairs(spark, sf_dir).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in views.THRESHOLDS]))).where(F.abs(F.col("b_prob") - F.col("a_prob")) >= F.col("threshold"))
    counts = rows.groupBy("domain", "threshold").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"))
    auc = metrics.auroc(rows, ["domain", "threshold"], "label", "stacked_prob", "auc").select("domain", "threshold", six(F.col("auc")).alias("auc"))
    return counts.join(auc, ["domain", "threshold"], "left")


def _hard(margin: str = "0.2") -> str:
    return f"((label = 1 and b_prob - a_prob >= {margin}::double) or (label = 0 and a_prob - b_prob >= {margin}::double))"


@query(with_(OOF) + f"select domain, count(*) as n, count_if({_hard()})::bigint as n_hard, round(avg({_hard()}::int), 6) as hard_fraction from oof group by domain")
def hard_pairs(spark, sf_dir):
    hard = F.expr(_hard().replace("0.2::double", "0.2D"))
    return views.scored_pairs(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(hard).alias("n_hard"), six(F.avg(hard.cast("double"))).alias("hard_fraction"))


@query(with_(OOF) + f"""select domain, {_hard()} as hard, count(*) as n, round(avg(label), 6) as positive_rate, {", ".join(f"round(avg({c}), 6) as mean_{c}" for c in ("a_prob", "b_prob", "stacked_prob", "base_prob"))}, round(avg(abs(b_prob - a_prob)), 6) as mean_gap from oof group by all""")
def hard_profile(spark, sf_dir):
    rows = views.scored_pairs(spark, sf_dir).withColumn("hard", F.expr(_hard().replace("0.2::double", "0.2D")))
    means = [six(F.avg(c)).alias(f"mean_{c}") for c in ("a_prob", "b_prob", "stacked_prob", "base_prob")]
    return rows.groupBy("domain", "hard").agg(F.count("*").alias("n"), six(F.avg(F.col("label").cast("double"))).alias("positive_rate"), *means, six(F.avg(F.abs(F.col("b_prob") - F.col("a_prob")))).alias("mean_gap"))


_MARGINS = f"""marg as (select *, unnest(['all', case when {_hard("margin")} then 'hard' else 'non_hard' end]) as grp
  from long join (select event_id, a_prob, b_prob from oof) using (event_id), (values (0.1::double), (0.2), (0.3), (0.4)) m(margin))"""
_K = "domain, margin, grp, model"


@query(with_(OOF, LONG, _MARGINS) + f"""select {_K}, n, round(positive_rate, 6) as positive_rate, round(mean_score, 6) as mean_score, round(auc, 6) as auc, round(ece, 6) as ece, round(brier, 6) as brier from
  (select {_K}, count(*) as n, avg(label) as positive_rate, avg(p) as mean_score from marg group by all) join ({sql.summary("marg", _K, "label", "p")}) using ({_K})""")
def margin_sweep(spark, sf_dir):
    margins = (0.1, 0.2, 0.3, 0.4)
    hard = [F.when(F.expr(_hard(f"{m}D").replace("::double", "")), 1).otherwise(0) for m in margins]
    # a row that is hard at a margin is hard at all smaller ones, so how many there are tells its group at each; rows become counts before they are copied for margins
    rows = _stacked(spark, sf_dir, "a_prob", "b_prob").withColumn("level", sum(hard[1:], hard[0]))
    points = settled(rows.groupBy("domain", "model", "level", "label", "p").agg(F.count("*").alias("w")), "points", small=False)
    group = lambda i: F.when(F.col("level") > i, "hard").otherwise("non_hard")
    each = F.array(F.struct(F.lit(-1).alias("at"), F.lit("all").alias("grp")), *[F.struct(F.lit(i).alias("at"), group(i).alias("grp")) for i in range(len(margins))])
    rows = points.withColumn("_e", F.explode(each)).select("domain", "model", "label", "p", "w", "_e.*")
    own, keys = ["domain", "at", "grp", "model"], ["domain", "margin", "grp", "model"]
    mean = lambda c: six(F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w"))))
    counts = rows.groupBy(*own).agg(F.sum("w").alias("n"), mean("label").alias("positive_rate"), mean("p").alias("mean_score"))
    out = counts.join(metrics.summary(rows, own, "label", "p", weight="w").select(*own, *[six(F.col(c)).alias(c) for c in ("auc", "ece", "brier")]), own)
    of = F.array(*map(F.lit, margins))
    out = out.withColumn("margin", F.explode(F.when(F.col("at") < 0, of).otherwise(F.slice(of, F.col("at") + 1, 1))))
    return out.select(*keys, *[c for c in out.columns if c not in (*own, *keys)])


@query(with_(OOF) + f"""select domain, source_id, n, n_positive, case when n >= 8 and n_positive >= 2 and n - n_positive >= 2 then round(auc, 6) end as auc, n >= 20 and n_positive >= 3 as supported from
  (select domain, source_id, count(*) as n, sum(label)::bigint as n_positive from oof group by all) left join ({sql.auroc("oof", "domain, source_id", "label", "stacked_prob", "auc")}) using (domain, source_id)""")
def supported_sources(spark, sf_dir):
    pairs = views.scored_pairs(spark, sf_dir)
    keys = ["domain", "source_id"]
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), metrics.estimable(F.col("label")).alias("ok"))
    out = counts.join(metrics.auroc(pairs, keys, "label", "stacked_prob", "auc"), keys, "left")
    return out.select(*keys, "n", "n_positive", F.when(F.col("ok"), six(F.col("auc"))).alias("auc"), ((F.col("n") >= 20) & (F.col("n_positive") >= 3)).alias("supported"))
