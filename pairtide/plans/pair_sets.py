"""Queries on sparse statistics, labelled pair sets and vector geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, vectors
from ..functions.scalars import six
from ..operators import pairs, ranking, sparse
from ..sources import arrays, views
from ..sources.tables import settled, shared_path, table
from . import sql
from .registry import query
from .sql import EXPR, NEGATIVES, POSITIVES, STATS, VECS, VPAIRS, with_


@query(with_(EXPR, STATS) + "select gene_id, round(mean, 6) as mean, round(variance, 6) as variance, round(detection, 6) as detection from stats")
def gene_stats(spark, sf_dir):
    out = sparse.gene_statistics(views.matrix(spark, sf_dir))
    return out.select("gene_id", *[six(F.col(c)).alias(c) for c in ("mean", "variance", "detection")])


@query(with_(VECS) + "select label, k, n, round(v, 6) as v from (select label, k - 1 as k, count(*) as n, avg(v[k]) as v from vecs, range(1, 65) r(k) group by label, k)")
def layer_mean_vectors(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    counts = v.groupBy("label").agg(F.count("*").alias("n"))
    means = vectors.mean_vectors(v, "v", "label").select("label", F.posexplode("mean").alias("k", "v"))
    return means.join(counts, "label").select("label", F.col("k").cast("long").alias("k"), "n", six(F.col("v")).alias("v"))


@query(with_(POSITIVES) + "from positives")
def positive_pairs(spark, sf_dir):
    return pairs.positives(views.edges(spark, sf_dir))


@query(with_(POSITIVES, NEGATIVES) + "from negatives")
def negative_pairs(spark, sf_dir):
    return pairs.negatives(pairs.positives(views.edges(spark, sf_dir)))


_LABELLED = "lab as (select *, 1 as label from positives union all select *, 0 as label from negatives)"
_COLUMNS = [f"{e}_{c}" for e in "st" for c in ("mean", "variance", "detection")]


@query(with_(EXPR, STATS, POSITIVES, NEGATIVES, _LABELLED) + f"""select source, target, label, {", ".join(f"round({c}, 6) as {c}" for c in _COLUMNS)} from lab
  join (select gene_id as source, mean as s_mean, variance as s_variance, detection as s_detection from stats) using (source)
  join (select gene_id as target, mean as t_mean, variance as t_variance, detection as t_detection from stats) using (target)""")
def pair_baseline_features(spark, sf_dir):
    positive = settled(pairs.positives(views.edges(spark, sf_dir)), "positive", small=False)
    both = pairs.labelled(positive, pairs.negatives(positive))
    statistics = gene_stats(spark, sf_dir)  # rounded once a gene and not once a pair
    return pairs.valid(pairs.gather(both, statistics), _COLUMNS).select("source", "target", "label", *_COLUMNS)


@query(with_(POSITIVES) + """select matched, count(*) as n, round(count(*) / (select count(*) from positives), 6) as fraction from
  (select source % 3 <> 0 and target % 3 <> 0 and source in (select p_partkey from part) and target in (select p_partkey from part) as matched from positives) group by matched""")
def matched_fraction(spark, sf_dir):
    members = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"))
    flagged = pairs.matched(pairs.positives(views.edges(spark, sf_dir)), members)
    total = flagged.agg(F.count("*").alias("_t"))
    return flagged.groupBy("matched").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("matched", "n", six(F.col("n") / F.col("_t")).alias("fraction"))


COS = "list_dot_product({0}, {1}) / greatest(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 1e-8)"
_CENTRE = "centre as (select list(m order by k) as c from (select k, avg(v[k]) as m from vecs, range(1, 65) r(k) group by k))"


def _feature(spark, sf_dir, name):
    rows = views.vector_pairs(spark, sf_dir)
    if name == "centered_cosine":
        rows = rows.crossJoin(F.broadcast(vectors.mean_vectors(views.vectors(spark, sf_dir), "v")))  # one row
        return rows.withColumn("f", vectors.feature(name, F.col("a"), F.col("b"), F.col("mean")))
    return rows.withColumn("f", vectors.feature(name, F.col("a"), F.col("b")))


def _values(spark, sf_dir, name):
    return _feature(spark, sf_dir, name).select("source_idx", "target_idx", "label", six(F.col("f")).alias("value"))


@query(with_(VECS, VPAIRS) + f"select source_idx, target_idx, label, round({COS.format('a', 'b')}, 6) as value from vpairs")
def pair_cosine(spark, sf_dir):
    return _values(spark, sf_dir, "cosine")


_CENTRED = "cen as (select source_idx, target_idx, label, list_transform(list_zip(a, c), lambda z: z[1] - z[2]) as a, list_transform(list_zip(b, c), lambda z: z[1] - z[2]) as b from vpairs, centre)"


@query(with_(VECS, VPAIRS, _CENTRE, _CENTRED) + f"select source_idx, target_idx, label, round({COS.format('a', 'b')}, 6) as value from cen")
def pair_centered_cosine(spark, sf_dir):
    return _values(spark, sf_dir, "centered_cosine")


@query(with_(VECS, VPAIRS) + "select source_idx, target_idx, label, round(list_dot_product(a, b), 6) as value from vpairs")
def pair_dot(spark, sf_dir):
    return _values(spark, sf_dir, "dot")


@query(with_(VECS, VPAIRS) + "select source_idx, target_idx, label, round(-list_distance(a, b), 6) as value from vpairs")
def pair_neg_l2(spark, sf_dir):
    return _values(spark, sf_dir, "neg_l2")


_FEATURES = f"""feats as (select label, 'cosine' as feature, {COS.format("a", "b")} as p from vpairs union all select label, 'centered_cosine', {COS.format("a", "b")} from cen
  union all select label, 'dot', list_dot_product(a, b) from vpairs union all select label, 'neg_l2', -list_distance(a, b) from vpairs)"""


@query(with_(VECS, VPAIRS, _CENTRE, _CENTRED, _FEATURES) + f"""select feature, round(auroc, 5) as auroc, round(aupr, 5) as aupr from ({sql.auroc("feats", "feature", "label", "p")}) join ({sql.aupr("feats", "feature", "label", "p")}) using (feature)""")
def raw_feature_auroc(spark, sf_dir):
    centre = F.broadcast(vectors.mean_vectors(views.vectors(spark, sf_dir), "v"))  # one row
    each = F.array(*[F.struct(F.lit(n).alias("feature"), vectors.feature(n, F.col("a"), F.col("b"), F.col("mean")).alias("p")) for n in ("cosine", "centered_cosine", "dot", "neg_l2")])
    rows = views.vector_pairs(spark, sf_dir).crossJoin(centre).select("label", F.explode(each).alias("_e")).select("label", "_e.*")
    out = metrics.auroc(rows, ["feature"], "label", "p").join(metrics.average_precision(rows, ["feature"], "label", "p"), "feature")
    return out.select("feature", F.round("auroc", 5).alias("auroc"), F.round("aupr", 5).alias("aupr"))


def _slices(spark, sf_dir):
    """The cosine of each pair in 4 layers and 3 seeds, which are slices of the vectors."""
    return sliced(views.vector_pairs(spark, sf_dir)).select("source_idx", "target_idx", "label", "layer", "seed", "f")


def sliced(pairs_):
    layer, seed = F.explode(F.sequence(F.lit(0), F.lit(3))), F.explode(F.sequence(F.lit(0), F.lit(2)))
    part = lambda c: F.slice(c, F.col("layer") * 16 + 1 + F.col("seed"), 13)
    return pairs_.withColumn("layer", layer).withColumn("seed", seed).withColumn("f", vectors.cosine(part("a"), part("b")))


def _sums(products):
    """The sums of a whole array of products and of its part for each slice of :func:`sliced`."""
    parts = [products, *[F.slice(products, layer * 16 + 1 + seed, 13) for layer in range(4) for seed in range(3)]]
    return [F.aggregate(p, F.lit(0.0), lambda s, v: s + v) for p in parts]


def _norms(v):
    return F.array(*[F.sqrt(s) for s in _sums(F.zip_with(v, v, lambda x, y: x * y))])


def pair_cosines(spark, sf_dir):
    """Vector pairs with their cosine f[0] and those of :func:`sliced`, f[1 + 3 * layer + seed]; norms are worked out once a vector and not once a pair."""
    rows = views.vector_pairs(spark, sf_dir, _norms).withColumn("_p", F.zip_with("a", "b", lambda x, y: x * y))
    cosines = [s / F.greatest(F.col("a_more")[i] * F.col("b_more")[i], F.lit(vectors.LEAST_NORM)) for i, s in enumerate(_sums(F.col("_p")))]
    return rows.withColumn("f", F.array(*cosines)).drop("a_more", "b_more", "_p")


SLICED = f"""sl as (select source_idx, target_idx, label, layer, seed, {COS.format("sa", "sb")} as f from (select source_idx, target_idx, label, layer, seed,
  a[16 * layer + 1 + seed : 16 * layer + 13 + seed] as sa, b[16 * layer + 1 + seed : 16 * layer + 13 + seed] as sb from vpairs, range(4) l(layer), range(3) s(seed)))"""


@query(with_(VECS, VPAIRS, SLICED) + f"select source_idx, target_idx, label, {', '.join(f'round(max(f) filter (layer = {i}), 6) as layer_{i}' for i in range(4))} from sl where seed = 0 group by all")
def layer_bundle(spark, sf_dir):
    wide = _slices(spark, sf_dir).where("seed = 0").groupBy("source_idx", "target_idx", "label").pivot("layer", [0, 1, 2, 3]).agg(six(F.max("f")))
    return wide.toDF("source_idx", "target_idx", "label", *[f"layer_{i}" for i in range(4)])


@query(with_(VECS, VPAIRS, SLICED) + "select source_idx, target_idx, label, layer::int as layer, count(*) as n_seeds, round(avg(f), 6) as f from sl group by all")
def seed_ensemble(spark, sf_dir):
    return _slices(spark, sf_dir).groupBy("source_idx", "target_idx", "label", "layer").agg(F.count("*").alias("n_seeds"), six(F.avg("f")).alias("f"))


_BUNDLES = "bun as (select bundle, seed, source_idx, target_idx, label, avg(f) as p from sl, (values ('l0', 0, 0), ('l0-1', 0, 1), ('l1-3', 1, 3), ('l0-3', 0, 3)) b(bundle, lo, hi) where layer between lo and hi group by all)"


@query(with_(VECS, VPAIRS, SLICED, _BUNDLES) + f"""select bundle, count(*) as n_seeds, round(avg(auroc), 5) as mean_auroc, round(stddev_samp(auroc), 5) as sd_auroc, round(min(auroc), 5) as min_auroc from ({sql.auroc("bun", "bundle, seed", "label", "p")}) group by bundle""")
def seed_bundle_summary(spark, sf_dir):
    bundles = spark.createDataFrame([("l0", 0, 0), ("l0-1", 0, 1), ("l1-3", 1, 3), ("l0-3", 0, 3)], "bundle string, lo int, hi int")
    rows = _slices(spark, sf_dir).join(F.broadcast(bundles), F.col("layer").between(F.col("lo"), F.col("hi"))).groupBy("bundle", "seed", "source_idx", "target_idx", "label").agg(F.avg("f").alias("p"))
    seeds = metrics.auroc(rows, ["bundle", "seed"], "label", "p")
    return seeds.groupBy("bundle").agg(F.count("*").alias("n_seeds"), F.round(F.avg("auroc"), 5).alias("mean_auroc"), F.round(F.stddev_samp("auroc"), 5).alias("sd_auroc"), F.round(F.min("auroc"), 5).alias("min_auroc"))


@query(with_(VECS, VPAIRS, SLICED, "ok as (select source_idx, target_idx, layer, seed, abs(f) > 0.02 as ok from sl)") + "select source_idx, target_idx from ok group by all having count(*) = 12 and bool_and(ok)")
def valid_in_all_slices(spark, sf_dir):
    numbered = ranking.numbered(views.vector_pairs(spark, sf_dir), [], metrics.score_slice(F.col("source_idx").cast("double")), [F.col("source_idx"), F.col("target_idx")], "pair")
    numbered = settled(numbered.select("pair", "source_idx", "target_idx", "a", "b"), "pairs", small=False)
    maps = pairs.validity_maps(sliced(numbered).withColumn("ok", F.abs("f") > 0.02), "pair", ["layer", "seed"])
    return pairs.valid_in_all(numbered.select("pair", "source_idx", "target_idx"), maps, 12, "pair").select("source_idx", "target_idx")


@query("""select c_custkey as name, n_nationkey as id, r_regionkey as token from (select distinct c_custkey, c_nationkey from customer) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_regionkey between 0 and 2""")
def map_chain(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region").select("r_regionkey")
    to_id = customers.select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("id")).distinct()
    to_token = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("token"))
    return pairs.map_chain(customers.select(F.col("c_custkey").alias("name")), to_id, to_token, 3)


@query(with_(VECS) + "select layer, count(*) as n, round(avg(sqrt(list_dot_product(p, p))), 6) as mean_norm, round(sum(row * p[1]), 4) as weighted_first from (select layer::int as layer, vec_id as row, v[16 * layer + 1 : 16 * layer + 16] as p from vecs, (values (1), (3)) l(layer)) group by layer")
def array_layers(spark, sf_dir):
    """Four layers of the vectors, written as array files and read again; only two layers' files are opened."""
    layer = F.explode(F.sequence(F.lit(0), F.lit(3)))
    layers = views.vectors(spark, sf_dir).withColumn("layer", layer).select("layer", F.col("vec_id").alias("row"), F.slice("v", F.col("layer") * 16 + 1, 16).alias("v"))
    path = shared_path(spark, "arrays")
    arrays.write_arrays(layers, path)
    read = arrays.read_arrays(spark, path).where(F.col("layer").isin(1, 3))
    return read.groupBy("layer").agg(F.count("*").alias("n"), six(F.avg(vectors.norm(F.col("v")))).alias("mean_norm"), F.round(F.sum(F.col("row") * F.col("v")[0]), 4).alias("weighted_first"))
