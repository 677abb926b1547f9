"""Queries on scalar functions, lists and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import six
from ..sources import views
from ..sources.tables import table
from .registry import query
from .sql import OOF, with_


@query("select p_brand as brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') as slug, count(*) as n, min(p_partkey) as first_part from part group by all")
def slug_subsets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), scalars.slug(F.col("p_brand")).alias("slug")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("""select event_type as method, round(value, 1) as threshold, printf('%s@%.2f', event_type, round(value, 1)) as rule, count(*) as n from events group by all""")
def rule_labels(spark, sf_dir):
    """The label of every pair of a method and a threshold that occurs."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method"), F.round("value", 1).alias("threshold")).agg(F.count("*").alias("n"))
    return rows.withColumn("rule", scalars.rule_label(F.col("method"), F.col("threshold")))


#: Lists as a user writes them: ids of an order's lines, untidily separated.
_LIST = "concat_ws(', ', l_linenumber, l_partkey % 7, '', l_suppkey % 5, l_quantity)"


@query(f"""select list, count(*) as n_lines, array_to_string(list_transform(any_value(v), lambda x: (x::double)::varchar), ';') as numbers, any_value(len(v))::int as n, array_to_string(list_sort(list_distinct(list_filter(list_transform(any_value(v), lambda x: trunc(x::double)::int), lambda x: x between 1 and 5)))::varchar[], ';') as ranged
  from (select list, list_filter(list_transform(string_split(list, ','), lambda x: trim(x)), lambda x: x <> '') as v from (select {_LIST} as list from lineitem)) group by list""")
def list_params(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").select(F.expr(_LIST).alias("list")).groupBy("list").agg(F.count("*").alias("n_lines"))
    numbers = scalars.parse_list(F.col("list"))
    ranged = F.array_sort(F.array_distinct(F.filter(F.transform(numbers, lambda v: v.cast("int")), lambda v: (v >= 1) & (v <= 5))))
    return lists.select("list", "n_lines", scalars.join_list(numbers, ";").alias("numbers"), F.size(numbers).alias("n"), scalars.join_list(ranged, ";").alias("ranged"))


@query("""select p_size % 64 as size, name, count(*) as n, any_value(nullif(regexp_extract(name, '^pca([0-9]+)_(centered_cosine|neg_l2)$', 1), '')::int) as rank, any_value(regexp_replace(name, '_prob$', '')) as bare, any_value(case when name in ('cosine', 'dot') then name when regexp_matches(name, '^pca([0-9]+)_(centered_cosine|neg_l2)$') then 'low rank' else 'other' end) as kind
  from (select p_size, case p_partkey % 5 when 0 then 'pca' || p_size || '_centered_cosine' when 1 then 'pca' || p_size || '_neg_l2' when 2 then 'cosine' when 3 then lower(replace(p_brand, '#', '_')) || '_prob' else 'pca_neg_l2' end as name from part) group by all""")
def feature_names(spark, sf_dir):
    """Names of features made of the parts' sizes and brands: the rank in low-rank ones, names without their ending, and their kind."""
    size, place = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    name = F.when(place == 0, F.concat(F.lit("pca"), size, F.lit("_centered_cosine"))).when(place == 1, F.concat(F.lit("pca"), size, F.lit("_neg_l2"))).when(place == 2, "cosine")
    name = name.when(place == 3, F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_prob"))).otherwise("pca_neg_l2")
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 64).alias("size"), name.alias("name")).groupBy("size", "name").agg(F.count("*").alias("n"))
    rank = scalars.feature_rank(F.col("name"))
    kind = F.when(F.col("name").isin("cosine", "dot"), F.col("name")).when(rank.isNotNull(), "low rank").otherwise("other")
    return rows.select("size", "name", "n", rank.alias("rank"), scalars.strip_suffix(F.col("name"), "_prob").alias("bare"), kind.alias("kind"))


@query(with_(OOF) + """select domain, count(*) as n, round(avg(case when d < 0 then -1 else 1 end * (abs(d) + 0.05::double)), 6) as mean_shifted, count_if(abs(a_prob - b_prob) <= 1e-8 + 1e-5 * abs(b_prob))::bigint as n_close,
  round(avg(abs(d)), 6) as mean_abs, round(median(d), 6) as median_gap, round(avg(a_prob / greatest(b_prob, 0.05::double)), 6) as mean_ratio, round(max(greatest(d, 0)), 6) as max_gap, bool_and(a_prob >= 0) as all_positive from (select *, b_prob - a_prob as d from oof) group by domain""")
def inline_scalars(spark, sf_dir):
    rows = views.scored_pairs(spark, sf_dir).withColumn("d", F.col("b_prob") - F.col("a_prob"))
    return rows.groupBy("domain").agg(
        F.count("*").alias("n"), six(F.avg(scalars.shift_magnitude(F.col("d"), 0.05))).alias("mean_shifted"), F.count_if(scalars.is_close(F.col("a_prob"), F.col("b_prob"))).alias("n_close"), six(F.avg(F.abs("d"))).alias("mean_abs"),
        six(F.median("d")).alias("median_gap"), six(F.avg(scalars.safe_divide(F.col("a_prob"), F.col("b_prob"), 0.05))).alias("mean_ratio"), six(F.max(scalars.at_least(F.col("d"), 0.0))).alias("max_gap"), F.bool_and(F.col("a_prob") >= 0).alias("all_positive"),
    )
