"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontam, dedup, html, importance, langid, manifest, neardup, packing, quality, shards, tokens

#: A file of one of the public tokenizers; resolved where the package that ships it is installed.
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder(4) == 2).alias("held_out"))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(_table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _remainder(5) == 1
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return ctw.score(docs).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.remove_all(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"select * from values (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') as t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.segments(rows))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.apply(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_TOKENIZER))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    fields = lambda body: manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), body)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = F.when((_remainder(3) == 0) & text.rlike("[A-Z]"), fields(lowered))
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", fields(text).alias("leaf"), seen.alias("seen"))
    return manifest.manifest(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_main_text, op3_language_id, op4_shards, op5_near_duplicates, op6_packing, op7_lm_score, op8_substring_dedup, op9_chat, op10_quality, op11_importance, op12_token_counts, op13_manifest)}

#: A to Z lower-cased and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = "'[^\\x20\\x09-\\x0D]+'"
_BARE = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

def _manifest_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** ``levels`` leaves; a tree with one node left passes the further levels unchanged."""
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join([*map(field, ('doc_id', 'source', 'lang', 'n_chars')), field(text)])})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def climbed(name: str, tree: str) -> str:
        """name_r0 (tree, i, node) upwards, and name_p0 (doc_id, tree, i, proof, fold) along with it."""
        steps = ""
        for k in range(1, levels + 1):
            below = f"{name}_r{k - 1}"
            steps += f""", {name}_n{k} as (select {tree}, count(*) > 1 as more from {below} group by {tree}),
{name}_r{k} as (select {tree}, i // 8 as i, list(node order by i) as nodes, case when any_value(more) then sha256(string_agg(node, '' order by i)) else any_value(node) end as node, any_value(more) as more from (select t.{tree}, t.i, t.node, m.more from {below} t join {name}_n{k} m on t.{tree} = m.{tree}) group by {tree}, i // 8),
{name}_p{k} as (select doc_id, {tree}, i // 8 as i, case when more then proof || lo || hi else proof end as proof, case when more then sha256(lo || fold || hi) else fold end as fold from
  (select p.*, more, array_to_string(nodes[1 : p.i % 8], '') as lo, array_to_string(nodes[p.i % 8 + 2 : 8], '') as hi from {name}_p{k - 1} p join {name}_r{k} r on r.{tree} = p.{tree} and r.i = p.i // 8))"""
        return steps

    crc = _crc_sql("ids", "(select distinct doc_id::varchar as f from documents)")
    return f"""with recursive {crc},
leaves as (select doc_id, case when lang is null then '' else '=' || lang end as tree, {leaf('text')} as leaf, case when crc % 3 = 0 then {leaf(lower)} else {leaf('text')} end as seen from documents d left join ids on f = doc_id::varchar),
l_r0 as (select tree, doc_id, leaf as node, row_number() over (partition by tree order by doc_id) - 1 as i from leaves),
l_p0 as (select doc_id, tree, i, '' as proof, seen as fold from l_r0 join leaves using (doc_id, tree)){climbed('l', 'tree')},
t_r0 as (select 0 as top, tree, node, row_number() over (order by tree) - 1 as i from l_r{levels}),
t_p0 as (select doc_id, 0 as top, t.i, proof, fold from l_p{levels} p join t_r0 t on t.tree = p.tree){climbed('t', 'top')}
select doc_id, leaf, s.node as subroot, r.node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = r.node as verified
from leaves join t_p{levels} using (doc_id) join t_r{levels} r using (top) join t_r0 s using (tree)"""


def _crc_sql(name: str, strings: str) -> str:
    """CTEs that end with ``name`` (f, crc): the unsigned CRC-32 of the strings f, byte by byte over a table made from its polynomial."""
    steps = "select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_bits where k < 8"
    return f"""crc_bits as (select b, 0 as k, b as c from (select unnest(range(256))::bigint as b) union all {steps}),
crc_table as (select b, c as t from crc_bits where k = 8),
{name}_all as (select f, hex(encode(f)) as h from {strings}),
{name}_at as (select f, h, 0 as i, 4294967295::bigint as c from {name}_all union all
  select f, h, i + 1, xor(c >> 8, t) from {name}_at join crc_table on b = xor(c & 255, ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint) where 2 * i < length(h)),
{name} as (select f, xor(c, 4294967295) as crc from {name}_at where 2 * i = length(h))"""


def _importance_sql() -> str:
    grams = lambda table, key: f"""select {key}, array_to_string(w[s : s + n - 1], ' ') as f from (select {key}, w, n, unnest(range(1, len(w) - n + 2)) as s
  from (select {key}, regexp_extract_all({_LOWER}, {_BARE}) as w from {table}), (values (1), (2), (3)) v(n) where len(w) >= n)"""  # noqa: E731
    return f"""with recursive dg as materialized ({grams('documents', 'doc_id')}), bg as materialized ({grams('benchmark', 'item_id')}),
{_crc_sql('codes', '(select f from dg union select f from bg)')},
buckets as materialized (select f, crc % 10000 as bucket from codes),
s as (select bucket, count(*) as s from dg join buckets using (f) group by bucket), t as (select bucket, count(*) as t from bg join buckets using (f) group by bucket),
gains as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from dg) + 10000)::double) / ((coalesce(s, 0) + 1)::double * ((select count(*) from bg) + 10000)::double)))::bigint as gain
  from (select unnest(range(10000)) as bucket) left join s using (bucket) left join t using (bucket)),
weights as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from dg join buckets using (f) join gains using (bucket) group by doc_id),
scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(regexp_extract_all({_LOWER}, {_BARE})) >= 20 as fit,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id::varchar)[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score from documents left join weights using (doc_id)),
ranked as (select *, row_number() over (partition by fit order by score desc, doc_id) as r, count(*) filter (fit) over () as n from scored)
select doc_id, n_features, weight, score, case when fit and r <= (5 * n) // 100 then r end as rank from ranked"""


ORACLE_SQL: dict[str, str] = {
    "op11_importance": _importance_sql(),
    "op13_manifest": _manifest_sql(),
    "op1_decontamination": f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_BARE}) as w from documents),
i as (select item_id, w, least(10, len(w)) as n from (select item_id, regexp_extract_all({_LOWER}, {_BARE}) as w from benchmark) where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as k from (select *, unnest(range(1, len(w) - n + 2)) as s from i)),
hits as (select doc_id, s, n, item_id from (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as k from
  (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from win) where len(w) >= n)) join win using (n, k)),
places as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, list_sort(list_distinct(list(item_id::varchar))) as ids from hits group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(array_to_string(coalesce(ids, []), ',')) as items_sha256, n_hit is not null as contaminated
from d left join places using (doc_id) left join found using (doc_id)""",
    "op5_near_duplicates": f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
sets as (select distinct doc_id, array_to_string(w[s : s + 4], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from sets x join sets y on x.k = y.k and x.doc_id <> y.doc_id group by all)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared >= 75 * (p.n + q.n - shared)),
reach as (select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on links.a = reach.b)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from d left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)""",
    "op8_substring_dedup": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
win as (select doc_id, s, array_to_string(w[s : s + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20)),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from again),
kept as (select doc_id, string_agg(w, ' ' order by p) as t from (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as p from d) anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join (select doc_id, count(*) as n from gone group by doc_id) using (doc_id) left join kept using (doc_id)""",
}
