"""A corpus from raw documents to packed sequences; each stage works on all that the one before it kept.

Stages judge rows, not ids: rows with a null id are documents of their own, and of rows with one id and different texts each has its own verdict.
Rows that agree in id and text are one document, which stays or goes as a whole.  A null or empty text fails the quality rules.
Columns beside doc_id, text, lang and n_chars pass unchanged (n_chars is counted anew where words were removed); an empty table gives empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairtide.llm import decontam, dedup, neardup, packing, quality
from pairtide.llm.shared import new_path, passing
from pairtide.llm.queries import TOKENIZER


ROW, REST = "_pipeline_row", "_pipeline_rest"


def _row_key():
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both; a null id becomes a negative number made of the text."""
    own = -F.shiftrightunsigned(F.xxhash64(F.lit("null"), "text"), 2) - (1 << 61)
    return docs.select(F.coalesce("doc_id", own).alias("doc_id"), "text", _row_key().alias(ROW))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``."""
    return docs.withColumn(ROW, _row_key()).join(gone.select(ROW).distinct(), ROW, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def _packed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, ``more``, and all columns but the text as one, so no name clashes with an operator's."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", *more, rest.alias(REST))


def _opened(packed: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    return packed.select([changed.get(c, F.col("text") if c == "text" else F.col(f"{REST}.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified rule reject go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _opened(quality.apply(_packed(docs, "lang"), model).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return _without(docs, neardup.near_duplicates(_keyed(docs), ROW).where("not kept"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; a changed text is its words joined by one space, and one left empty goes."""
    out = dedup.remove_all(_packed(docs)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(f"{REST}.n_chars"))
    return _opened(out, docs, text=text, n_chars=n_chars)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    found = decontam.contamination(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=ROW)
    return _without(docs, found.where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, in sequences of at most 4096."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Certified thresholds, tokenizer ids and the packing itself can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
