"""Scored pairs, replay logs, a sparse matrix and vector pairs, derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_number
from .tables import table

THRESHOLDS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
METHODS = ("raw", "affine")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, domain, source_id, label and the probabilities of a baseline, two models and their stack."""
    value = F.col("value")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("domain"),
        F.col("user_id").alias("source_id"),
        (value / (value + F.lit(50.0))).alias("a_prob"),
        (k / F.lit(100.0)).alias("b_prob"),
        (F.hour("ts") / F.lit(24.0)).alias("base_prob"),
        "ts",
    )
    rows = rows.withColumn("stacked_prob", (F.col("a_prob") + F.col("b_prob")) / F.lit(2.0)).withColumn("h", hash_number("label", F.col("event_id")))
    rate = F.lit(0.1) + F.lit(0.5) * (F.lit(0.6) * F.col("a_prob") + F.lit(0.4) * F.col("b_prob"))
    return rows.withColumn("label", F.when((F.col("h") % 1000) / F.lit(1000.0) < rate, 1).otherwise(0))


def calibrated(pairs: DataFrame) -> DataFrame:
    """Scored pairs under each calibration method: as they are, and affine (0.1 + 0.5 p)."""
    columns = ["a_prob", "b_prob", "stacked_prob"]
    methods = F.explode(F.array(*[F.lit(m) for m in METHODS]))
    out = pairs.withColumn("method", methods)
    for c in columns:
        out = out.withColumn(c, F.when(F.col("method") == "affine", F.lit(0.1) + F.lit(0.5) * F.col(c)).otherwise(F.col(c)))
    return out


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by parts as a sparse matrix: cell_id, gene_id, value."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed pairs of parts of one order whose first part is a source (a multiple of 20); self-loops and repeats are still in."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    left = lines.where(F.col("l_partkey") % 20 == 0).select("l_orderkey", F.col("l_partkey").alias("source"))
    return left.join(lines.withColumnRenamed("l_partkey", "target"), "l_orderkey").select("source", "target")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def vector_pairs(spark: SparkSession, sf_dir: str, more: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of vectors whose ids are 1 to 20 apart, by an equi-join on the id: source_idx, target_idx, source_id, label, a, b.

    ``more``: what is worked out once a vector and carried along as a_more and b_more."""
    v = vectors(spark, sf_dir)
    v = v.withColumn("m", more(F.col("v"))) if more else v
    own = lambda name: [F.col("m").alias(name)] if more else []
    near = v.select(F.col("vec_id").alias("source_idx"), F.col("label").alias("la"), F.col("v").alias("a"), *own("a_more"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 20)).alias("target_idx"))
    other = v.select(F.col("vec_id").alias("target_idx"), F.col("label").alias("lb"), F.col("v").alias("b"), *own("b_more"))
    return near.join(other, "target_idx").select(
        "source_idx", "target_idx", (F.col("source_idx") % 25).alias("source_id"), F.when(F.col("la") == F.col("lb"), 1).otherwise(0).alias("label"), "a", "b", *(["a_more", "b_more"] if more else [])
    )
