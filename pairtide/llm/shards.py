"""Contiguous shards of nearly equal byte size, in DataFrame operations alone.

Rows have one global order: by slices of a hash of the text, then of the id, then by
text hash and id.  Equal texts share a slice, so they share a shard unless a
cut falls into their slice or they outgrow it; the second hash divides the
slice of a text that is very frequent.  Bytes and rows are totalled per slice,
the totals are summed up along the order, and a running sum inside each slice
gives every row its global prefix.  Cuts lie at equal targets of bytes.  No task gathers more than a
slice's rows or ``TEXT_SLICES`` totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEXT_SLICES = 4096
ID_SLICES = 64


def assign(docs: DataFrame, n_shards: int = 16, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the key column, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1, so empty and null texts count too (a null is
    an empty text).  A row belongs to shard ``floor(n_shards * b / total)`` with ``b`` the bytes
    of all rows before it, so each shard's bytes differ from the target by
    less than one row.  slot counts a shard's rows from 0.  Rows that are equal in all of this are
    interchangeable; a null key sorts first.  An empty table gives an empty result.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("_hash"),
    )
    rows = rows.withColumn("_a", F.pmod("_hash", F.lit(TEXT_SLICES)).cast("int")).withColumn(
        "_b", F.pmod(F.xxhash64("_key", "_hash"), F.lit(ID_SLICES)).cast("int")
    )
    fine = rows.groupBy("_a", "_b").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    coarse = fine.groupBy("_a").agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"))
    along = Window.orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)  # TEXT_SLICES rows at most
    whole = Window.orderBy("_a").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    coarse = coarse.select(
        "_a",
        F.coalesce(F.sum("_bytes").over(along), F.lit(0)).alias("_bytes_a"),
        F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_rows_a"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_a").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.join(F.broadcast(coarse), "_a").select(
        "_a",
        "_b",
        "_total",
        (F.col("_bytes_a") + F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).alias("_bytes_before"),
        (F.col("_rows_a") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_rows_before"),
    )
    order = Window.partitionBy("_a", "_b").orderBy("_hash", "_key", "size", "text_crc32")
    earlier = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        rows.join(fine, ["_a", "_b"])
        .withColumn("_start", F.col("_bytes_before") + earlier)
        .withColumn("_n", F.col("_rows_before") + F.row_number().over(order) - 1)
        .withColumn("shard", F.expr(f"int((_start * {int(n_shards)}) div _total)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_n").alias("_first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_n") - F.col("_first")).alias("slot")
    )
