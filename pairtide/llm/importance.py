"""Importance resampling towards a target text distribution.

A document's features are its runs of one to three consecutive words (A-Z lower-cased; digits,
letters and non-ASCII characters), hashed into buckets by CRC-32.  A bucket's gain is its log ratio between
target and corpus, a document's weight the sum of its features' gains, and documents are drawn
by weight plus Gumbel noise made of their id.

Identical texts are collapsed first, by grouping the full text: features are computed once a text and kept as sorted
buckets in the shared folder, corpus counts multiply them by the text's multiplicity, weights are computed once a text,
and only then joined back to the documents, whose ids give the noise.
The join goes by SHA-256 of the text; texts that hold ``1 / HOT`` of all documents or more (``HOT`` at most) are joined by a broadcast, so no key holds more in the
shuffle.  Ranks come from a range-partitioned order with totals by partition; nothing is sorted in one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontam import contamination_words
from .shared import kept, written
from .text import chunks, encode_words, from_rising_planes, raw_bytes, rising_planes, string_array

ORDERS = 3
HOT = 1024
#: Runs of buckets whose counts a task sends as one record each.
PARTS = 16
#: Words up to this many bytes have their tables kept.
USUAL = 256
#: Sorted buckets are kept as 16-bit numbers.
MOST_BUCKETS = 1 << 16

_FEATURES = "digest binary, copies long, n_words long, n_features long, buckets binary"


def _shifted(values: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit words, given by what it makes of each bit."""
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), basis[bit], np.uint32(0))
    return out


def _zeros(n: int) -> np.ndarray:
    """Tables (byte of the CRC, its value) of the map for n zero bytes: a CRC of two strings is the first one's, mapped, xor the second one's."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    doubled = basis
    for _ in range(8):
        doubled = np.where(doubled & np.uint32(1), (doubled >> np.uint32(1)) ^ np.uint32(0xEDB88320), doubled >> np.uint32(1))
    while n:
        if n & 1:
            basis = _shifted(basis, doubled)
        doubled, n = _shifted(doubled, doubled), n >> 1
    return np.stack([_shifted(np.arange(256, dtype=np.uint32), np.append(basis[8 * at : 8 * at + 8], np.zeros(24, np.uint32))) for at in range(4)])


def run_hashes(words: pa.Array) -> list[np.ndarray]:
    """CRC-32 of the runs of 1 to ``ORDERS`` words, joined by one space, that start at each word (over the ends of texts too)."""
    codes, distinct = encode_words(words)
    if not len(codes):
        return [np.zeros(0, np.uint32)] * ORDERS
    data, bounds = raw_bytes(distinct.cast(pa.large_string()))
    raw, ends = data.tobytes(), bounds.tolist()
    own = np.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], np.uint32)
    lengths, at = np.unique(np.diff(bounds), return_inverse=True)
    maps = lambda n: kept(f"zeros {n}", lambda: _zeros(n)) if n <= USUAL else _zeros(n)
    tables = np.concatenate([maps(n) for n in (*lengths.tolist(), *(lengths + 1).tolist())]).ravel()
    spaced = _follow(own, np.zeros(len(own), np.int64), _zeros(1).ravel()) ^ np.uint32(zlib.crc32(b" "))
    word, space, size = own[codes], spaced[codes], at[codes]
    out, head = [word], space
    for k in range(1, ORDERS):
        head, last = head[: len(word) - k], slice(k, None)
        out.append(_follow(head, size[last], tables) ^ word[last])
        head = _follow(head, size[last] + len(lengths), tables) ^ space[last]
    return out


def _follow(crcs: np.ndarray, which: np.ndarray, tables: np.ndarray) -> np.ndarray:
    base, out = which * 1024, np.zeros(len(crcs), np.uint32)
    for at in range(4):
        out ^= tables[base + 256 * at + (crcs >> np.uint32(8 * at) & np.uint32(255))]
    return out


def features(texts: DataFrame, n_buckets: int = 10_000) -> DataFrame:
    """(digest, copies, n_words, n_features, buckets) of each row of ``texts`` (digest, copies, text); buckets are sorted, as byte planes of their differences."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words, bounds = contamination_words(string_array(part.column("text")))
                runs = [(h % np.uint32(n_buckets)).astype(np.uint16) for h in run_hashes(words)]
                kept = []
                for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                    mine = np.concatenate([h[a : max(a, b - k)] for k, h in enumerate(runs)])
                    mine.sort()
                    kept.append(rising_planes(mine))
                n = np.diff(bounds)
                sizes = sum(np.maximum(n - k, 0) for k in range(ORDERS))
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("copies"), pa.array(n), pa.array(sizes), pa.array(kept, pa.binary())], names=["digest", "copies", "n_words", "n_features", "buckets"])

    return texts.select("digest", "copies", "text").mapInArrow(run, _FEATURES)


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, copies, text): each distinct text once; a null is an empty text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    return docs.select(body).groupBy("text").agg(F.count("*").alias("copies")).select(_digest(F.col("text")).alias("digest"), "copies", "text")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_counts(found: DataFrame, n_buckets: int) -> np.ndarray:
    """Features in each bucket over all documents, copies counted; ``n_buckets`` totals reach the driver."""

    cuts = range(0, n_buckets, -(-n_buckets // PARTS))

    def counted(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for raw, copies in zip(batch.column("buckets").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                total += copies * np.bincount(from_rising_planes(raw, np.uint16), minlength=n_buckets)
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(cuts, pa.int32()), "sums": [total[a : a + cuts.step].tobytes() for a in cuts]})

    def summed(batches):
        totals = {}
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                totals[part] = totals.get(part, 0) + np.frombuffer(sums, np.int64)
        if totals:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.int32()), "sums": [v.tobytes() for v in totals.values()]})

    out, schema = np.zeros(n_buckets, np.int64), "part int, sums binary"
    for part, sums in found.select("copies", "buckets").mapInArrow(counted, schema).repartition("part").mapInArrow(summed, schema).collect():
        out[part : part + cuts.step] = np.frombuffer(sums, np.int64)
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of each bucket's share, rounded down."""
    n, t, s = len(corpus), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((float(a) + 1) * (s + n) / ((float(b) + 1) * (t + n)))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight) of each distinct text."""

    def run(batches):
        for batch in batches:
            weights = [int(gain[from_rising_planes(raw, np.uint16)].sum()) for raw in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weights, pa.int64())], names=[*batch.schema.names[:4], "weight"])

    return found.mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's number, from 0, in one global order.

    The ordered table is written once, so numbers stay as they are when tasks are repeated; totals are one row a partition."""
    at = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, *, text: str = "text", key: str = "doc_id", percent: int = 5, least_words: int = 20, seed: int = 42, n_buckets: int = 10_000) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_features, weight, score, rank.

    rank numbers the ``floor(percent * N / 100)`` highest scores among the N documents of ``least_words`` words or more, from 1, ties by the smaller key; it is NULL for the others.
    A null text has no words, weight 0 and a score like any other; a null key has the noise of an empty id and goes last among equal scores.
    Rows that are equal in key and text have equal scores and are drawn each for itself.  An empty target leaves the smoothed corpus as the ratio.
    Empty ``docs`` give an empty result.  Other columns are ignored."""
    if not 0 < n_buckets <= MOST_BUCKETS:
        raise ValueError(f"n_buckets must be at most {MOST_BUCKETS}")
    found = written(features(collapsed(docs, text), n_buckets), "features")
    gain = gains(bucket_counts(features(collapsed(target, text), n_buckets), n_buckets), bucket_counts(found, n_buckets))
    total, fit = found.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_words") >= least_words, F.col("copies"))), F.lit(0))).first()
    weights = written(weighed(found, gain), "weights")

    ids = written(docs.select(F.col(f"`{key}`").alias("_key"), _digest(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest")), "digests")
    hot = F.col("copies") * HOT >= total  # HOT rows at most
    often = ids.join(F.broadcast(weights.where(hot)), "digest")
    rest = ids.join(F.broadcast(weights.where(hot).select("digest")), "digest", "left_anti").join(weights.where(~hot), "digest")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = often.unionByName(rest).select("_key", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("_fit"))
    ranked = in_order(scored, [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("_key")], "_r")
    rank = F.when(F.col("_fit") & (F.col("_r") < percent * fit // 100), F.col("_r") + 1)
    return ranked.select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))
