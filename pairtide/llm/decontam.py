"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of digits, letters and
non-ASCII characters.  Of every window of ``SPAN`` words the smallest hash of its
``GRAM``-word runs is kept; since a shared window has the same smallest run on
both sides, every shared span of SPAN words or more shares a fingerprint.
Fingerprints of documents and benchmark items are joined and each hit is
extended word by word in both directions; a hit of at least SPAN equal words counts.  An item of fewer words is one window:
for each such length that occurs the same is done with windows of that length.

Document fingerprints pass a bit table of the benchmark's first.  The table has a fixed
size, so it is broadcast; only the few that pass are written, with the words around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import anchors
from .shared import tidy, written
from .text import chunks, encode_words, from_bytes, hash_words, raw_bytes, rows_of, split_words, starts_of, string_array

SPAN, GRAM = 10, 5
TABLE_BITS = 24
#: Benchmark fingerprints up to this many are broadcast (with their contexts some 100 MB at most); more are joined by a shuffle.
BROADCAST_ROWS = 400_000

_WORD = np.full(256, ord(" "), np.uint8)
_WORD[128:] = np.arange(128, 256)
_WORD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

MARKS = "array<struct<span: int, fp: bigint, at: int, left: int, context: string>>"
_MARK = pa.struct([("span", pa.int32()), ("fp", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("context", pa.string())])


def contamination_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    data, bounds = raw_bytes(texts)
    return split_words(from_bytes(_WORD[data], bounds))


def _gram(span: int) -> int:
    return min(GRAM, span)


def _marks(texts: pa.Array, spans, table: np.ndarray | None):
    """Word counts, and for each text its fingerprints (span, hash, place, words before it, words around it).

    ``spans``: window lengths, or None to use each text's own (SPAN at most)."""
    words, bounds = contamination_words(texts)
    codes, distinct = encode_words(words)
    hashes = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    lengths, rows = np.diff(bounds), rows_of(bounds)
    found = []
    for span in range(1, SPAN + 1) if spans is None else spans:
        best, at = anchors(hashes, span, _gram(span))
        ok = np.flatnonzero(starts_of(bounds, span)[: len(best)])
        if spans is None and len(ok):
            ok = ok[np.minimum(lengths[rows[ok]], SPAN) == span]
        if table is not None and len(ok):
            slot = best[ok] >> np.uint64(64 - TABLE_BITS)
            ok = ok[table[slot.astype(np.int64) >> 3] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1]
        if not len(ok):
            continue
        place, first = np.unique(at[ok], return_index=True)
        for p, fp in zip(place.tolist(), best[ok][first].view(np.int64).tolist(), strict=True):
            row = rows[p]
            lo, hi = max(int(bounds[row]), p - span + _gram(span)), min(int(bounds[row + 1]), p + span)
            found.append((row, (span, fp, p - int(bounds[row]), p - lo, " ".join(words[lo:hi].to_pylist()))))
    marks = [[] for _ in range(len(texts))]
    for row, mark in found:
        marks[row].append(dict(zip(("span", "fp", "at", "left", "context"), mark, strict=True)))
    return lengths, marks


def fingerprints(items: DataFrame, spans=None, table=None, key: str = "item_id") -> DataFrame:
    """(row, key, n_words, marks): row numbers rows uniquely while the table is read the same way, so write it before joining on it."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        bits = np.frombuffer(table.value, np.uint8) if table is not None else None
        for batch in batches:
            for part in chunks(batch):
                n_words, marks = _marks(string_array(part.column("text")), spans, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column(key), pa.array(n_words), pa.array(marks, pa.list_(_MARK))], names=["row", key, "n_words", "marks"])
                row += part.num_rows

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, "text").mapInArrow(tidy(run), f"row long, `{key}` {kind}, n_words long, marks {MARKS}")


def _extend(batches):
    """Hits of each pair of contexts: the run of equal words around the fingerprint, if it is long enough."""
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("row", "context_id", "span", "at", "d_left", "d_context", "left", "context")]
        for row, context_id, span, at, d_left, d_context, left, context in zip(*columns, strict=True):
            a, b = d_context.split(" "), context.split(" ")
            k = _gram(span)
            if a[d_left : d_left + k] != b[left : left + k]:
                continue
            lo = 0
            while lo < min(d_left, left) and a[d_left - lo - 1] == b[left - lo - 1]:
                lo += 1
            hi = k
            while d_left + hi < len(a) and left + hi < len(b) and a[d_left + hi] == b[left + hi]:
                hi += 1
            if lo + hi >= span:
                out.append((row, context_id, at - lo, at + hi))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["row", "context_id", "first", "last"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, item_ids (sorted as strings), spans (first and last word plus one, merged), contaminated.

    A word is hit if any occurrence of a benchmark window covers it.  Null and empty texts have no words;
    an item without words has no window.  Repeated rows and ids each get their own row; items with equal ids count once, a null item id not at all.
    An empty benchmark leaves everything clean.  Columns other than the key and text are ignored."""
    spark = docs.sparkSession
    items = written(fingerprints(benchmark, key=item).select(F.col(item).cast("string").alias("item"), F.explode("marks").alias("m")), "benchmark")
    contexts = items.select("item", "m.span", "m.fp", "m.left", "m.context").withColumn("context_id", F.xxhash64("span", "fp", "left", "context"))
    spans = sorted(r.span for r in contexts.select("span").distinct().collect())  # SPAN values at most
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    slot = F.shiftrightunsigned("fp", 64 - TABLE_BITS)
    bits = contexts.select(F.shiftright(slot, 3).alias("byte"), F.expr(f"shiftleft(1, cast(shiftrightunsigned(fp, {64 - TABLE_BITS}) & 7 as int))").alias("bit"))
    for r in bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # one row per byte of the table at most
        table[r.byte] = r.bits
    marked = written(fingerprints(docs, spans, spark.sparkContext.broadcast(table.tobytes()), key), "fingerprints")
    distinct = contexts.dropDuplicates(["context_id"]).drop("item")
    if distinct.count() <= BROADCAST_ROWS:
        distinct = F.broadcast(distinct)
    pairs = (
        marked.select("row", F.explode("marks").alias("m"))
        .select("row", "m.span", "m.fp", "m.at", F.col("m.left").alias("d_left"), F.col("m.context").alias("d_context"))
        .join(distinct, ["span", "fp"])
        .select("row", "context_id", "span", "at", "d_left", "d_context", "left", "context")
    )
    hits = written(pairs.mapInArrow(tidy(_extend), "row long, context_id long, first long, last long"), "hits")
    merged = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s")).select("row", F.expr(_MERGE).alias("spans"))
    owners = contexts.where("item is not null").select("context_id", "item").distinct()
    named = hits.select("row", "context_id").distinct().join(owners, "context_id").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = merged.join(named, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return marked.join(found, "row", "left").select(
        key,
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<first: bigint, last: bigint>>")).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


#: Sorted spans with those that touch or overlap joined.
_MERGE = """aggregate(s, cast(array() as array<struct<first: bigint, last: bigint>>), (done, x) -> case
    when size(done) > 0 and element_at(done, -1).last >= x.first then
        concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last))))
    else concat(done, array(x)) end)"""
