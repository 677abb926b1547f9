"""Near-duplicate groups by MinHash, banding, verification on full sets and connected components.

1. A document's set is hashed to 64-bit shingles.  Documents with equal sets form a class; only its smallest id goes on.
2. ``HASHES`` universal hash minima, in ``BANDS`` bands of four: sets with a similarity of 0.75 miss all
   32 bands with a probability of 5e-6.
3. Round one pairs each member of a bucket with the bucket's smallest id.  Pairs whose signatures agree
   enough are verified on their full sets; verified pairs are linked into components.
4. Round two looks only at buckets that still hold several components, block by block: members outside the bucket's largest
   component (its minority) against all members.  Those of different components whose signatures agree enough are verified
   inside the block, each pair in the first band that it shares, and only pairs that link components come out.  So no pair is lost,
   the pairs of a large group of near copies are never written, and one stray member costs such a group one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import tidy, written
from .text import chunks, encode_words, hash_words, mix, rows_of, split_words, starts_of, string_array, window_hashes

SHINGLE, PERCENT = 5, 75
HASHES, BANDS = 128, 32
#: Least agreement of two signatures that is verified: five standard deviations below the least similarity.
LEAST_AGREEING = 72
#: Members of a bucket that are compared in one step.
BLOCK = 1024
#: Classes with more than one in so many documents count as large; there are fewer of them than this, so they are broadcast.
LARGE_CLASSES = 2048
#: Bits of the table of ids whose sets are needed: fixed, so it can be broadcast; what it lets through in error is joined away.
ID_BITS = 24

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FACTORS, _TERMS = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and each text's first one."""
    words, bounds = split_words(pc.ascii_lower(texts))
    codes, distinct = encode_words(words)
    hashes = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    windows = window_hashes(hashes, SHINGLE)
    at = np.flatnonzero(starts_of(bounds, SHINGLE)[: len(windows)])
    rows, values = [rows_of(bounds)[at]], [windows[at]]
    lengths = np.diff(bounds)
    for n in range(1, SHINGLE):  # too short for a window: the whole sequence is one shingle
        short = np.flatnonzero(lengths == n)
        rows.append(short)
        values.append(mix(window_hashes(hashes, n)[bounds[short]] + np.uint64(n)) if len(short) else np.zeros(0, np.uint64))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima under HASHES multiply-add-shift functions, one row per set; an empty set has the largest values."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        starts = bounds[some]
        for i in range(HASHES):
            out[some, i] = np.minimum.reduceat(values * _FACTORS[i] + _TERMS[i], starts) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, and the column ``key``) per row; set_key, a 128-bit hash of the set, is null for an empty set."""
    carried = [key] if key else []

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=1 << 20):
                values, bounds = shingles(string_array(part.column("text")))
                sizes = np.diff(bounds)
                raw = values.tobytes()
                keys = [xxhash.xxh3_128_digest(raw[a * 8 : b * 8]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                rows = signatures(values, bounds).view(f"V{4 * HASHES}").ravel().tolist()
                arrays = [part.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(rows, pa.binary()), *(part.column(c) for c in carried)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "signature", *carried])

    schema = ", ".join(["doc_id long, n_shingles long, set_key binary, signature binary", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)])
    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(tidy(run), schema)


def _signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def bands(sketch: DataFrame) -> DataFrame:
    """(bucket, band, doc_id): one row per band of each signature."""

    def run(batches):
        for batch in batches:
            s = _signature_rows(batch.column("signature")).astype(np.uint64)
            keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(s), 1))
            width = HASHES // BANDS
            for k in range(width):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + s[:, k::width])
            ids = np.repeat(np.asarray(batch.column("doc_id"), np.int64), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(s))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(band), pa.array(ids)], names=["bucket", "band", "doc_id"])

    return sketch.select("doc_id", "signature").mapInArrow(tidy(run), "bucket long, band int, doc_id long")


def _likely(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures agree in at least LEAST_AGREEING places."""
    left = sketch.select(F.col("doc_id").alias("u"), F.col("signature").alias("su"))
    right = sketch.select(F.col("doc_id").alias("v"), F.col("signature").alias("sv"))

    def run(batches):
        for batch in batches:
            same = (_signature_rows(batch.column("su")) == _signature_rows(batch.column("sv"))).sum(axis=1)
            yield batch.select(["u", "v"]).filter(pa.array(same >= LEAST_AGREEING))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(tidy(run), "u long, v long")


def _id_table(ids: DataFrame) -> bytes:
    """A bit table of hashed ids, ORed together from one slice of bits per task and slice."""
    slots = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    table = np.zeros(1 << (ID_BITS - 6), np.int64)
    for r in slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[r.word] = r.bits
    return table.tobytes()


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents whose id is in ``ids``, and of few others."""
    table = docs.sparkSession.sparkContext.broadcast(_id_table(ids))

    def run(batches):
        bits = np.frombuffer(table.value, np.uint64)
        for batch in batches:
            slot = np.asarray(batch.column("slot"), np.int64)
            needed = batch.filter(pa.array(bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1) == 1))
            for part in chunks(needed, most=1 << 20):
                values, bounds = shingles(string_array(part.column("text")))
                raw, at = values.tobytes(), (bounds * 8).tolist()
                sets = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    slotted = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << ID_BITS)).alias("slot"))
    return slotted.mapInArrow(tidy(run), "doc_id long, shingles binary")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v, linked) of pairs of ids, by the exact similarity of their full sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = full_sets(docs, ids).join(ids, "doc_id").dropDuplicates(["doc_id"])

    def run(batches):
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(tidy(run), "u long, v long, linked boolean")


def _cross_pairs(ids, comp, minor, sig, left, right, band: int):
    """Pairs of places (u, v) of different components that agree enough and share no band before this one, the likeliest first.

    Of two minority members only the smaller id asks."""
    out = []
    for u in left:
        partner = right[(comp[right] != comp[u]) & np.where(minor[right], ids[right] > ids[u], ids[right] != ids[u])]
        same = sig[partner] == sig[u]
        agreeing = same.sum(axis=1)
        first = same.reshape(len(partner), BANDS, -1).all(axis=2).argmax(axis=1)
        good = np.flatnonzero((agreeing >= LEAST_AGREEING) & (first == band))
        out.append(np.column_stack([np.full(len(good), u), partner[good], agreeing[good]]))
    pairs = np.concatenate([*out, np.zeros((0, 3), np.int64)]).astype(np.int64)
    return pairs[np.argsort(-pairs[:, 2], kind="stable"), :2]


def _sides(t: pa.Table):
    ids, comp, minor = (np.asarray(t.column(c)) for c in ("doc_id", "component", "minor"))
    asks, band = np.asarray(t.column("asks")), int(t.column("band")[0].as_py())
    return ids, comp, _cross_pairs(ids, comp, minor, _signature_rows(t.column("signature")), np.flatnonzero(asks), np.flatnonzero(~asks), band)


_BLOCKED = ["bucket", "i", "j", "band", "doc_id", "component", "minor", "asks", "signature"]


def _needed(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """The members of a pair of blocks that have a pair to verify."""
    _, _, pairs = _sides(t)
    return t.select(_BLOCKED).take(pa.array(np.unique(pairs)))


def _links(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Verified pairs of a pair of blocks; pairs that are linked already by others are not verified again."""
    ids, comp, pairs = _sides(t)
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("shingles")]
    root = {int(c): int(c) for c in comp}
    out = []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for u, v in pairs.tolist():
        a, b = find(int(comp[u])), find(int(comp[v]))
        if a != b:
            x, y = sets[u], sets[v]
            small, large = min(len(x), len(y)), max(len(x), len(y))
            if 100 * small < PERCENT * large:
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                root[b] = a
                out.append((int(ids[u]), int(ids[v])))
    return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})


def _round_two(members: DataFrame, parts: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) between different components of ``parts`` (node, component) that share a bucket.

    A bucket's members and its minority are cut into blocks of about BLOCK by a hash of the id; a block of either makes a group."""
    now = members.select("bucket", "band", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    held = now.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = held.groupBy("bucket").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("largest"), F.count("*").alias("k")).where("k > 1")
    split = now.join(mixed, "bucket").withColumn("minor", F.col("component") != F.col("largest"))
    block = lambda size: F.greatest(F.ceil(size / BLOCK), F.lit(1)).cast("long")
    split = split.withColumn("bi", block(F.col("n"))).withColumn("bj", block(F.col("n") - F.col("most")))
    own = lambda blocks: F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    dealt = split.select("*", own("bi").alias("i"), every("bj").alias("j"), F.lit(False).alias("asks")).unionByName(split.where("minor").select("*", every("bi").alias("i"), own("bj").alias("j"), F.lit(True).alias("asks")))
    rows = dealt.join(reps, "doc_id").select(*_BLOCKED)
    schema = "bucket long, i long, j long, band int, doc_id long, component long, minor boolean, asks boolean, signature binary"
    needed = written(rows.groupBy("bucket", "i", "j").applyInArrow(_needed, schema), "blocks")
    ids = written(needed.select("doc_id").distinct(), "ids")
    sets = full_sets(docs, ids).join(ids, "doc_id").dropDuplicates(["doc_id"])
    full = needed.join(sets, "doc_id").select(*_BLOCKED, "shingles")
    return full.groupBy("bucket", "i", "j").applyInArrow(_links, "u long, v long").distinct()


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with their class's component.  Large classes are joined by a broadcast, so all copies of one text never meet in a task."""
    large = rows.where("set_key is not null").groupBy("set_key").agg(F.count("*").alias("c")).where(F.col("c") * LARGE_CLASSES > rows.count()).select("set_key")
    marked = rows.join(F.broadcast(classes.join(F.broadcast(large), "set_key").withColumnRenamed("component", "_large")), "set_key", "left")
    rest = marked.where("_large is null").drop("_large").join(classes, "set_key", "left")
    return rest.unionByName(marked.where("_large is not null").withColumnRenamed("_large", "component"))


def near_duplicates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id), one row per row of ``docs``, and the column ``key``, by which rows can be told apart.

    A null or empty text has the empty set, is linked with nothing and kept.
    Rows with equal ids and sets are one document, so all of them are kept or none; a row with a null id
    is linked with nothing: its component_id is null and it is kept.  Columns other than doc_id and text are ignored."""
    sketch = written(sketches(docs, key), "sketches")
    carried = [key] if key else []
    keyed = sketch.where("set_key is not null and doc_id is not null")
    classes = keyed.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    smallest = classes.withColumnRenamed("rep", "doc_id")
    reps = written(keyed.join(smallest, ["set_key", "doc_id"]).select("doc_id", "signature").dropDuplicates(["doc_id"]), "representatives")
    buckets = bands(reps)
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(buckets.join(shared, "bucket"), "buckets")  # of buckets with two members or more
    pairs = written(_likely(members.where("doc_id <> u").select("u", F.col("doc_id").alias("v")).distinct(), reps), "pairs")
    tried = written(verified(pairs, docs), "verified")
    parts = written(components(tried.where("linked").select("u", "v")), "components")
    more = written(_round_two(members, parts, reps, docs), "links")
    parts = written(components(tried.where("linked").select("u", "v").unionByName(more)), "components")
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    found = _with_classes(sketch.select("doc_id", "n_shingles", "set_key", *carried), of_class)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), *carried).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
