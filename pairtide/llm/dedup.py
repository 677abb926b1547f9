"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``size`` consecutive words.  A word goes if a window that covers it
also starts earlier: in a document with a smaller id, or earlier in the same one.

* Each window is represented by its *anchor*, the smallest hash among its
  ``gram``-word windows; equal windows have equal anchors, and neighbouring windows share them, so
  the index holds about one hash for seven words.
* The index is a list of immutable runs, tables of sorted distinct anchor hashes by hash bucket (the leading bits; the number
  of buckets follows the size of the batch, and runs with fewer are split as they are read).
  A new batch's sorted anchors are merge-joined with every run of their bucket.  This gives the next run, and the anchors that
  occur twice or more, which are put into a bit table of fixed size.
* Verification: for windows with such an anchor the 96-bit hash of the whole window is compared with
  all others, of the batch and of earlier documents, and the first place of each is found.  What the
  bit table lets through in error is sorted out here.
* When there are more runs than ``max_runs`` they are merged into one.

Each group of documents sends one entry per distinct window (its first place), so
a passage that is in a third of all documents costs an entry per group, not per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, grouped, new_path, remove, text_bytes, tidy
from .text import chunks, encode_words, from_planes, from_rising_planes, hash_words, planes, rising_planes, rows_of, split_words, starts_of, string_array, sums_by_text, window_hashes

SIZE, GRAM = 20, 8
#: Buckets of a run: one for so many bytes of text, between these powers of two.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 4 << 20, 5, 16
#: Anchors that a task sorts before it hands them on.
HELD = 2 << 20
#: Bytes of text whose words a worker works on at one time; of a group only windows with a repeated anchor are kept (and its words, where they are returned).
PART_BYTES = 1 << 20
#: Bits of the table of repeated anchors: 16 for each, between these powers of two. A full table costs work, never results.
LEAST_BITS, MOST_BITS = 20, 29


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    words, bounds = split_words(texts)
    codes, distinct = encode_words(words)
    return words, bounds, hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), codes


def anchors(hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``size`` words: the smallest hash of its ``gram``-word windows, and where that first occurs."""
    grams = window_hashes(hashes, gram)
    span = size - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, at = grams, np.arange(len(grams), dtype=np.int32)
    reach = 1
    while reach < span:  # sliding minimum by doubling
        step = min(reach, span - reach)
        later = best[step:] < best[: len(best) - step]
        at = np.where(later, at[step:], at[: len(at) - step])
        best = np.minimum(best[step:], best[: len(best) - step])
        reach += step
    return best[:n], at[:n]


def _anchors_of(texts: pa.Array, size: int, gram: int):
    words, bounds, hashes = _words(texts)[:3]
    best, at = anchors(hashes, size, gram)
    ok = np.flatnonzero(starts_of(bounds, size)[: len(best)])
    return words, bounds, hashes, ok, best, at


def bucket_bits(total_bytes: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, (total_bytes // BUCKET_BYTES).bit_length()))


def _pieces(fps: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted hashes as one row for each bucket that has some."""
    cut = np.searchsorted(fps >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    raw, full = fps.tobytes(), np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([raw[cut[b] * 8 : cut[b + 1] * 8] for b in full], pa.binary())], names=["bucket", "fps"])


def batch_anchors(docs: DataFrame, size: int, gram: int, bits: int) -> DataFrame:
    """(bucket, fps): the sorted anchor hashes of pieces of the batch; one that a piece has twice or more is in it twice."""

    def run(batches):
        def packed():
            fps, n = np.unique(np.concatenate(held), return_counts=True)
            return _pieces(np.repeat(fps, np.minimum(n, 2)), bits)

        held, n = [], 0
        for batch in batches:
            for part in chunks(batch, most=PART_BYTES):
                _, _, _, ok, best, at = _anchors_of(string_array(part.column("text")), size, gram)
                place, first = np.unique(at[ok], return_index=True)
                held.append(best[ok][first])
                n += len(place)
                if n > HELD:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    return docs.select("text").mapInArrow(tidy(run), "bucket int, fps binary")


def _split(runs: DataFrame, bits: int) -> DataFrame:
    """The pieces of runs (bucket, fps) by the leading ``bits`` of their hashes."""

    def run(batches):
        for batch in batches:
            pieces = [_pieces(np.frombuffer(fps.as_buffer(), np.uint64), bits) for fps in batch.column("fps")]
            yield from pa.Table.from_batches(pieces).combine_chunks().to_batches() if pieces else ()

    return runs.select("fps").mapInArrow(tidy(run), "bucket int, fps binary")


def _numbers(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def _merge(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """The batch's anchors of one bucket against every sorted piece of the runs: new ones for the next run, repeated ones for verification."""
    distinct, counts = np.unique(_numbers(left.column("fps"), np.uint64), return_counts=True)
    seen = np.zeros(len(distinct), bool)
    for piece in right.column("fps"):
        old = np.frombuffer(piece.as_buffer(), np.uint64)
        if len(old) and len(distinct):
            seen |= old[np.minimum(np.searchsorted(old, distinct), len(old) - 1)] == distinct
    bucket = key[0].as_py()
    return pa.table({"bucket": pa.array([bucket, bucket], pa.int32()), "repeated": [False, True], "fps": pa.array([distinct[~seen].tobytes(), distinct[seen | (counts > 1)].tobytes()], pa.binary())})


class FingerprintIndex:
    """Runs of anchor hashes in the shared folder; ``add`` takes the next batch of documents."""

    def __init__(self, spark: SparkSession, *, size: int = SIZE, gram: int = GRAM, max_runs: int = 4):
        if not 0 < gram <= size:
            raise ValueError("gram must be between 1 and size")
        self.spark, self.size, self.gram, self.max_runs = spark, size, gram, max_runs
        self.runs, self.bits, self.compactions = [], LEAST_BUCKETS, 0

    def _read(self, repeated: bool, *paths: str) -> DataFrame:
        schema = "bucket int, fps binary, repeated boolean"
        rows = self.spark.createDataFrame([], schema)
        for path in paths:  # each run is a table of its own
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(path))
        return rows.where(F.col("repeated") == repeated).select("bucket", "fps")

    def merge(self, batch: DataFrame, bits: int) -> DataFrame:
        """Merge a batch with the runs in ``2 ** bits`` buckets, append its run, and return its repeated anchors as (bucket, fps)."""
        path = new_path(self.spark, "anchors")
        new, old = batch_anchors(batch, self.size, self.gram, bits), _split(self._read(False, *self.runs), bits)
        merged = new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_merge, "bucket int, repeated boolean, fps binary")
        merged.where(F.octet_length("fps") > 0).write.partitionBy("repeated").parquet(path)
        self.runs.append(path)
        self.bits = max(self.bits, bits)
        return self._read(True, path)

    def compact(self) -> None:
        """Merge all runs into one if there are more than ``max_runs``."""
        if len(self.runs) <= self.max_runs:
            return

        def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            fps = np.sort(_numbers(table.column("fps"), np.uint64), kind="stable")  # a merge of sorted pieces; runs have no hash in common
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "repeated": [False], "fps": pa.array([fps.tobytes()], pa.binary())})

        path = new_path(self.spark, "anchors")
        pieces = _split(self._read(False, *self.runs), self.bits)
        pieces.groupBy("bucket").applyInArrow(join, "bucket int, repeated boolean, fps binary").write.partitionBy("repeated").parquet(path)
        self.close()
        self.runs = [path]
        self.compactions += 1

    def close(self) -> None:
        """Remove the runs.  Results don't read them: a batch's repeated anchors are in its bit table."""
        for path in self.runs:
            remove(self.spark, path)
        self.runs = []


def _bit_table(repeated: DataFrame, bucket_bits: int) -> tuple[int, bytes]:
    """The repeated anchors as a bit table of at most ``2 ** MOST_BITS`` bits (64 MB): each task sends the bits it has, ORed by slice."""
    n = repeated.agg(F.sum(F.octet_length("fps"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * n).bit_length()))
    table = np.zeros(1 << (bits - 3), np.uint8)
    # The leading bits of a hash are its bucket, so a bucket's bits lie in one slice of the table.
    width = len(table) >> bucket_bits

    def slices(batches):
        for batch in batches:
            out = []
            for bucket, fps in zip(batch.column("bucket").to_pylist(), batch.column("fps"), strict=True):
                at = (np.frombuffer(fps.as_buffer(), np.uint64) >> np.uint64(64 - bits)).astype(np.int64) - bucket * width * 8
                mask = np.zeros(width * 8, bool)
                mask[at] = True
                out.append((bucket, np.packbits(mask, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "fps"])

    for r in repeated.mapInArrow(tidy(slices), "bucket int, fps binary").toLocalIterator():
        table[r.bucket * width : (r.bucket + 1) * width] |= np.frombuffer(r.fps, np.uint8)
    return bits, table.tobytes()


def _marked(texts: pa.Array, ids: np.ndarray, size: int, gram: int, bits: int, table: np.ndarray):
    """The words of these texts, each text's first one, and of windows with a repeated anchor: first word, high, low, id, start."""
    words, bounds, hashes, ok, best = _anchors_of(texts, size, gram)[:5]
    slot = best[ok] >> np.uint64(64 - bits)
    ok = ok[(table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    high = window_hashes(hashes, size)[ok]
    low = (window_hashes(hashes ^ (hashes >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25), size)[ok] >> np.uint64(32)).astype(np.uint32) if len(ok) else np.zeros(0, np.uint32)
    rows = rows_of(bounds)[ok]
    return words, bounds, (ok, high, low, ids[rows], (ok - bounds[rows]).astype(np.int32))


def _candidates(docs, size: int, gram: int, bits: int, table: np.ndarray, split: list | None = None):
    """Windows of ``docs`` (doc_id, text) with a repeated anchor: their entry's number, and the sorted distinct entries (high, low, id, start).

    Words are counted through all texts.  ``split`` gets the words of one part of the texts after the other, with each text's first one."""
    found, n_words = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32))], 0
    for part in chunks(docs, most=PART_BYTES):
        words, bounds, (ok, *rest) = _marked(string_array(part.column("text")), _ids(part), size, gram, bits, table)
        found.append((ok + n_words, *rest))
        n_words += len(words)
        if split is not None:
            split.append((words, bounds))
    ok, high, low, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.lexsort((start, doc, low, high))
    h, w = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    pick = order[new]
    is_first = (doc == doc[pick][entry]) & (start == start[pick][entry])
    return ok, entry, is_first, (high[pick], low[pick], doc[pick], start[pick])


def _cut(entries, n_buckets: int) -> np.ndarray:
    return np.searchsorted((entries[0] >> np.uint64(32)).astype(np.int64) * n_buckets >> 32, np.arange(n_buckets + 1))


REQUEST = "gid int, bucket int, high binary, low binary, doc binary, start binary"


def _requests(gid: int | None, entries, n_buckets: int) -> pa.RecordBatch:
    cut = _cut(entries, n_buckets)
    full = np.flatnonzero(np.diff(cut))
    parts = [pa.array([pack(x[cut[b] : cut[b + 1]]) for b in full], pa.binary()) for pack, x in zip((rising_planes, planes, planes, planes), entries, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([gid] * len(full), pa.int32()), pa.array(full.astype(np.int32)), *parts], names=["gid", "bucket", "high", "low", "doc", "start"])


def _resolve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each entry of a group in this bucket: does its window start earlier in another group or batch?"""
    counts = [len(x.as_buffer()) // 8 for x in table.column("high")]
    kinds = (("high", from_rising_planes, np.uint64), ("low", from_planes, np.uint32), ("doc", from_planes, np.int64), ("start", from_planes, np.int32))
    high, low, doc, start = (np.concatenate([read(x.as_buffer(), kind) for x in table.column(c)]) for c, read, kind in kinds)
    order = np.lexsort((start, doc, low, high))
    h, w = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first = order[new][np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = (doc[first] != doc[order]) | (start[first] != start[order])
    gids, out, at = table.column("gid").to_pylist(), [], 0
    for gid, n in zip(gids, counts, strict=True):
        if gid is not None:
            out.append((gid, key[0].as_py(), np.packbits(later[at : at + n]).tobytes()))
        at += n
    return pa.table({"gid": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([x[1] for x in out], pa.int32()), "later": pa.array([x[2] for x in out], pa.binary())})


def remove_repeats(batch: DataFrame, index: FingerprintIndex, history: DataFrame | None = None, *, group_bytes: int = 8 << 20) -> DataFrame:
    """``batch`` (doc_id, text and any others) with n_words, n_removed and kept_text, the words that stay joined by one space.

    ``history``: the documents of the batches that ``index`` has already, all with smaller ids.
    A null or empty text has no words; one with fewer words than a window
    loses none.  Rows with equal ids are the same document: a window at the same place
    in both is not earlier in either.  Columns of the result's names are replaced; an empty batch gives an
    empty result.  The batch's run is appended to the index."""
    added = ("n_words", "n_removed", "kept_text", "gid")
    batch = batch.select(*[c for c in batch.columns if c not in added])
    spark, size, gram = index.spark, index.size, index.gram
    total = text_bytes(batch)
    of_runs = bucket_bits(total)
    bits, raw = _bit_table(index.merge(batch, of_runs), of_runs)
    shared = spark.sparkContext.broadcast((bits, raw))
    n_buckets = max(16, -(-(total if history is None else total + text_bytes(history)) // (4 << 20)))
    docs = grouped(batch, total, group_bytes)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits, raw = shared.value
        out = _requests(key[0].as_py(), _candidates(table, size, gram, bits, np.frombuffer(raw, np.uint8))[-1], n_buckets)
        give_back()
        return pa.Table.from_batches([out])

    def ask_old(batches):
        bits, raw = shared.value
        for b in batches:
            for part in chunks(b):
                yield _requests(None, _candidates(part, size, gram, bits, np.frombuffer(raw, np.uint8))[-1], n_buckets)

    asked = docs.select("doc_id", "text", "gid").groupBy("gid").applyInArrow(ask, REQUEST)
    if history is not None:
        asked = asked.unionByName(history.select("doc_id", "text").mapInArrow(tidy(ask_old), REQUEST))
    told = asked.groupBy("bucket").applyInArrow(_resolve, "gid int, bucket int, later binary")
    names = batch.columns

    def settle(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = settled(left, right)
        give_back()
        return out

    def settled(left: pa.Table, right: pa.Table) -> pa.Table:
        bits, raw = shared.value
        split = []
        ok, entry, is_first, entries = _candidates(left, size, gram, bits, np.frombuffer(raw, np.uint8), split)
        cut, later = _cut(entries, n_buckets), np.zeros(len(entries[0]), bool)
        for bucket, mask in zip(right.column("bucket").to_pylist(), right.column("later"), strict=True):
            n = cut[bucket + 1] - cut[bucket]
            later[cut[bucket] : cut[bucket + 1]] = np.unpackbits(np.frombuffer(mask.as_buffer(), np.uint8), count=n)
        repeats = ok[~is_first | later[entry]] if len(ok) else ok
        del ok, entry, is_first, entries, later
        step = np.zeros(sum(len(words) for words, _ in split) + 1, np.int32)
        np.add.at(step, repeats, 1)
        np.add.at(step, repeats + size, -1)
        all_gone, at, out = np.cumsum(step[:-1]) > 0, 0, []
        for words, bounds in split:
            gone = all_gone[at : at + len(words)]
            at += len(words)
            kept = words.filter(pa.array(~gone))
            upto = np.concatenate([[0], np.cumsum(~gone)])[bounds]
            lists = pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), kept)
            text = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            out.append(pa.table({"n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(sums_by_text(gone, bounds)), "kept_text": text.cast(pa.string())}))
        added = pa.concat_tables(out) if out else pa.table({"n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        return pa.table({n: left.column(n) for n in names} | {n: added.column(n) for n in added.column_names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields) + ", n_words long, n_removed long, kept_text string"
    return docs.groupBy("gid").cogroup(told.groupBy("gid")).applyInArrow(settle, schema)


def _ids(table) -> np.ndarray:
    column = table.column("doc_id")
    return np.asarray(pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, -(1 << 63)), np.int64)


def remove_all(docs: DataFrame, *, size: int = SIZE, gram: int = GRAM, batches: int = 3, max_runs: int = 1) -> DataFrame:
    """:func:`remove_repeats` over a whole table, fed to a new index as ``batches`` ranges of ids; the runs of the first two are compacted before the third."""
    index = FingerprintIndex(docs.sparkSession, size=size, gram=gram, max_runs=max_runs)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    out = []
    for i in range(len(cuts) + 1):
        key = F.coalesce("doc_id", F.lit(-(1 << 63)))
        low = F.lit(True) if i == 0 else key > cuts[i - 1]
        high = F.lit(True) if i == len(cuts) else key <= cuts[i]
        out.append(remove_repeats(docs.where(low & high), index, docs.where(key <= cuts[i - 1]) if i else None))
        if i < len(cuts):  # no batch follows the last
            index.compact()
    index.close()
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
