"""Metrics of count-based windows of rows, in order of columns or of hashes, as array operations on whole blocks of windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import ROWS, hash_numbers, suffix
from ..functions.metrics import EDGES
from ..functions.scalars import finite
from .ranking import numbered, slice_of

#: Rows of a block at most; sizes whose least common multiple is larger are done one by one.
MOST = 1 << 16
#: Rows of a slice of a permutation while there are fewer than 256.
SLICE = 1 << 13
#: Rows that a task works on at once.
ROWS_AT_ONCE = 1 << 15
_TOLD = {"window_size": pa.int32(), "window_id": pa.int32(), "n": pa.int64(), "window_coverage": pa.float64(), "window_auc": pa.float64(), "window_ece": pa.float64()}
_NAMES = "window_size int, window_id int, n long, window_coverage double, window_auc double, window_ece double"


def _metrics(size: int, run: np.ndarray, n: np.ndarray, p: np.ndarray, y: np.ndarray, flag: np.ndarray, by_p: np.ndarray):
    """(first row, window_id, coverage, auc, ece) of the full windows of ``size``; rows lie in order of group ``run`` and number ``n``, ``by_p`` is the order of p, NaN: not counted."""
    at = n // size
    starts = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (at[1:] != at[:-1])))
    full = np.diff(np.append(starts, len(n))) == size
    window = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
    told = ~np.isnan(flag)
    k = len(starts)
    n_flag = np.bincount(window[told], minlength=k)
    cover = np.bincount(window[told], weights=flag[told], minlength=k) / np.where(n_flag, n_flag, np.nan)
    by_p = by_p[np.argsort(window[by_p].astype(np.uint16) if k <= 1 << 16 else window[by_p], kind="stable")]
    by_p = by_p[~np.isnan(p[by_p])]
    w, x, label = window[by_p], p[by_p], y[by_p]
    count, pos = np.bincount(w, minlength=k), np.bincount(w, weights=label, minlength=k)
    tie = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (x[1:] != x[:-1]))) if len(w) else np.zeros(0, int)
    times = np.diff(np.append(tie, len(w)))
    rank = np.repeat(tie + (times + 1) / 2, times) - (np.cumsum(count) - count)[w]
    pairs = pos * (count - pos)
    auc = (np.bincount(w, weights=label * rank, minlength=k) - pos * (pos + 1) / 2) / np.where(pairs, pairs, np.nan)
    gaps = np.bincount(w * 10 + np.searchsorted(EDGES[1:-1], x, "right"), weights=label - x, minlength=10 * k)
    ece = np.abs(gaps).reshape(k, 10).sum(1) / np.where(count, count, np.nan)
    return starts[full], at[starts[full]], cover[full], auc[full], ece[full]


def _batch(groups: list[pa.Array], names: list[str], sizes, run, n, p, y, flag):
    """The windows of whole blocks as one record batch; ``groups`` holds each row's, or by ``run`` each group's, values."""
    by_p, out = np.argsort(p, kind="stable"), []
    for size in sizes:
        first, at, cover, auc, ece = _metrics(size, run, n, p, y, flag, by_p)
        own = pa.array(first if len(groups[0]) == len(n) else run[first]) if groups else None
        numbers = [np.full(len(at), size, np.int32), at.astype(np.int32), np.full(len(at), size, np.int64)]
        out.append(pa.RecordBatch.from_arrays([*[g.take(own) for g in groups], *map(pa.array, numbers), *[pa.array(v, from_pandas=True) for v in (cover, auc, ece)]], names=[*names, *_TOLD]))
    return out


def _floats(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _over_rows(n_groups: int, sizes: tuple[int, ...]):
    """Rows (groups, _n, _p, _y, _f) sorted by groups and number, whole blocks together, to windows."""
    span = math.lcm(*sizes)

    def told(table):
        table = table.combine_chunks()
        n = table.column("_n").to_numpy()
        groups = [table.column(i).combine_chunks() if table.num_rows else pa.array([]) for i in range(n_groups)]
        run = np.zeros(len(n), np.int64)
        for g in groups:
            codes = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            run[1:] += np.abs(np.diff(codes)) > 0
        return _batch(groups, table.column_names[:n_groups], sizes, np.cumsum(run > 0), n, *[_floats(table.column(c)) for c in ("_p", "_y", "_f")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < max(ROWS_AT_ONCE, 2 * span):
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(i).slice(size - span).to_pylist() for i in range(n_groups)] + [[v // span for v in table.column("_n").slice(size - span).to_pylist()]]
            last = [column[-1] for column in keys]
            cut = next((i for i in range(span - 1, -1, -1) if [column[i] for column in keys] != last), -1) + 1
            cut += size - span  # the last block may go on in the next batch
            yield from told(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size -= cut
        if size:
            yield from told(pa.Table.from_batches(held))

    return run


def _ready(df: DataFrame, label: str, score: str, flag: str) -> list[Column]:
    counted = finite(F.col(score)) & F.col(label).isNotNull()
    missing = F.lit(float("nan"))
    return [F.coalesce(F.when(counted, F.col(score).cast("double")), missing).alias("_p"), F.coalesce(F.when(counted, F.col(label).cast("double")), missing).alias("_y"), F.coalesce(F.col(flag).cast("double"), missing).alias("_f")]


def _families(sizes) -> list[tuple[int, ...]]:
    return [tuple(sizes)] if math.lcm(*sizes) <= MOST else [(s,) for s in sizes]


def _named(df: DataFrame, groups: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{c}` {kinds[c]}, " for c in groups)


def window_summaries(df: DataFrame, groups: list[str], order: list[str], sizes, label: str, score: str, flag: str) -> DataFrame:
    """(groups, window_size, window_id, n, window_coverage, window_auc, window_ece) of every full window of each size of rows in order; the incomplete last one is dropped.

    Rows are numbered once and travel once, to the block (the sizes' least common multiple) that holds their windows of all sizes; rows without a label or a finite score count in coverage only."""
    rows = numbered(df.select(*{c: None for c in (*groups, *order)}, *_ready(df, label, score, flag)), groups, slice_of(df, order[0]), [F.col(c) for c in order], "_n")
    out = None
    for family in _families(sizes):
        block = F.floor(F.col("_n") / math.lcm(*family))
        cut = rows.select(*groups, F.col("_n").cast("long").alias("_n"), "_p", "_y", "_f").repartition(*map(F.col, groups), block).sortWithinPartitions(*groups, "_n")
        one = cut.mapInArrow(_over_rows(len(groups), family), _named(df, groups) + _NAMES)
        out = one if out is None else out.unionByName(one)
    return out


def _dealt(n_groups: int, permutations: range, seed: int):
    """Numbered rows to packed records by permutation and the first bits of their hash, eight at most: hash, number, score, and label and flag in a byte (3: none)."""
    prefixes = [f"{seed}|{g}" for g in permutations]
    kind = np.dtype([("h", "<u4"), ("i", "<u4"), ("p", "<f8"), ("b", "u1")])

    def dealt(batch):
        group = [batch.column(i)[0].as_py() for i in range(n_groups)]
        types = [batch.schema.field(i).type for i in range(n_groups)]
        keys, y, flag = batch.column("_k"), _floats(batch.column("_y")), _floats(batch.column("_f"))
        line = np.empty(batch.num_rows, kind)
        line["i"], line["p"] = batch.column("_i").to_numpy(), _floats(batch.column("_p"))
        line["b"] = np.where(np.isnan(y), 3, y).astype(np.uint8) * 4 + np.where(np.isnan(flag), 3, flag).astype(np.uint8)
        bits = min(8, max(0, math.ceil(math.log2(batch.column("_t")[0].as_py() / SLICE))))  # the same in all of the group
        slices, numbers, packed = [], [], []
        for g, h in zip(permutations, hash_numbers(prefixes, keys), strict=True):
            line["h"] = h
            top = (h >> np.uint32(24)).astype(np.uint8) >> (8 - bits)
            raw = line[np.argsort(top, kind="stable")].tobytes()
            ends = np.cumsum(np.bincount(top, minlength=256)) * kind.itemsize
            for s, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                if a < b:
                    slices.append(s)
                    numbers.append(g)
                    packed.append(raw[a:b])
            if len(packed) > 20000 or g == permutations[-1]:
                k = len(packed)
                yield pa.RecordBatch.from_arrays([*[pa.array([v] * k, t) for v, t in zip(group, types, strict=True)], pa.array(numbers, pa.int32()), pa.array(slices, pa.int32()), pa.array(packed, pa.binary())], names=[*batch.schema.names[:n_groups], "permutation_id", "_slice", "rows"])
                slices, numbers, packed = [], [], []

    def run(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("_g").dictionary_encode()
            codes = coded.indices.to_numpy()
            for code, name in enumerate(coded.dictionary.to_pylist()):
                held[name] = [*held.get(name, []), batch.take(pa.array(np.flatnonzero(codes == code)))]
                if sum(b.num_rows for b in held[name]) >= ROWS:
                    yield from dealt(pa.Table.from_batches(held.pop(name)).combine_chunks().to_batches()[0])
            if sum(b.num_rows for parts in held.values() for b in parts) > 16 * ROWS:
                for name in list(held):
                    yield from dealt(pa.Table.from_batches(held.pop(name)).combine_chunks().to_batches()[0])
        for parts in held.values():
            yield from dealt(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])

    return run, kind


def _over_slices(n_groups: int, sizes: tuple[int, ...], kind):
    """Records sorted by group, permutation and slice to windows; a slice is put in order at a time, and rows short of a block wait for the next."""
    span = math.lcm(*sizes)

    def told(key, schema, rows, first, last):
        whole = len(rows) if last else len(rows) - (first + len(rows)) % span
        if not whole:
            return [], rows, first
        here, y, flag = rows[:whole], (rows["b"][:whole] >> 2).astype(float), (rows["b"][:whole] & 3).astype(float)
        y[y == 3], flag[flag == 3] = np.nan, np.nan
        groups = [pa.array([v], schema.field(i).type) for i, v in enumerate(key)]
        return _batch(groups, schema.names[: n_groups + 1], sizes, np.zeros(whole, np.int64), first + np.arange(whole), np.ascontiguousarray(here["p"]), y, flag), rows[whole:], first + whole

    def run(batches):
        now, schema, empty = None, None, np.zeros(0, kind)
        rest, first, parts = empty, 0, []

        def in_order():
            some = np.frombuffer(b"".join(parts), kind)
            return np.concatenate([rest, some[np.lexsort((some["i"], some["h"]))]])

        for batch in batches:
            schema = batch.schema
            for *key, g, s, raw in zip(*[batch.column(i).to_pylist() for i in range(n_groups + 3)], strict=True):
                if now != ((*key, g), s):
                    if now is not None:
                        ended = now[0] != (*key, g)
                        out, rest, first = told(now[0], schema, in_order(), first, ended)
                        yield from out
                        if ended:
                            rest, first = empty, 0
                    now, parts = ((*key, g), s), []
                parts.append(raw)
        if now is not None:
            yield from told(now[0], schema, in_order(), first, True)[0]

    return run


def permutable(df: DataFrame, groups: list[str], key: str, label: str, score: str, flag: str) -> DataFrame:
    """Rows ready for :func:`windows_of`, which may read them several times."""
    rows = numbered(df.select(*groups, key, *_ready(df, label, score, flag)), groups, slice_of(df, key), [F.col(key)], "_i", "_t")
    return rows.select(*groups, F.to_json(F.struct(F.lit(0), *groups), {"ignoreNullFields": "false"}).alias("_g"), F.col("_i").cast("long").alias("_i"), F.col("_t").cast("long").alias("_t"), suffix(F.col(key)).alias("_k"), "_p", "_y", "_f")


def windows_of(rows: DataFrame, groups: list[str], permutations: range, sizes, seed: int = 42) -> DataFrame:
    """:func:`permuted_windows` of :func:`permutable` rows for some of the permutations.

    Rows are hashed block by block and travel as 17 bytes a permutation; a task puts one slice of a permutation (up to 256) in order at a time, so no permutation has to fit into a task."""
    named, own = _named(rows, groups), [*groups, "permutation_id"]
    deal, kind = _dealt(len(groups), permutations, seed)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # adaptive execution would join the small rows into one task
    cut = rows.repartition(n, "_k").mapInArrow(deal, named + "permutation_id int, _slice int, rows binary").repartition(n, *own).sortWithinPartitions(*own, "_slice")
    out = None
    for family in _families(sizes):
        one = cut.mapInArrow(_over_slices(len(groups), family, kind), named + "permutation_id int, " + _NAMES)
        out = one if out is None else out.unionByName(one)
    return out


def permuted_windows(df: DataFrame, groups: list[str], key: str, permutations: int, sizes, label: str, score: str, flag: str, seed: int = 42) -> DataFrame:
    """:func:`window_summaries` of ``df`` in the hash order of each permutation (permutation_id), equal hashes in order of the key; ``flag`` is 0, 1 or null."""
    return windows_of(permutable(df, groups, key, label, score, flag), groups, range(permutations), sizes, seed)
