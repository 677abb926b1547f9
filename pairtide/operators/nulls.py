"""Null gains of a feature: many deals of labels or of a feature over the same rows, fitted and scored in blocks.

The rows are numbered twice, by key and by the hash that deals folds, and lie in blocks of the latter order, once for all repeats; a block holds each repeat's labels as a byte a row, or its feature as a number a row.
A deal says which value (numbered by key) a row gets: rows in the order of a repeat's hashes are cut into chunks, joined with the chunk of values that has the same numbers, and sent to the rows' blocks.
All fits of a group take their Newton steps together, and scores travel packed, by slice of their range.  Repeats are done in rounds, so that what lies in shuffle files is bounded.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.hashes import ROWS, hash_numbers, suffix
from ..functions.scalars import finite, joined
from ..sources.tables import settled
from . import models
from .ranking import numbered, slice_of
from .resample import _hash_order, stratified_folds

#: Rows of a block, of a chunk of values, and of a slice of scores.
BLOCK, CHUNK, SLICE = 1 << 13, 1 << 16, 1 << 16
#: Rows that the repeats of a round have together; they travel as 12 bytes each.
ROUND = 1 << 27
#: A row that takes no part in a repeat; else a row's code is twice its fold, and its label.
OUT = 255
_HASHED = np.dtype([("h", "<u4"), ("i", "<u4"), ("f", "<u4")])
_SCORED = np.dtype([("p", "<f8"), ("pos", "<u2"), ("neg", "<u2")])


def _records(names: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], names=list(names))


def _sent(names: dict, rows, most: int = 8 << 20):
    """Rows as record batches of some ``most`` bytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > most:
            yield _records(names, out)
            out, size = [], 0
    if out:
        yield _records(names, out)


def _by_key(batches, n: int):
    """(key, records) of batches sorted by their first ``n`` columns; the records of a key as an iterator of the other columns, which must be used up."""
    rows = ((tuple(batch.column(j)[i].as_py() for j in range(n)), tuple(batch.column(j)[i].as_py() for j in range(n, batch.num_columns))) for batch in batches for i in range(batch.num_rows))
    for key, some in itertools.groupby(rows, key=lambda r: r[0]):
        yield key, (r[1] for r in some)


def _hashed(repeats: range, seed: int):
    """Rows (_g, _i, _f, _t, _k) to packed hashes by repeat and slice of the hash."""
    names, prefixes = {"_g": pa.string(), "rep": pa.int32(), "slice": pa.int32(), "rows": pa.binary()}, [f"{seed}|{r}" for r in repeats]

    def told(g, parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        line = np.empty(table.num_rows, _HASHED)
        line["i"], line["f"] = table.column("_i").to_numpy(), table.column("_f").to_numpy()
        bits = min(8, max(0, math.ceil(math.log2(table.column("_t")[0].as_py() / ROWS))))  # the same in all of the group
        for r, h in zip(repeats, hash_numbers(prefixes, table.column("_k").combine_chunks()), strict=True):
            line["h"] = h
            top = (h >> np.uint32(24)).astype(np.uint8) >> (8 - bits)
            raw, ends = line[np.argsort(top, kind="stable")].tobytes(), np.cumsum(np.bincount(top, minlength=256)) * _HASHED.itemsize
            yield from ((g, r, s, raw[a:b]) for s, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if a < b)

    def run(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("_g").dictionary_encode()
            codes = coded.indices.to_numpy()
            for code, g in enumerate(coded.dictionary.to_pylist()):
                held.setdefault(g, []).append(batch.take(pa.array(np.flatnonzero(codes == code))))
                if sum(b.num_rows for b in held[g]) >= ROWS:
                    yield from _sent(names, told(g, held.pop(g)))
            if sum(b.num_rows for parts in held.values() for b in parts) > 16 * ROWS:
                for g in list(held):
                    yield from _sent(names, told(g, held.pop(g)))
        for g, parts in held.items():
            yield from _sent(names, told(g, parts))

    return run


def _ranked(batches):
    """Hashes sorted by (_g, rep, slice) to the rows' places in fold order, in order of the hash, a chunk at a time."""

    def told():
        now, rest, chunk = None, np.zeros(0, np.uint32), 0
        for (g, r, _), parts in _by_key(batches, 3):
            if now != (g, r):
                if len(rest):
                    yield (*now, chunk, rest.tobytes())
                now, rest, chunk = (g, r), rest[:0], 0
            some = np.frombuffer(b"".join(p for (p,) in parts), _HASHED)
            rest = np.concatenate([rest, some["f"][np.lexsort((some["i"], some["h"]))]])
            while len(rest) >= CHUNK:
                yield (*now, chunk, rest[:CHUNK].tobytes())
                rest, chunk = rest[CHUNK:], chunk + 1
        if len(rest):
            yield (*now, chunk, rest.tobytes())

    yield from _sent({"_g": pa.string(), "rep": pa.int32(), "chunk": pa.int32(), "f": pa.binary()}, told())


def _chunks(kind):
    """Values (_g, chunk, _i, v) in order to chunks."""

    def run(batches):
        told = (((g, c), np.array([v for _, v in rows], kind)) for (g, c), rows in _by_key(batches, 2))
        yield from _sent({"_g": pa.string(), "chunk": pa.int32(), "v": pa.binary()}, ((*key, v.tobytes()) for key, v in told))

    return run


def _scattered(kind):
    """Places with the values of the same numbers to blocks of rows."""

    def told(batches):
        for batch in batches:
            for r in models._each(batch):
                f, v = np.frombuffer(r["f"], np.uint32), np.frombuffer(r["v"], kind)
                block = f // BLOCK
                order = np.argsort(block, kind="stable")
                at, v, block = (f[order] % BLOCK).astype(np.uint16), v[order], block[order]
                ends = np.flatnonzero(np.diff(block, append=-1.0)) + 1
                yield from ((r["_g"], int(block[a]), r["rep"], at[a:b].tobytes(), v[a:b].tobytes()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    return lambda batches: _sent({"_g": pa.string(), "_b": pa.int32(), "rep": pa.int32(), "at": pa.binary(), "v": pa.binary()}, told(batches))


def _gathered(kind, repeats: range):
    """Values sorted by block to one record a block, repeat after repeat, with each repeat's positive and known labels."""

    def told(batches):
        for (g, b), parts in _by_key(batches, 2):
            v, n = np.zeros((len(repeats), BLOCK), kind), 0
            for r, at, some in parts:
                at = np.frombuffer(at, np.uint16)
                v[r - repeats[0], at] = np.frombuffer(some, kind)
                n = max(n, int(at.max()) + 1)
            v = v[:, :n]
            yield g, b, v.tobytes(), (v == 1).sum(1).tolist(), (v >= 0).sum(1).tolist()

    return lambda batches: _sent({"_g": pa.string(), "_b": pa.int32(), "v": pa.binary(), "pos": pa.list_(pa.int64()), "known": pa.list_(pa.int64())}, told(batches))


def _packed(width: int):
    """Rows (_g, _b, _f, x, _code) in order to blocks."""

    def told(batches):
        for (g, b), rows in _by_key(batches, 2):
            _, x, code = zip(*rows, strict=True)
            yield g, b, np.array(x, float).reshape(-1, width).tobytes(), np.array(code, np.uint8).tobytes()

    return lambda batches: _sent({"_g": pa.string(), "_b": pa.int32(), "x": pa.binary(), "code": pa.binary()}, told(batches))


def _folded(n_repeats: int):
    """Blocks with dealt labels, and the positive and known labels of the blocks before, to codes of all repeats."""

    def told(batches):
        for batch in batches:
            for r in models._each(batch):
                y = np.frombuffer(r["v"], np.int8).reshape(n_repeats, -1)
                won, known = np.array(r["won"])[:, None], np.array(r["seen"])[:, None]
                place = np.where(y == 1, won + np.cumsum(y == 1, 1) - 1, known - won + np.cumsum(y == 0, 1) - 1)
                code = np.where((y < 0) | (r["_k"] < 2), OUT, 2 * (place % max(r["_k"], 1)) + y).astype(np.uint8)
                yield r["_g"], r["_b"], r["x"], code.tobytes(), b""

    return lambda batches: _sent({"_g": pa.string(), "_b": pa.int32(), "x": pa.binary(), "code": pa.binary(), "v": pa.binary()}, told(batches))


def _repeat(r: dict, n_repeats: int, width: int):
    """(x, code) of a block's rows in each repeat."""
    x = np.frombuffer(r["x"]).reshape(-1, width)
    code = np.frombuffer(r["code"], np.uint8).reshape(-1, len(x))
    v = np.frombuffer(r["v"]).reshape(-1, len(x)) if r["v"] else None
    for i in range(n_repeats):
        own = x if v is None else np.column_stack([x[:, :-1], v[i]])
        yield own, code[i if len(code) > 1 else 0]


def _masked(x, used: int):
    """A model's features, the others zero, and the rows in which it has them all."""
    good = np.isfinite(x[:, :used]).all(1)
    return (x if used == x.shape[1] else np.column_stack([x[:, :used], np.zeros((len(x), x.shape[1] - used))])), good


def _null_sums(n_repeats: int, uses: list[int], folds: int, width: int):
    """Blocks with their group's state to sums, in the form of :func:`models._summed`; repeats whose fits are done are left out."""
    one, done, fits = models._sums(width, folds), models._columns(width)["done"], len(uses) * n_repeats * folds
    size = 2 + width + 1 + (width + 1) * (width + 2) // 2

    def told(batches):
        held = {}
        for batch in batches:
            for r in models._each(batch):
                if r["design"] not in held:
                    held[r["design"]] = [r["frame"], r["state"], np.zeros((2, len(uses), n_repeats, folds, size))]
                frame, state = np.frombuffer(r["frame"]).reshape(2, width), np.frombuffer(r["state"]).reshape(len(uses), n_repeats, folds, -1)
                for i, (x, code) in enumerate(_repeat(r, n_repeats, width)):
                    for m, used in enumerate(uses):
                        if (state[m, i][:, done] > 0).all():
                            continue
                        z, good = _masked(x, used)
                        good &= code != OUT
                        bits = ((1 << folds) - 1) & ~(1 << (code[good] >> 1).astype(np.int64))
                        held[r["design"]][2][:, m, i] += one((code[good] & 1).astype(float), z[good], bits, frame, state[m, i])
        for g, (frame, state, sums) in held.items():
            yield g, frame, state, sums.reshape(2, fits, size).tobytes()

    return lambda batches: _sent({"design": pa.string(), "frame": pa.binary(), "state": pa.binary(), "sums": pa.binary()}, told(batches))


def _scores(r: dict, n_repeats: int, uses: list[int], folds: int, width: int):
    """(model, repeat, scores, labels) of a block's rows, each by the fit that leaves its fold out."""
    at = models._columns(width)
    (center, spread), state = np.frombuffer(r["frame"]).reshape(2, width), np.frombuffer(r["state"]).reshape(len(uses) * n_repeats * folds, -1)
    slopes = state[:, at["best"]][:, :width] / spread
    lines = np.column_stack([slopes, state[:, at["best"]][:, width] - slopes @ center])
    lines[state[:, at["rows"]][:, 0] < 1] = np.nan
    lines = lines.reshape(len(uses), n_repeats, folds, -1)
    for i, (x, code) in enumerate(_repeat(r, n_repeats, width)):
        for m, used in enumerate(uses):
            z, good = _masked(x, used)
            good &= code != OUT
            line = lines[m, i][code[good] >> 1]
            t = line[:, width]
            for j in range(width):  # in the same order for all rows, so that equal rows have equal scores
                t = t + line[:, j] * z[good, j]
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-t))
            told = ~np.isnan(p)
            yield m, i, p[told], code[good][told] & 1


def _bounds(n_repeats: int, uses: list[int], folds: int, width: int):
    """A block of each group to the bounds of its slices of scores; blocks are in order of hashes, so one is as good as a sample."""

    def told(batches):
        for batch in batches:
            for r in models._each(batch):
                n = math.ceil(r["_t"] / SLICE)
                out = np.ones((len(uses), n_repeats, n - 1))
                for m, i, p, _ in _scores(r, n_repeats, uses, folds, width):
                    if len(p):
                        out[m, i] = np.quantile(p, np.arange(1, n) / n, method="lower")
                yield r["design"], out.tobytes()

    return lambda batches: _sent({"_of": pa.string(), "bounds": pa.binary()}, told(batches))


def _scored(n_repeats: int, uses: list[int], folds: int, width: int):
    """Blocks with states and bounds to packed scores, equal ones counted, by model, repeat and slice."""

    def told(batches):
        for batch in batches:
            for r in models._each(batch):
                bounds = np.frombuffer(r["bounds"]).reshape(len(uses), n_repeats, -1)
                for m, i, p, y in _scores(r, n_repeats, uses, folds, width):
                    if not len(p):
                        continue
                    values, place = np.unique(p, return_inverse=True)
                    line = np.empty(len(values), _SCORED)
                    n, line["p"] = np.bincount(place), values
                    line["pos"] = np.bincount(place, weights=y)
                    line["neg"] = n - line["pos"]
                    cut = np.searchsorted(values, bounds[m, i], "right")
                    yield from ((r["design"], m, i, s, line[a:b].tobytes()) for s, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(line)], strict=True)) if a < b)

    return lambda batches: _sent({"_g": pa.string(), "m": pa.int32(), "rep": pa.int32(), "slice": pa.int32(), "rows": pa.binary()}, told(batches))


def _won(batches):
    """Packed scores sorted by (_g, m, rep, slice) to the slice's rows of each class and the pairs won inside it."""

    def told():
        for key, parts in _by_key(batches, 4):
            line = np.frombuffer(b"".join(p for (p,) in parts), _SCORED)
            line = line[np.argsort(line["p"], kind="stable")]
            starts = np.flatnonzero(np.append(True, np.diff(line["p"]) > 0))
            pos, neg = (np.add.reduceat(line[c].astype(float), starts) for c in ("pos", "neg"))
            yield (*key, pos.sum(), neg.sum(), (pos * (np.cumsum(neg) - neg / 2)).sum())

    yield from _sent({"_g": pa.string(), "m": pa.int32(), "rep": pa.int32(), "slice": pa.int32(), "pos": pa.float64(), "neg": pa.float64(), "won": pa.float64()}, told())


def null_aurocs(df: DataFrame, groups: list[str], key: str, label: str, base: list[str], feature: str, repeats: int, shuffle: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(groups, null_rep, auc_base, auc_plus): cross-validated AUROCs of the baseline and of the baseline with ``feature`` when labels (``shuffle`` "label") or the feature ("feature": auc_base is NULL) are dealt anew.

    Values in key order go to rows in hash order, as in :func:`resample.permuted`; folds are those of :func:`models.cross_predict` on the dealt rows, and small groups have NULL as in :func:`models.guarded_auroc`."""
    width, by_label = len(base) + 1, shuffle == "label"
    uses = [len(base), width] if by_label else [width]
    kind, cut = (np.int8, "tinyint") if by_label else (np.float64, "double")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [f"_g{i}" for i in range(len(groups))]
    number = lambda c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")).otherwise(float("nan"))
    rows = df.select(*[F.col(g).alias(o) for g, o in zip(groups, own, strict=True)], F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"), F.array(*map(number, [*base, feature])).alias("x"))
    sizes = rows.groupBy(*own).agg(F.count("*").alias("_t"), F.sum("_y").alias("_p"), F.count("_y").alias("_n"), metrics.estimable(F.col("_y")).alias("_ok"))
    sizes = settled(sizes.withColumn("_k", F.coalesce(F.least(F.lit(folds), F.col("_p"), F.col("_n") - F.col("_p")), F.lit(0)).cast("int")).withColumn("_g", F.to_json(F.struct(F.lit(0), *own), {"ignoreNullFields": "false"})), "sizes", passed=True)
    rows = numbered(rows, own, slice_of(rows, "_key"), [F.col("_key")], "_i")
    rows = _hash_order(rows.withColumn("_r", F.lit(0)), own, seed, "_r", "_key", "_f")
    if by_label:
        rows = rows.withColumn("_code", F.lit(OUT))
    else:
        told = stratified_folds(rows.where("_y is not null").select(*own, "_key", "_y"), own, "_key", "_y", folds, 1, seed)
        rows = joined(rows, told.select(*own, "_key", "fold"), [*own, "_key"], "left").withColumn("_code", F.coalesce(2 * F.col("fold") + F.col("_y"), F.lit(OUT)))
    rows = rows.withColumn("_g", F.to_json(F.struct(F.lit(0), *own), {"ignoreNullFields": "false"})).join(F.broadcast(sizes.select("_g", "_t")), "_g")  # a row for each group
    rows = settled(rows.select("_g", "_t", F.col("_i").cast("long").alias("_i"), F.col("_f").cast("long").alias("_f"), suffix(F.col("_key")).alias("_k"), "x", "_y", F.col("_code").cast("int").alias("_code")), "rows", small=False, passed=True)
    value = F.coalesce(F.col("_y"), F.lit(-1)).cast("int") if by_label else F.col("x")[width - 1]
    values = rows.select("_g", F.floor(F.col("_i") / CHUNK).cast("int").alias("chunk"), "_i", value.alias("v"))
    values = settled(values.repartition(n, "_g", "chunk").sortWithinPartitions("_g", "chunk", "_i").mapInArrow(_chunks(kind), "_g string, chunk int, v binary"), "values", small=False, passed=True, packed=True)
    blocks = rows.select("_g", F.floor(F.col("_f") / BLOCK).cast("int").alias("_b"), "_f", "x", "_code")
    blocks = settled(blocks.repartition(n, "_g", "_b").sortWithinPartitions("_g", "_b", "_f").mapInArrow(_packed(width), "_g string, _b int, x binary, code binary"), "blocks", small=False, passed=True, packed=True)
    real = lambda f, i: F.coalesce(f(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])), F.lit(0.0))
    frames = settled(rows.groupBy("_g").agg(*[F.array(*[real(f, i) for i in range(width)]).alias(c) for c, f in (("center", F.avg), ("spread", F.stddev_pop))]), "frames", passed=True)

    out, size = None, min(max(1, ROUND // max(rows.count(), 1)), repeats)
    for first in range(0, repeats, size):
        told = _round(rows, values, blocks, frames, sizes, range(first, min(first + size, repeats)), uses, width, folds, seed, kind, n)
        out = told if out is None else out.unionByName(told)
    auc = lambda m: F.max(F.when(F.col("m") == m, F.col("auc")))
    found = out.groupBy("_g", "null_rep").agg((auc(0) if by_label else F.lit(None).cast("double")).alias("auc_base"), auc(len(uses) - 1).alias("auc_plus"))
    every = sizes.withColumn("null_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    found = every.join(found, ["_g", "null_rep"], "left")
    return found.select(*[F.col(o).alias(g) for g, o in zip(groups, own, strict=True)], "null_rep", *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in ("auc_base", "auc_plus")])


def _round(rows, values, blocks, frames, sizes, repeats: range, uses, width: int, folds: int, seed: int, kind, n: int) -> DataFrame:
    """(_g, m, null_rep, auc) of some repeats."""
    k, by_label = len(repeats), kind is np.int8
    shape = (k, uses, folds, width)
    hashed = rows.select("_g", "_i", "_f", "_t", "_k").repartition(n, "_k").mapInArrow(_hashed(repeats, seed), "_g string, rep int, slice int, rows binary")
    places = settled(hashed.repartition(n, "_g", "rep").sortWithinPartitions("_g", "rep", "slice").mapInArrow(_ranked, "_g string, rep int, chunk int, f binary"), "places", small=False, passed=True, packed=True)
    sent = places.join(values, ["_g", "chunk"]).mapInArrow(_scattered(kind), "_g string, _b int, rep int, at binary, v binary")
    dealt = settled(sent.repartition(n, "_g", "_b").sortWithinPartitions("_g", "_b").mapInArrow(_gathered(kind, repeats), "_g string, _b int, v binary, pos array<long>, known array<long>"), "dealt", small=False, passed=True, packed=True)
    if by_label:
        before = Window.partitionBy("_g", "rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block and repeat
        each = dealt.select("_g", "_b", F.posexplode(F.arrays_zip("pos", "known")).alias("rep", "_e")).select("_g", "_b", "rep", *[F.coalesce(F.sum(f"_e.{c}").over(before), F.lit(0)).alias(c) for c in ("pos", "known")])
        each = each.groupBy("_g", "_b").agg(F.sort_array(F.collect_list(F.struct("rep", "pos", "known"))).alias("_e")).select("_g", "_b", F.col("_e.pos").alias("won"), F.col("_e.known").alias("seen"))
        told = blocks.select("_g", "_b", "x").join(dealt.select("_g", "_b", "v"), ["_g", "_b"]).join(each, ["_g", "_b"]).join(F.broadcast(sizes.select("_g", "_k")), "_g")
        told = told.mapInArrow(_folded(k), "_g string, _b int, x binary, code binary, v binary")
    else:
        told = blocks.join(dealt.select("_g", "_b", "v"), ["_g", "_b"])
    told = settled(told.select(F.col("_g").alias("design"), "_b", "x", "code", "v"), "blocks", small=False, passed=True, packed=True)
    fits = len(uses) * k * folds
    states = models.stepped(told, models.framed(frames.withColumnRenamed("_g", "design"), width, fits), _null_sums(*shape), width, fits)
    states = settled(states, "states", small=False, passed=True, packed=True)
    scoring = told.join(F.broadcast(states), "design")  # a state for each group
    sample = scoring.where("_b = 0").join(F.broadcast(sizes.select(F.col("_g").alias("design"), "_t")), "design")
    bounds = settled(sample.mapInArrow(_bounds(*shape), "_of string, bounds binary"), "bounds", passed=True, packed=True)
    scored = scoring.join(F.broadcast(bounds), F.col("design") == F.col("_of")).mapInArrow(_scored(*shape), "_g string, m int, rep int, slice int, rows binary")
    keys = ["_g", "m", "rep", "slice"]
    won = scored.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_won, "_g string, m int, rep int, slice int, pos double, neg double, won double")
    below = Window.partitionBy("_g", "m", "rep").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # slices, not rows
    won = won.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    auc = won.groupBy("_g", "m", "rep").agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    return settled(auc.select("_g", "m", (F.col("rep") + repeats[0]).alias("null_rep"), "auc"), "aurocs", passed=True, packed=True)
