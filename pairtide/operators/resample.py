"""Seeded resampling by hashes: bootstraps as draw counts, permutations and folds as hash order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.hashes import ROWS, hash_numbers, suffix
from ..functions.scalars import hash_number, joined, six
from .ranking import numbered, slice_of


def _numbered(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Rows numbered in the order of a key; keys that are no numbers are one slice."""
    return numbered(df, groups, slice_of(df, key), [F.col(key)], "_i")


def _hash_order(df: DataFrame, groups: list[str], seed: int, rep: str, key: str, name: str) -> DataFrame:
    """Rows numbered in the order of their hashes, 256 slices of them a group."""
    df = df.withColumn("_h", hash_number(seed, F.col(rep), F.col(key)))
    return numbered(df, groups, F.shiftright("_h", 24), [F.col("_h"), F.col(key)], name).drop("_h")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all shuffle partitions before its rows are multiplied; adaptive execution would join small ones into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def draws(df: DataFrame, groups: list[str], key: str, columns: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """(groups, key, columns, reps): each row with the repeats that draw it, a repeat as often as it does; rows that none draws are left out.

    Draw d of a repeat takes row hash(seed, rep, key of row d) mod n of its group, so every row makes one draw; a row is drawn about once a repeat."""
    total = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    rows = _numbered(df.select(*groups, key, *columns), groups, key)
    hits = _spread(rows.select(*groups, key), key).join(total, groups).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hits = hits.select(*groups, (hash_number(seed, F.col("rep"), F.col(key)) % F.col("_n")).cast("int").alias("_i"), "rep")
    return hits.groupBy(*groups, "_i").agg(F.collect_list("rep").alias("reps")).join(rows, [*groups, "_i"]).drop("_i")


#: Rows of a slice of the draws, and of a block of rows that draw at once.
SLOTS, DRAWING = 1 << 14, 1 << 16
#: Totals of a repeat: rows of each class, won pairs, scores and squared errors.
SUMS = ("pos", "neg", "won", "sum_p", "sum_q")


def _kept(schema, rows: list[tuple], keys: int, more: dict) -> pa.RecordBatch:
    """Records of a group's values and packed numbers."""
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[schema.field(i).type for i in range(keys)], *more.values()], strict=True)], names=[*[schema.field(i).name for i in range(keys)], *more])


def _drawing(n_groups: int, repeats: int, seed: int):
    """Numbered rows (groups, _g, _i, _n, _k, _y, _s) to packed records by slice of their group: the draws that hit the slice, and the slice's own rows.

    A draw is two bytes, its place in the slice; the draws of a record lie in the order of repeats, whose counts come first."""
    more = {"_slice": pa.int64(), "counts": pa.binary(), "drawn": pa.binary(), "place": pa.binary(), "y": pa.binary(), "s": pa.binary()}
    prefixes = [f"{seed}|{rep}" for rep in range(repeats)]

    def packed(table):
        n, size = table.column("_n")[0].as_py(), table.num_rows
        group = tuple(table.column(i)[0].as_py() for i in range(n_groups))
        starts = np.arange(0, n, SLOTS)
        low, cuts = np.empty((repeats, size), np.uint16), np.empty((repeats, len(starts) + 1), np.int64)
        keys = table.column("_k").combine_chunks()
        hits = np.empty((repeats, size), np.uint32)
        for at in range(0, size, ROWS):
            for rep, h in enumerate(hash_numbers(prefixes, keys[at : at + ROWS])):
                hits[rep, at : at + ROWS] = h % np.uint32(n)
        for rep in range(repeats):
            hits[rep].sort()
            cuts[rep, :-1] = np.searchsorted(hits[rep], starts.astype(np.uint32))
            low[rep] = hits[rep] & (SLOTS - 1)
        del hits
        cuts[:, -1] = size
        own = table.column("_i").to_numpy()
        y, s = table.column("_y").to_numpy(), table.column("_s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
        order = np.argsort(own)
        edges = np.searchsorted(own[order], np.append(starts, n))
        for j in range(len(starts)):
            parts = [low[rep, a:b] for rep, (a, b) in enumerate(zip(cuts[:, j].tolist(), cuts[:, j + 1].tolist(), strict=True))]
            here = order[edges[j] : edges[j + 1]]
            yield (*group, j, (cuts[:, j + 1] - cuts[:, j]).astype(np.uint32).tobytes(), np.concatenate(parts).tobytes(), (own[here] - j * SLOTS).astype(np.uint16).tobytes(), y[here].tobytes(), s[here].tobytes())

    def run(batches):
        held, n_held, schema = {}, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema, coded = batch.schema, batch.column("_g").dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for code, name in enumerate(names):
                part = pa.Table.from_batches([batch.take(pa.array(np.flatnonzero(codes == code)))])
                held.setdefault(name, []).append(part)
                n_held[name] = n_held.get(name, 0) + part.num_rows
            full = [g for g in held if n_held[g] >= DRAWING] or (list(held) if sum(n_held.values()) > 4 * DRAWING else [])
            for name in full:
                whole = pa.concat_tables(held.pop(name))
                del n_held[name]
                for at in range(0, whole.num_rows, DRAWING):
                    yield from _records(schema, packed(whole.slice(at, DRAWING)), n_groups, more)
        for parts in held.values():
            yield from _records(schema, packed(pa.concat_tables(parts)), n_groups, more)

    return run


def _records(schema, rows, keys: int, more: dict, most: int = 16 << 20):
    """Rows as record batches of some ``most`` bytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > most:
            yield _kept(schema, out, keys, more)
            out, size = [], 0
    if out:
        yield _kept(schema, out, keys, more)


def _weighing(n_groups: int, repeats: int, scores: int):
    """Records sorted by group and slice to the slice's rows, one for each score: how often every repeat draws the row."""

    def told(group, schema, w, rows):
        place, y, s = (np.concatenate(v) for v in zip(*rows, strict=True))
        for m in range(scores):
            good = np.flatnonzero(np.isfinite(s[:, m]) & ~np.isnan(y))
            for at in range(0, len(good), 2048):
                here = good[at : at + 2048]
                part = w[place[here]]
                top = part.max()
                part = part.astype(np.uint8 if top < 256 else np.uint32)
                width, n = part.itemsize * repeats, len(here)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(part.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v] * n, schema.field(i).type) for i, v in enumerate(group)], pa.array(np.full(n, m, np.int32)), pa.array(y[here].astype(np.int32)), pa.array(s[here, m]), packed],
                    names=[*[schema.field(i).name for i in range(n_groups)], "m", "_y", "_p", "w"],
                )

    def run(batches):
        now, schema = None, None
        for batch in batches:
            schema = batch.schema
            columns = [batch.column(i).to_pylist() for i in range(n_groups + 1)]
            for r, key in enumerate(zip(*columns, strict=True)):
                if key != now:
                    if now is not None:
                        yield from told(now[:-1], schema, w, rows)
                    now, rows, w = key, [], np.zeros((SLOTS, repeats), np.uint32)
                counts, drawn, place, y, s = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("counts", np.uint32), ("drawn", np.uint16), ("place", np.uint16), ("y", float), ("s", float)))
                at = drawn.astype(np.int64) * repeats + np.repeat(np.arange(repeats), counts)
                np.add.at(w.reshape(-1), at, np.uint32(1))
                if len(place):
                    rows.append((place, y, s.reshape(-1, scores)))
        if now is not None:
            yield from told(now[:-1], schema, w, rows)

    return run


def _running(keys: list[str], repeats: int, rows: int = 1024):
    """Arrow batches sorted by keys and score to one record a key: for each repeat the totals of the rows drawn, and the pairs won inside the key.

    Only running totals and the last score's totals are held, so a key may be of any size."""

    def record(key, totals, fields):
        out = {**dict(zip(keys, key, strict=True)), **dict(zip(SUMS, totals.tolist(), strict=True))}
        return pa.RecordBatch.from_pylist([out], schema=pa.schema([*fields, *((c, pa.list_(pa.float64())) for c in SUMS)]))

    def added(totals, at, tied, w, y, p):
        """The totals with some more rows; ``tied``: totals of both classes at the last score ``at``."""
        up, lead = y == 1, np.searchsorted(p, at, "right") if at is not None else 0
        wins, losses = w[up], w[~up]
        upto = np.vstack([np.zeros((1, repeats)), np.cumsum(losses, axis=0)])
        low, high = np.searchsorted(p[~up], p[up], "left"), np.searchsorted(p[~up], p[up], "right")
        won = (wins * (upto[low] + upto[high])).sum(0) / 2 + wins.sum(0) * totals[1]
        first = up[:lead]
        same = np.stack([w[:lead][first].sum(0), w[:lead][~first].sum(0)])
        won += (tied[0] * same[1] - same[0] * tied[1]) / 2
        sums = np.stack([y, 1 - y, p, (p - y) ** 2]) @ w
        totals[[0, 1, 3, 4]] += sums
        totals[2] += won
        last = np.searchsorted(p, p[-1], "left")
        end = np.stack([w[last:][up[last:]].sum(0), w[last:][~up[last:]].sum(0)])
        return p[-1], end + tied if last == 0 and at == p[-1] else end

    def run(batches):
        now, at = None, None
        for batch in batches:
            n, fields = batch.num_rows, [batch.schema.field(c) for c in keys]
            if not n:
                continue
            packed, label, x = batch.column("w"), batch.column("_y").to_numpy(zero_copy_only=False).astype(float), batch.column("_p").to_numpy(zero_copy_only=False)
            names = list(zip(*[batch.column(c).to_pylist() for c in keys], strict=True))
            heads = [0, *(i for i in range(1, n) if names[i] != names[i - 1])]
            for head, end in zip(heads, [*heads[1:], n], strict=True):
                if names[head] != now:
                    if now is not None:
                        yield record(now, totals, fields)
                    now, at = names[head], None
                    totals, tied = np.zeros((len(SUMS), repeats)), np.zeros((2, repeats))
                for first in range(head, end, rows):
                    part = slice(first, min(end, first + rows))
                    w = np.stack([np.frombuffer(v, np.uint8 if len(v) == repeats else np.uint32) for v in packed[part].to_pylist()]).astype(float)
                    at, tied = added(totals, at, tied, w, label[part], x[part])
        if now is not None:
            yield record(now, totals, fields)

    return run


def bootstrap_metrics(df: DataFrame, groups: list[str], key: str, label: str, scores: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """(groups, rep, m, auc, ece, brier) of score number m in each repeat; rows without a label or a finite score are drawn but not counted.

    The draws are those of :func:`draws`.  They are worked out block by block and travel to the slice of their group that they hit as two bytes each; there they become counts,
    and a row travels once a score with its counts, a byte a repeat.  Scores are cut by bin and slice, and sorted inside."""
    missing = F.lit(float("nan"))
    rows = numbered(df.select(*groups, key, label, *scores), groups, slice_of(df, key), [F.col(key)], "_i", "_n")
    rows = rows.select(
        *groups, F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}).alias("_g") if groups else F.lit("").alias("_g"), F.col("_i").cast("long").alias("_i"), F.col("_n").cast("long").alias("_n"), suffix(F.col(key)).alias("_k"),
        F.coalesce(F.col(label).cast("double"), missing).alias("_y"), F.array(*[F.coalesce(F.col(c).cast("double"), missing) for c in scores]).alias("_s"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    named = "".join(f"`{c}` {kinds[c]}, " for c in groups)
    hit = _spread(rows, "_k").mapInArrow(_drawing(len(groups), repeats, seed), named + "_slice long, counts binary, drawn binary, place binary, y binary, s binary")
    own = [*groups, "_slice"]
    hit = hit.repartition(*own).sortWithinPartitions(*own).mapInArrow(_weighing(len(groups), repeats, len(scores)), named + "m int, _y int, _p double, w binary")
    p, keys = F.col("_p"), [*groups, "m", "bin", "slice"]
    cut = hit.select(*groups, "m", metrics.bin_left(p).alias("bin"), metrics.score_slice(p).alias("slice"), "_y", "_p", "w")
    schema = named + "m int, bin int, slice int, " + ", ".join(f"{c} array<double>" for c in SUMS)
    sums = cut.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "_p").mapInArrow(_running(keys, repeats), schema)
    sums = sums.select(*keys, F.posexplode(F.arrays_zip(*SUMS)).alias("rep", "_s")).select(*keys, "rep", "_s.*")
    before = Window.partitionBy(*groups, "m", "rep").orderBy("bin", "slice").rowsBetween(Window.unboundedPreceding, -1)  # bins and slices, not rows
    sums = sums.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    bins = sums.groupBy(*groups, "m", "rep", "bin").agg(*[F.sum(c).alias(c) for c in SUMS])
    n = F.sum(F.col("pos") + F.col("neg"))
    return bins.groupBy(*groups, "rep", "m").agg(
        (F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"),
        (F.sum(F.abs(F.col("pos") - F.col("sum_p"))) / F.nullif(n, F.lit(0.0))).alias("ece"), (F.sum("sum_q") / F.nullif(n, F.lit(0.0))).alias("brier"),
    )


def bootstrap_auroc(df: DataFrame, groups: list[str], key: str, label: str, scores: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """(groups, rep) with the AUROC of every score in each repeat."""
    each = bootstrap_metrics(df, groups, key, label, scores, repeats, seed)
    return each.groupBy(*groups, "rep").agg(*[F.max(F.when(F.col("m") == i, F.col("auc"))).alias(f"auc_{s}") for i, s in enumerate(scores)])


def _interval(column: str, name: str) -> list[Column]:
    return [
        F.count(column).alias("n_repeats"), six(F.avg(column)).alias(f"{name}_mean"), six(F.stddev_pop(column)).alias(f"{name}_sd"),
        six(F.percentile(column, F.lit(0.025))).alias(f"{name}_low"), six(F.percentile(column, F.lit(0.975))).alias(f"{name}_high"),
    ]


def interval(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """Mean, population deviation and 95 % interval over repeats; missing repeats are left out."""
    return df.groupBy(*groups).agg(*_interval(column, name))


def bootstrap_deltas(df: DataFrame, groups: list[str], key: str, label: str, score: str | list[str], reference: str, repeats: int, seed: int = 42) -> DataFrame:
    """Intervals of the differences in AUROC, ECE and Brier score between a score and a reference on the same rows, drawn together; for a list of scores one row each, named by ``feature``."""
    several = [score] if isinstance(score, str) else score
    each = bootstrap_metrics(df, groups, key, label, [reference, *several], repeats, seed).withColumn("_of", F.explode(F.when(F.col("m") == 0, F.sequence(F.lit(1), F.lit(len(several)))).otherwise(F.array("m"))))
    both = lambda c: F.when(F.count(c) == 2, F.sum(F.when(F.col("m") == 0, -F.col(c)).otherwise(F.col(c))))
    deltas = each.groupBy(*groups, "_of", "rep").agg(*[both(c).alias(c) for c in ("auc", "ece", "brier")])
    out = deltas.groupBy(*groups, "_of").agg(*[c for name in ("auc", "ece", "brier") for c in _interval(name, f"delta_{name}")[name != "auc" :]])
    feature = F.element_at(F.array(*map(F.lit, several)), F.col("_of")).alias("feature")
    return out.select(*([] if isinstance(score, str) else [feature]), *[c for c in out.columns if c != "_of"])


def permuted(df: DataFrame, groups: list[str], key: str, columns: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """``df`` once per repeat with ``columns`` dealt anew among a group's rows: values in key order go to rows in hash order."""
    taken = _numbered(df, groups, key).select(*groups, "_i", *columns)
    rows = _spread(df.drop(*columns), key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return joined(_hash_order(rows, [*groups, "rep"], seed, "rep", key, "_i"), taken, [*groups, "_i"]).drop("_i")


def shuffled_order(df: DataFrame, key: str, repeats: int, seed: int = 42) -> DataFrame:
    """``df`` once per permutation with its hash order ``perm_order``."""
    return _spread(df, key).withColumn("permutation_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("perm_order", hash_number(seed, F.col("permutation_id"), F.col(key)))


def sequences(df: DataFrame, groups: list[str], key: str, n: int, length: int, seed: int = 42) -> DataFrame:
    """n sequences of ``length`` rows of each group, drawn with replacement: sequence_id, position and the row."""
    total = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    slots = total.withColumn("sequence_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(length))))
    slots = slots.withColumn("_i", (hash_number(seed, F.col("sequence_id"), F.col("position")) % F.col("_n")).cast("int"))
    return slots.drop("_n").join(_numbered(df, groups, key), [*groups, "_i"]).drop("_i")


def stratified_folds(df: DataFrame, groups: list[str], key: str, label: str, folds: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """``df`` once per repeat with a fold from 0; each class is dealt out evenly.

    The number of folds is the smallest of ``folds`` and the group's class sizes; a group in which it is below 2 gets NULL."""
    rows = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    sizes = df.groupBy(*groups).agg(F.sum(label).alias("_p"), F.count(label).alias("_n"))
    k = F.least(F.lit(folds), F.col("_p"), F.col("_n") - F.col("_p"))
    dealt = joined(_hash_order(rows, [*groups, "rep", label], seed, "rep", key, "_r"), sizes, groups)
    return dealt.withColumn("fold", F.when(k >= 2, (F.col("_r") % k).cast("int"))).drop("_r", "_p", "_n")
