"""Merkle manifest of a dataset: a tree a group, a root over the groups, and a proof for every row.

Leaves are numbered along their group's order and dealt in aligned buckets of ``FAN ** DEPTH``.  In each bucket DuckDB, on the executor, makes the
levels: ordered ``string_agg`` of eight nodes' digests, then ``sha256``.  Bucket roots are the nodes of the next
table, which is dealt in buckets in the same way until a group has one node; the groups' roots, in order, are climbed likewise.  Outer proofs are then joined downwards, one row a
bucket, and the last pass over the leaves folds every row's proof.  A task holds one bucket, whatever a group's size, and the driver one root.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, written

FAN = 8
#: Levels that one bucket makes; it has 8^4 = 4,096 leaves.
DEPTH = 4

_PATH = "array<struct<left: string, right: string>>"
_PATHS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 bytes' number, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _engine():
    """One in-memory engine a worker process, on the task's own core."""
    import duckdb

    return kept("engine", lambda: duckdb.connect(config={"threads": 1, "memory_limit": "1GB"}))


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _levels(count: int) -> str:
    """``count`` levels over the table ``nodes`` (i from 0 in the bucket, node): r1, r2, ... (i, nodes in order, node); r0 are the nodes themselves."""
    out = ["r0 as (select i, node from nodes)"]
    for k in range(1, count + 1):
        out.append(f"r{k} as (select i // {FAN} as i, list(node order by i) as nodes, sha256(string_agg(node, '' order by i)) as node from r{k - 1} group by i // {FAN})")
    return ", ".join(out)


def _sides(k: int) -> tuple[str, str]:
    """The siblings before and after a row of level k - 1."""
    return f"array_to_string(r{k}.nodes[1 : p.i % {FAN}], '')", f"array_to_string(r{k}.nodes[p.i % {FAN} + 2 : {FAN}], '')"


def _bucket(nodes: pa.Table, *columns: str) -> tuple[object, int]:
    """An engine with the bucket as table ``nodes``, and the levels to make in it."""
    engine, size = _engine(), FAN**DEPTH
    index = nodes.column("idx").to_numpy() % size
    engine.register("nodes", pa.table({"i": index, "node": nodes.column("node"), **{c: nodes.column(c) for c in columns}}))
    return engine, min(DEPTH, height(nodes.column("n")[0].as_py()))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with idx, their number from 0 in their tree by ``order``, and n, the tree's rows; written once.

    The order is one range partitioning, so a tree of any size is spread; totals are one row a partition and tree."""
    at = written(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    runs = at.groupBy(tree, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    along = Window.partitionBy(tree).orderBy("_part")
    runs = runs.select(
        tree, "_part", "_first", F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n")
    )
    return at.join(runs, [tree, "_part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"idx div {FAN**DEPTH}"))


def climb(nodes: DataFrame) -> DataFrame:
    """(tree, idx, n, node): the roots of the aligned buckets of ``nodes`` (tree, idx, n, node)."""

    def run(key, table):
        engine, levels = _bucket(table)
        root = engine.sql(f"with {_levels(levels)} select node from r{levels}").fetchall()[0][0]
        n = table.column("n")[0].as_py()
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "idx": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // FAN**DEPTH)], pa.int64()), "node": pa.array([root], pa.string())})

    dealt = _dealt(nodes.select("tree", "idx", "n", "node"))
    return dealt.groupBy("tree", "bucket").applyInArrow(run, "tree string, idx long, n long, node string")


def paths(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(tree, idx, node, path, subroot): the siblings of every node up to the root of all, lowest level first; ``outer`` has (tree, bucket, path, subroot) of each bucket's root."""

    def run(table, above):
        table = table.sort_by("idx")
        engine, levels = _bucket(table)
        steps = ""
        for k in range(1, levels + 1):
            left, right = _sides(k)
            steps += f", p{k} as (select p.first, p.i // {FAN} as i, list_append(p.path, {{'left': {left}, 'right': {right}}}) as path from p{k - 1} p join r{k} on r{k}.i = p.i // {FAN})"
        start = '[]::struct("left" varchar, "right" varchar)[]'
        found = engine.sql(f"with {_levels(levels)}, p0 as (select i as first, i, {start} as path from nodes){steps} select path from p{levels} order by first").fetchall()
        rest = above.column("path")[0].as_py()
        whole = [path + rest for (path,) in found]
        subroot = pa.array([above.column("subroot")[0].as_py()] * len(whole), pa.string())
        return pa.table({"tree": table.column("tree"), "idx": table.column("idx"), "node": table.column("node"), "path": pa.array(whole, _PATHS), "subroot": subroot})

    dealt = _dealt(nodes.select("tree", "idx", "n", "node"))
    return dealt.groupBy("tree", "bucket").cogroup(outer.select("tree", "bucket", "path", "subroot").groupBy("tree", "bucket")).applyInArrow(run, f"tree string, idx long, node string, path {_PATH}, subroot string")


def folded(leaves: DataFrame, outer: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns of every leaf (tree, idx, n, node, seen), subroot, proof_sha256 and folded_root: the digest of all siblings, and the root that ``seen`` leads to."""

    def run(table, above):
        table = table.sort_by("idx")
        engine, levels = _bucket(table, "seen")
        steps = ""
        for k in range(1, levels + 1):
            left, right = _sides(k)
            steps += f", p{k} as (select first, i // {FAN} as i, proof || lo || hi as proof, sha256(lo || fold || hi) as fold from (select p.*, {left} as lo, {right} as hi from p{k - 1} p join r{k} on r{k}.i = p.i // {FAN}))"
        at = levels
        for step in above.column("path")[0].as_py():
            lo, hi = step["left"], step["right"]  # hexadecimal digits only
            steps += f", p{at + 1} as (select first, proof || '{lo}' || '{hi}' as proof, sha256('{lo}' || fold || '{hi}') as fold from p{at})"
            at += 1
        found = engine.sql(f"with {_levels(levels)}, p0 as (select i as first, i, '' as proof, seen as fold from nodes){steps} select sha256(proof), fold from p{at} order by first").fetchall()
        proofs, folds = zip(*found, strict=True)
        subroot = pa.array([above.column("subroot")[0].as_py()] * len(found), pa.string())
        return pa.table({**{c: table.column(c) for c in carried}, "subroot": subroot, "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folds, pa.string())})

    dealt = _dealt(leaves.select("tree", "idx", "n", "seen", *carried))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*carried).schema.fields)
    return dealt.groupBy("tree", "bucket").cogroup(outer.select("tree", "bucket", "path", "subroot").groupBy("tree", "bucket")).applyInArrow(run, f"{kinds}, subroot string, proof_sha256 string, folded_root string")


def _climbed(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` and the tables of roots above them, the last with one node a tree."""
    tables = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tables.append(written(climb(tables[-1]), "nodes"))
        most = -(-most // FAN**DEPTH)
    return tables


def manifest(rows: DataFrame, *, key: str = "doc_id", group: str = "lang", leaf: str = "leaf", seen: str = "seen") -> DataFrame:
    """One row per row of ``rows``: key, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` is the recorded digest and ``seen`` the digest found later (NULL: the same); verified tells whether the row's proof leads from ``seen`` to the root.
    Leaves ascend by key (null first, then by leaf); groups ascend by their UTF-8 bytes, a null group first and apart from an empty one.  Equal rows are leaves of their own.
    A group of one leaf is its own subroot.  An empty table gives an empty result; other columns are ignored."""
    named = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    own = rows.select(named.alias("tree"), F.col(f"`{key}`").alias("_key"), F.col(f"`{group}`").alias("_group"), F.col(f"`{leaf}`").alias("node"), F.coalesce(F.col(f"`{seen}`"), F.col(f"`{leaf}`")).alias("seen"))
    leaves = numbered(own, "tree", ["_key", "node", "seen"])
    tables = _climbed(leaves)
    subroots = tables[-1].select(F.col("tree").alias("_tree"), F.lit("").alias("tree"), "node")
    tops = written(numbered(subroots, "tree", ["_tree"]), "subroots")
    heights = _climbed(tops)
    top = heights[-1].select("node").first()
    root = F.lit(top[0] if top else None).cast("string")

    none = F.array().cast(_PATH).alias("path")
    if len(heights) == 1:
        outer = tops.select("idx", "node", none)
    else:
        outer = heights[-1].select("tree", F.lit(0).cast("long").alias("bucket"), none, F.lit(None).cast("string").alias("subroot"))
        for nodes in heights[-2::-1]:
            outer = paths(nodes, outer).withColumnRenamed("idx", "bucket")
        outer = outer.select(F.col("bucket").alias("idx"), "node", "path")
    outer = outer.join(tops.select("idx", "_tree"), "idx").select(F.col("_tree").alias("tree"), F.lit(0).cast("long").alias("bucket"), F.col("node").alias("subroot"), "path")
    outer = written(outer, "proofs")
    for nodes in tables[-2:0:-1]:
        outer = paths(nodes, outer).withColumnRenamed("idx", "bucket")
    told = folded(leaves, outer, ["_key", "_group", "node"])
    return told.select(F.col("_key").alias(key), F.col("_group").alias(group), F.col("node").alias(leaf), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
