"""Labelled pair sets: positives from edges, negatives by anti-join, features by gathering both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, hash_number
from ..sources.tables import settled


def positives(edges: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Distinct pairs without self-loops, both ends in ``universe`` (one column ``node``) if it is given."""
    pairs = edges.where("source <> target").select("source", "target").distinct()
    if universe is not None:
        nodes = universe.select("node").distinct()
        for end in ("source", "target"):
            pairs = pairs.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    return pairs.select("source", "target")


DRAWS, NUMBER_SLICES = 4, 1024
#: Draws that are made besides five for every four wanted pairs.
FIRST_DRAWS = 1024


def numbered(nodes: DataFrame, column: str) -> DataFrame:
    """(column, i): the distinct values numbered from 0 in the order of 1,024 hash slices and of the values in each; only the slices' sizes meet in one task."""
    rows = nodes.select(column).distinct().withColumn("_s", hash_number(F.col(column)) % NUMBER_SLICES)
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    before = sizes.select("_s", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_s")) - F.col("_n")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_s").orderBy(column)) - 1
    return rows.withColumn("_r", inside).join(F.broadcast(before), "_s").select(column, (F.col("_b") + F.col("_r")).alias("i"))


def _first(rows: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The n rows that are smallest by a number, equal ones by ``ties``; only the slice at the boundary is ordered."""
    top = rows.agg(F.max(order)).first()[0]
    step = max(1, (top or 0) // 4096 + 1)
    total, cut = 0, None
    for s, c in sorted(rows.groupBy(F.floor(F.col(order) / step).alias("_s")).count().collect()):  # 4,096 rows at most
        if total + c >= n:
            cut = s
            break
        total += c
    if cut is None:
        return rows
    edge = rows.where((F.col(order) >= cut * step) & (F.col(order) < (cut + 1) * step)).orderBy(order, *ties).limit(n - total)
    return rows.where(F.col(order) < cut * step).unionByName(edge)


def negatives(positive: DataFrame, ratio: float = 3.0, seed: int = 42) -> DataFrame:
    """``ratio`` times as many pairs of a known source and a known target that are not positive; fewer only if there are no more.

    Draw d names a source and a target by two parts of the md5 of seed and d; new free pairs count in the order of the draws, so
    the work follows the size of the result and not of sources times targets.  Only where these are fewer than ``DRAWS`` times the wanted and
    positive pairs are all pairs listed, and numbered by a hash.  Draws behind the last wanted pair change nothing: few are made at first, and twice as many while pairs are missing."""
    positive = settled(positive, "positive", small=False)
    n_positive = positive.count()
    n = int(n_positive * ratio)
    sources, targets = (settled(numbered(positive, end), end, small=False) for end in ("source", "target"))
    n_sources, n_targets = sources.count(), targets.count()
    dense = n_sources * n_targets <= DRAWS * (n + n_positive)
    draws = n + n // 4 + FIRST_DRAWS
    while True:
        if dense:
            key = hash_number(seed, F.col("source"), F.col("target"))
            listed = sources.select("source").join(targets.select("target"), F.lit(True)).withColumn("d", key)
        else:
            d = positive.sparkSession.range(draws).select(F.col("id").alias("d"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))).alias("_h"))
            part = lambda at, size: F.conv(F.substring("_h", at, 8), 16, 10).cast("long") % size
            drawn = d.select("d", part(1, n_sources).alias("_i"), part(9, n_targets).alias("_j"))
            drawn = drawn.join(sources.withColumnRenamed("i", "_i"), "_i").join(targets.withColumnRenamed("i", "_j"), "_j")
            listed = drawn.groupBy("source", "target").agg(F.min("d").alias("d"))
        free = listed.where("source <> target").join(positive, ["source", "target"], "left_anti").select("source", "target", "d")
        free = settled(free, "free", small=False)
        if dense or free.count() >= n:  # equal hashes of listed pairs are told apart by the pair
            return _first(free, "d", n, "source", "target").select("source", "target")
        draws *= 2


def labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))


def gather(pairs: DataFrame, statistics: DataFrame, key: str = "gene_id") -> DataFrame:
    """Both ends' statistics beside each pair, as s_ and t_ columns; pairs with an unknown end go."""
    for end in ("source", "target"):
        renamed = statistics.select(F.col(key).alias(end), *[F.col(c).alias(f"{end[0]}_{c}") for c in statistics.columns if c != key])
        pairs = pairs.join(renamed, end)
    return pairs


def valid(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs all of whose ``columns`` are finite."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(F.col(c))
    return pairs.where(keep)


def valid_everywhere(rows: DataFrame, keys: list[str], combinations: int, ok: str = "ok") -> DataFrame:
    """The keys that have a row for each combination, all of them valid."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.bool_and(ok).alias("_ok")).where((F.col("_n") == combinations) & F.col("_ok")).select(*keys)


def validity_maps(rows: DataFrame, number: str, slices: list[str], ok: str = "ok") -> DataFrame:
    """(slices, bucket, bits): for every slice the bitmap of the numbers that are valid in it, 32,768 numbers a bucket.

    Tasks set bits before anything is shuffled, so a slice and bucket travels as one bitmap a task and not as rows."""
    n = F.col(number)
    return rows.where(ok).groupBy(*slices, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def valid_in_all(pairs: DataFrame, maps: DataFrame, combinations: int, number: str) -> DataFrame:
    """``pairs`` whose number is set in the bitmaps of all ``combinations`` slices; a slice without a bitmap has no valid pair."""
    both = maps.groupBy("bucket").agg(F.count("*").alias("_n"), F.bitmap_and_agg("bits").alias("_bits")).where(F.col("_n") == combinations)
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = pairs.withColumn("bucket", F.bitmap_bucket_number(number)).join(both.select("bucket", "_bits"), "bucket")
    return found.where(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1).drop("bucket", "_bits")


def matched(pairs: DataFrame, members: DataFrame, name: str = "matched") -> DataFrame:
    """A flag for pairs both of whose ends are in ``members`` (one column ``node``)."""
    nodes = members.select("node").distinct()
    out = pairs
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return out.withColumn(name, F.coalesce(F.col("_source") & F.col("_target"), F.lit(False))).drop("_source", "_target")


def map_chain(names: DataFrame, to_id: DataFrame, to_token: DataFrame, n_tokens: int) -> DataFrame:
    """name to id to token; names without either and tokens outside 0 to n_tokens - 1 go."""
    return names.distinct().join(to_id, "name").join(to_token, "id").where(F.col("token").between(0, n_tokens - 1)).select("name", "id", "token")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the smallest in hash order; a top-n that keeps n rows per task."""
    return df.withColumn("_h", hash_number(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")
