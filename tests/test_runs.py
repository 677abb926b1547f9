"""Runs that are pruned when a query runs, and validity as bitmaps."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pairtide.operators import pairs
from pairtide.sources import tables


def test_only_wanted_runs_are_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(600).select("id", (F.col("id") % 3).cast("int").alias("seed"), (F.col("id") % 4).cast("int").alias("layer"), F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("domain"))
    tables.write_runs(rows, path, ["domain", "seed", "layer"])
    catalog = tables.settled(tables.run_catalog(spark, path, ("domain", "seed", "layer")), "catalog")
    wanted = catalog.where("layer = 3 and domain = 'd1'")
    got = tables.read_runs(spark, path, wanted, ["domain", "seed", "layer"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "PartitionFilters" in plan
    assert sorted(r.id for r in got.collect()) == [i for i in range(600) if i % 4 == 3]
    for file in tmp_path.glob("runs/domain=d0/**/*.parquet"):
        file.write_bytes(b"no parquet")
    assert got.count() == 150  # the damaged runs are not opened


def test_bitmaps_equal_rows(spark):
    n = 70_000
    numbers = spark.range(n).select(F.col("id").alias("pair"))
    rows = numbers.withColumn("layer", F.explode(F.array(*map(F.lit, range(3))))).withColumn("ok", F.when(F.hash("pair", "layer") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.hash("layer", "pair") % 3 != 0))
    maps = pairs.validity_maps(rows, "pair", ["layer"])
    assert maps.count() <= 4 * 3
    got = {r.pair for r in pairs.valid_in_all(numbers, maps, 3, "pair").collect()}
    want = {r.pair for r in pairs.valid_everywhere(rows.withColumn("ok", F.coalesce("ok", F.lit(False))), ["pair"], 3).collect()}
    assert got == want and 0 < len(got) < n
    assert pairs.valid_in_all(numbers, maps.where("layer < 2"), 3, "pair").count() == 0


def test_settled_tables_go_with_their_block(spark, tmp_path):
    kept = tables.settled(spark.range(3), "kept")
    with tables.passing(spark):
        inner = tables.settled(kept.withColumn("x", F.col("id") * 2), "inner")
        files = inner.inputFiles()
        inner.write.parquet(str(tmp_path / "out"))
    assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)
    assert spark.read.parquet(str(tmp_path / "out")).count() == kept.count() == 3
