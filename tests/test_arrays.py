"""Array files: round trips, layers that are not read, row ranges, refusals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairtide.sources import arrays


@pytest.fixture
def cube(tmp_path):
    x = np.random.default_rng(1).normal(size=(3, 50, 4)).astype("float32")
    np.save(tmp_path / "cube.npy", x)
    return x, str(tmp_path / "cube.npy")


def test_layers_rows_and_ranges(spark, cube):
    x, path = cube
    df = arrays.read_arrays(spark, path, taskBytes="128")  # eight rows a task
    assert df.rdd.getNumPartitions() == 3 * 7
    got = {(r.layer, r.row): r.v for r in df.collect()}
    assert len(got) == 150 and all(np.array_equal(got[i, j], x[i, j].astype(float)) for i in range(3) for j in range(50))
    flat = arrays.read_arrays(spark, path, layered="false").where("row = 1").collect()
    assert [(r.layer, len(r.v)) for r in flat] == [(0, 200)]


def test_other_layers_are_not_read(spark, cube, tmp_path):
    """The file is cut after its first layer: any other read fails."""
    x, path = cube
    whole = open(path, "rb").read()
    (tmp_path / "cut.npy").write_bytes(whole[: len(whole) - 2 * 50 * 4 * 4])
    df = arrays.read_arrays(spark, str(tmp_path / "cut.npy"))
    only = df.where("layer = 0")
    assert only.rdd.getNumPartitions() == 1 and only.count() == 50
    assert df.where("layer < 1 and row > 10").count() == 39 and df.where(F.col("layer").isin(0)).count() == 50
    with pytest.raises(Exception, match="ends before"):
        df.where("layer >= 1").collect()


def test_round_trip_through_the_writer(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(layer, row, rng.normal(size=3).tolist()) for layer in (0, 2) for row in [*range(40), 50, 51]] + [(5, 7, [1.0])]
    df = spark.createDataFrame(rows, "layer int, row long, v array<double>").repartition(7)
    path = str(tmp_path / "out")
    arrays.write_arrays(df, path)
    back = arrays.read_arrays(spark, path)
    assert sorted((r.layer, r.row, r.v) for r in back.collect()) == sorted(rows)
    assert back.where("layer = 5").rdd.getNumPartitions() == 1 and back.where("layer = 1").count() == 0
    arrays.write_arrays(df.where("layer = 0"), path)  # written anew
    assert back.select("layer").distinct().count() == 1 or arrays.read_arrays(spark, path).select("layer").distinct().count() == 1
    arrays.write_arrays(df.where("layer = 5"), path, "append")
    assert arrays.read_arrays(spark, path).count() == 43 and not list((tmp_path / "out").glob("*.part"))


def test_empty_arrays_and_refusals(spark, tmp_path):
    np.save(tmp_path / "empty.npy", np.zeros((2, 0, 3)))
    assert arrays.read_arrays(spark, str(tmp_path / "empty.npy")).count() == 0
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "objects.npy", np.array(["a", 1], object))
    for name in ("columns", "objects"):
        with pytest.raises(Exception, match="row order"):
            arrays.read_arrays(spark, str(tmp_path / f"{name}.npy")).collect()
    with pytest.raises(Exception, match="none.npy"):
        arrays.read_arrays(spark, str(tmp_path / "none.npy")).collect()
