"""Statistics of a sparse matrix in coordinate form; zeros that are not stored count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gene_statistics(matrix: DataFrame, n_cells: int | None = None) -> DataFrame:
    """gene_id, mean, variance (population, never negative) and detection rate over all cells."""
    if n_cells is None:
        cells = matrix.agg(F.countDistinct("cell_id").cast("double").alias("_n"))
    else:
        cells = matrix.sparkSession.range(1).select(F.lit(float(n_cells)).alias("_n"))
    sums = matrix.groupBy("gene_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"), F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("_d"))
    mean = F.col("_s") / F.col("_n")
    return sums.crossJoin(F.broadcast(cells)).select(  # one row
        "gene_id", mean.alias("mean"), F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)).alias("variance"), (F.col("_d") / F.col("_n")).alias("detection")
    )
