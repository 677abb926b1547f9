"""Geometry of vectors held as array<double> columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subspace

LEAST_NORM = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(LEAST_NORM))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def neg_l2(a: Column, b: Column) -> Column:
    d = subtract(a, b)
    return -F.sqrt(dot(d, d))


def feature(name: str, a: Column, b: Column, centroid: Column | None = None) -> Column:
    """The pair feature of a name; an unknown name is an error. Low-rank names expect projected vectors."""
    base = re.sub(r"^pca\d+_", "", name)
    if base == "centered_cosine":
        return cosine(subtract(a, centroid), subtract(b, centroid)) if centroid is not None else cosine(a, b)
    try:
        return {"cosine": cosine, "dot": dot, "neg_l2": neg_l2}[base](a, b)
    except KeyError:
        raise ValueError(f"unknown feature {name!r}") from None


def mean_vectors(df: DataFrame, vector: str, *groups: str) -> DataFrame:
    """The mean vector of each group, over all its rows; without groups the centroid of the table, one row."""
    long = df.select(*groups, F.posexplode(vector).alias("k", "v"))
    by_place = long.groupBy(*groups, "k").agg(F.avg("v").alias("v"))
    return by_place.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("mean"))


def low_rank(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``df`` with ``vector`` replaced by its projection on the first k principal components of the centred table."""
    return subspace.projected(df, vector, subspace.components(df, vector, k))
