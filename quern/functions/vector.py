"""Vectors as arrays of numbers; every reduction runs in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def centroids(vectors: DataFrame, vector: str, *by: str) -> DataFrame:
    """Per group: the mean of the unit vectors, scaled to length one again.

    The sum goes by dimension with map-side aggregates, so only (group, dimension) rows are
    shuffled whatever the number of vectors.
    """
    at = vectors.select(*by, F.posexplode(unit(F.col(vector))).alias("dim", "x"))
    means = at.groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    whole = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    return whole.select(*by, unit(F.col("mean")).alias("centroid"))


def hash_embedding(text: Column, dim: int) -> Column:
    """A unit vector that depends on the text alone, in place of a model: component i comes from
    the MD5 of i and the text, between -0.5 and 0.5."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", i.cast("string"), text)), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), part))
