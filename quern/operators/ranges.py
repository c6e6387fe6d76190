"""Orders of whole tables without one task that has them all: ranges, and what crosses their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.readers import scratch


def _ranged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows as a written table, sorted in ranges of the keys, with the number of its range as part."""
    at = scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def _earlier(counts: DataFrame) -> DataFrame:
    """part and before: what the ranges before it count (n); one row a range."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Add rank: the row's place from 0 in the whole order."""
    held = _ranged(rows, list(order))
    before = _earlier(held.groupBy("part").agg(F.count("*").alias("n")))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return held.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + place).drop("before", "part")


def compared(rows: DataFrame, by: list[str], order: str, check: Column, *carried: str) -> DataFrame:
    """Add part and same: whether `check` holds against the row before in its group, whose
    columns it sees as before.<name>.

    Rows are compared within their range; what the last row of a range carries over its edge
    is one row a range.  A group of any length is so spread over all ranges.
    """
    keys = [*by, order]
    held = [*keys, *carried]
    ranges = _ranged(rows, keys)
    edges = ranges.groupBy("part").agg(F.max_by(F.struct(*held), F.struct(*keys)).alias("edge"))
    edges = edges.select("part", F.lag("edge").over(Window.orderBy("part")).alias("edge"))
    before = F.coalesce(F.lag(F.struct(*held)).over(Window.partitionBy("part").orderBy(*keys)), F.col("edge"))
    joined = ranges.join(F.broadcast(edges), "part").withColumn("before", before)
    for c in by:
        check = check & F.col(c).eqNullSafe(F.col(f"before.{c}"))
    return joined.withColumn("same", F.coalesce(F.col("before").isNotNull() & check, F.lit(False))).drop("edge", "before")


def runs(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add run to rows of compared(): the number of rows so far that do not continue one."""
    begun = F.when(F.col("same"), 0).otherwise(1)
    before = _earlier(rows.groupBy("part").agg(F.sum(begun).alias("n")))
    within = Window.partitionBy("part").orderBy(*by, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(before), "part").withColumn("run", F.col("before") + F.sum(begun).over(within)).drop("before", "part", "same")
