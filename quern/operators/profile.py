"""Counts, duplicates, histograms and descriptive figures of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.stats import floor_percentile


def counts(frame: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return frame.groupBy(*by).agg(F.count("*").alias(name))


def describe(frame: DataFrame, value: str, by: list[str]) -> DataFrame:
    """lo, hi, mean, median, std, p25 (linear) and p90 (floor index) per group."""
    one = frame.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.25).alias("p25"))
    return one.join(floor_percentile(frame, value, 90, by).withColumnRenamed("value", "p90"), by)


def fixed_width_histogram(frame: DataFrame, value: str, width: float) -> DataFrame:
    """bucket (the lower edge over the width) and n; empty buckets have no row."""
    return frame.groupBy(F.floor(F.col(value) / width).alias("bucket")).agg(F.count("*").alias("n"))


def duplicates(frame: DataFrame, **key: Column) -> DataFrame:
    """The keys that more than one row has, and how many have them."""
    return frame.select(*(c.alias(k) for k, c in key.items())).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def n_common(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """n_common: rows of left whose key right has too; 0 where the sets are disjoint."""
    return left.join(right.select(on), on, "left_semi").agg(F.count("*").alias("n_common"))


def checksum(frame: DataFrame) -> DataFrame:
    """One row, md5: of the number of rows and the sum of their digests, whatever their order."""
    row = F.md5(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}))
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return frame.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string"))).alias("md5"))
