"""Range and instant vectors: samples of series, evaluated at fixed steps.

Series and steps never meet in a join: every sample knows the steps that see it, which are
its look-back over the step, and steps gather what they see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between evaluations, and after which a series without samples is gone.
STEP, STALE = 15, 300


def _first_step(second, step: int):
    return F.ceil(second / step) * step


def instant(samples: DataFrame, by: list[str], step: int = STEP, stale: int = STALE, ts: str = "ts", value: str = "value") -> DataFrame:
    """by, at and value: the last sample of every series at each step that sees one.

    A step sees a sample until the next one of its series, for `stale` seconds at most.
    """
    second = F.unix_timestamp(ts)
    next_ = F.lead(second).over(Window.partitionBy(*by).orderBy(ts))
    until = F.least(F.coalesce(next_, second + stale), second + stale)
    seen = samples.select(*by, value, _first_step(second, step).alias("lo"), until.alias("until"))
    steps = seen.filter(F.col("lo") < F.col("until")).select(*by, value, F.explode(F.sequence("lo", _first_step(F.col("until"), step) - step, F.lit(step).cast("long"))).alias("at"))
    return steps.select(*by, F.timestamp_seconds("at").alias("at"), value)


def increases(samples: DataFrame, by: list[str], lookback: int, step: int = STEP, ts: str = "ts", value: str = "value") -> DataFrame:
    """by, at, increase and rate of counters over the `lookback` seconds up to each step.

    A step sees the samples after at - lookback, up to at.  What a counter grows from one to
    the next counts, after a reset the new value itself; growth into the first sample seen
    lies before the window.  Series of which a step sees fewer than two samples are absent.
    Samples that the same steps see are summed up first, so steps gather such sums, however
    many samples a step has, and both sums are kept by key without sorting.
    """
    second = F.unix_timestamp(ts)
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts))
    grown = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = samples.select(*by, F.col(ts).alias("__ts"), grown.alias("grown"), _first_step(second, step).alias("lo"), _first_step(second + lookback, step).alias("upto"))
    panes = rows.filter(F.col("lo") < F.col("upto")).groupBy(*by, "lo", "upto").agg(F.count("*").alias("n"), F.sum("grown").alias("grown"), F.min("__ts").alias("__ts"), F.min_by("grown", "__ts").alias("first"))
    seen = panes.select(*by, "n", "grown", "__ts", "first", F.explode(F.sequence("lo", F.col("upto") - step, F.lit(step).cast("long"))).alias("at"))
    first = F.coalesce(F.min_by("first", "__ts"), F.lit(0.0))
    one = seen.groupBy(*by, "at").agg(F.sum("n").alias("n"), (F.coalesce(F.sum("grown"), F.lit(0.0)) - first).alias("increase")).filter("n > 1")
    return one.select(*by, F.timestamp_seconds("at").alias("at"), "increase", (F.col("increase") / lookback).alias("rate"))


def quantiles(buckets: DataFrame, q: float, by: list[str], lookback: int, step: int = STEP) -> DataFrame:
    """by, at and value: the quantile of a histogram's growth over the look-back of each step.

    buckets: by, le (seconds or score, +Inf as infinity), ts and cumulative value.
    """
    from quern.functions.stats import bucket_quantile

    grown = increases(buckets, [*by, "le"], lookback, step).withColumnRenamed("increase", "cum_count")
    return bucket_quantile(grown, q, [*by, "at"]).filter("value IS NOT NULL")
