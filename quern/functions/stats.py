"""The percentile rules that coexist, histogram quantiles and the binomial limit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(x: str, percent: float, where: str | None = None) -> Column:
    """Value at rank max(1, ceil(percent/100 * n)); null on empty, nulls skipped."""
    return F.expr(f"percentile_disc({percent / 100!r}) WITHIN GROUP (ORDER BY {x})" + (f" FILTER (WHERE {where})" if where else ""))


def linear_percentile(x: Column, percent: float) -> Column:
    return F.percentile(x, percent / 100)


def _at_rank(rows: DataFrame, x: str, by: list[str], zero_based: Column) -> DataFrame:
    """Value at a zero-based rank of each group, the rank being a function of column n."""
    sized = rows.filter(F.col(x).isNotNull())
    ranked = sized.withColumns({"n": F.count("*").over(Window.partitionBy(*by)), "rn": F.row_number().over(Window.partitionBy(*by).orderBy(x)) - 1})
    return ranked.filter(F.col("rn") == zero_based).select(*by, F.col(x).alias("value"))


def floor_percentile(rows: DataFrame, x: str, percent: float, by: list[str]) -> DataFrame:
    """sorted[min(int(n * percent / 100), n - 1)] per group."""
    return _at_rank(rows, x, by, F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1))


def bench_percentile(rows: DataFrame, x: str, share: float, by: list[str]) -> DataFrame:
    """sorted[max(0, int(share * n) - 1)] per group."""
    return _at_rank(rows, x, by, F.greatest(F.lit(0), F.floor(F.lit(share) * F.col("n")) - 1))


def bucket_counts(values: DataFrame, x: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative counts per bound, the last being +Inf; one row per group and bound.

    Each value is counted once in its own bucket; the running sum goes over the few bounds.
    """
    index = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        index = F.when(F.col(x) <= bounds[i], i).otherwise(index)
    counted = values.filter(F.col(x).isNotNull()).groupBy(*by, index.alias("bucket")).agg(F.count("*").alias("own"))
    sums = [F.sum(F.when(F.col("bucket") <= i, F.col("own")).otherwise(0)) for i in range(len(bounds) + 1)]
    rows = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), s.alias("cum_count")) for b, s in zip([*bounds, math.inf], sums, strict=True)])
    return counted.groupBy(*by).agg(rows.alias("b")).select(*by, F.inline("b"))


def bucket_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile by linear interpolation within cumulative buckets (le, cum_count).

    The +Inf bucket gives the highest finite bound; without counts the value is null.
    """
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumns({"lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "before": F.coalesce(F.lag("cum_count").over(w), F.lit(0)), "total": F.max("cum_count").over(Window.partitionBy(*by))})
    rank = F.lit(q) * F.col("total")
    inside = F.when(F.col("le") == math.inf, F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (rank - F.col("before")) / F.nullif(F.col("cum_count") - F.col("before"), F.lit(0)))
    hit = rows.filter((F.col("cum_count") >= rank) & (F.col("before") < F.greatest(rank, F.lit(1e-300))))
    return hit.groupBy(*by).agg(F.min_by(inside, F.col("le")).alias("value"))


def binomial_limit(n: Column, p: float = 0.05, alpha: float = 0.01) -> Column:
    """Least k with P(X >= k) <= alpha for X ~ Binomial(n, p); n + 1 if there is none.

    The mass at k follows from that at k - 1; the tail is one less what lies below k.
    """
    seed = F.struct(F.lit(0).cast("long").alias("k"), F.pow(F.lit(1 - p), n).alias("mass"), F.lit(1.0).alias("tail"))

    def step(acc: Column, k: Column) -> Column:
        done = acc["tail"] <= alpha
        mass = acc["mass"] * (n - k + 1) / k * (p / (1 - p))
        return F.when(done, acc).otherwise(F.struct(k.cast("long").alias("k"), mass.alias("mass"), (acc["tail"] - acc["mass"]).alias("tail")))

    return F.aggregate(F.sequence(F.lit(1), (n + 1).cast("int")), seed, step)["k"]
