"""Mixing sources to target weights by hash-threshold histograms.

Documents get a hash; tokens are summed by source and hash bucket; the running sums give
the bucket in which a source's budget ends; only that bucket is split again.  What falls
below the final threshold is taken by a filter, so nothing is sorted by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import saved, small_join, word_count

#: Hash bits used by each histogram, coarse to fine; together nine hex digits of MD5.
LEVELS = (12, 12, 12)
BITS = sum(LEVELS)


def prefixed(rows: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """Add `before` (rows that come earlier) and `before_<c>` (their sum of c) for every c of sums.

    Rows are dealt into ranges of the order; each range is summed by itself, and what all
    ranges before it hold is added to it, so no task orders more than a range.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("__range").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__s_{c}") for c in sums))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = ranges.select(F.col("__range").alias("__of"), start("__n").alias("__before"), *(start(f"__s_{c}").alias(f"__before_{c}") for c in sums))
    own = Window.partitionBy("__range").orderBy(*order)
    inside = own.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), F.col("__range") == F.col("__of"))
    out = out.withColumns({"before": F.col("__before") + F.row_number().over(own) - 1} | {f"before_{c}": F.col(f"__before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return out.select(*rows.columns, "before", *(f"before_{c}" for c in sums))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source: its size, and its share of the total by weight.

    Weights go round the sources in code point order, null last.  A source whose share
    exceeds max_repeats times its size keeps that much; the rest is shared by weight among
    the others.  Sorted by limit over weight the held sources come first, so prefix sums
    give the level at which sharing settles, without a loop.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    one = prefixed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()])
    one = one.withColumn("weight", F.element_at(w, (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))).drop("before")
    one = one.withColumn("limit", max_repeats * F.col("source_size").cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    one = saved(prefixed(one, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], "limit", "weight"), "levels")
    whole = one.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(whole["size"] or 0)) - F.col("before_limit")) / (F.lit(float(whole["weight"] or 0)) - F.col("before_weight"))
    one = one.withColumn("level", level)
    free = F.col("limit") >= F.col("level") * F.col("weight")
    settled = one.filter(free).agg(F.min(F.struct("ratio", "source", "level")).alias("s")).first()["s"]
    target = F.when(free, F.lit(float(settled["level"]) if settled else 0.0) * F.col("weight")).otherwise(F.col("limit"))
    return one.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Per source: whole repeats, and the hash key below which documents get one more.

    Every level sums one histogram and keeps the bucket where the budget ends.  The last
    level cuts at the bucket edge nearer to the budget (the lower one at a tie).
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("repeats", whole).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("low", F.lit(0).cast("long"))
    shift = BITS
    for i, bits in enumerate(LEVELS):
        inside = small_join(sizes, state.select("source", "low"), "source", rows, "inner").filter(F.shiftright("key", shift) == F.shiftright("low", shift)) if i else sizes
        shift -= bits
        bucket = F.shiftleft(F.shiftright("key", shift), shift)
        histogram = inside.groupBy("source", bucket.alias("edge")).agg(F.sum("size").alias("tokens"))
        run = Window.partitionBy("source").orderBy("edge")
        histogram = histogram.withColumn("upto", F.sum("tokens").over(run))
        joined = histogram.join(state.select("source", "left").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        end = joined.filter("upto > left").groupBy("source").agg(F.min(F.struct("edge", "tokens", "upto")).alias("end")).withColumnRenamed("source", "s")
        state = state.join(end, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        spent = F.col("end.upto") - F.col("end.tokens")
        if i < len(LEVELS) - 1:
            state = state.withColumns({"low": F.coalesce("end.edge", "low"), "left": F.coalesce(F.col("left") - spent, "left")}).drop("end")
    up = (F.col("end.upto") - F.col("left")) < (F.col("left") - spent)
    above = F.col("end.edge") + F.when(up, 1 << shift).otherwise(0)
    return state.select("source", "source_size", "target", "repeats", F.coalesce(above, F.lit(0)).cast("long").alias("cut"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Add size, source_size, target, copies and taken to every document.

    copies says how often the mix takes the document (0 to max_repeats) and taken is copies
    times size.  The hash is of id and text, so reruns agree, and rows equal in both stand or
    fall together.  Null or blank text: size 0, taken 0.  Null source: a source of its own,
    last in order.  Empty table: no rows.  Columns of docs that clash with the added names
    are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*(c for c in added if c not in (text, source, doc_id)))
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    key = F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")
    sizes = saved(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key")), "sizes")
    targets = saved(source_targets(sizes, weights, max_repeats), "targets")
    rows = targets.count()
    cuts = saved(thresholds(sizes, targets, rows).withColumnRenamed("source", "__from"), "cuts")
    keyed = docs.withColumns({"size": word_count(F.col(text)), "__key": key, "__from": F.col(source)})
    out = small_join(keyed, cuts, "__from", rows)
    copies = F.col("repeats") + (F.col("__key") < F.col("cut")).cast("long")
    out = out.withColumns({"copies": F.when(F.col("size") > 0, copies).otherwise(0)})
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("__key", "__from", "repeats", "cut")
