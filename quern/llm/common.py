"""What the operators share: the shared folder, lineage cuts and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the five controls from tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A table is broadcast only when it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where it is unset, one machine by itself gets
    a folder of its own; a cluster gets an error, since its executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: later stages never recompute it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = [path]
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by saved(), once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in getattr(df, "saved_at", None) or {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  All-ASCII values take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def space_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    """Number of runs outside the white space class; null text has none."""
    t = space_trim(text)
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(t, SPACE_RUN))).cast("long")


def least_hashed(frame: DataFrame, k: int, *cols: str) -> DataFrame:
    """At most k rows, those of least hash of cols: a sample that any run repeats.

    The rows are counted first, and a threshold on the hash lets only about 2k + 100 of them
    go on to be ordered, so tasks send next to nothing however many they are.
    """
    n = frame.count()
    h = F.shiftrightunsigned(F.xxhash64(*cols), 1)
    if n > 2 * (2 * k + 100):
        frame = frame.filter(h < int((1 << 63) * (2 * k + 100) / n))
    return frame.orderBy(h, *cols).limit(k)


def small_join(big: DataFrame, small: DataFrame, on: str, rows: int, how: str = "left") -> DataFrame:
    """Null-safe join of big with small on one column.

    small has one row per key and `rows` rows.  Up to BROADCAST_ROWS it is broadcast;
    beyond that it is dealt into 16 copies so that a hot key of `big` meets 16 tasks.
    """
    key = f"__{on}"
    small = small.withColumnRenamed(on, key)
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), big[on].eqNullSafe(F.col(key)), how).drop(key)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = big.withColumn("__deal", F.pmod(F.xxhash64(*big.columns), F.lit(16)).cast("int"))
    return dealt.join(salted, dealt[on].eqNullSafe(F.col(key)) & (F.col("__deal") == F.col("__salt")), how).drop(key, "__salt", "__deal")


#: Rows of one key from which a join treats the key as hot, at least; and rows of a whole
#: table up to which one task may have them all, whatever their keys.
HOT_ROWS, ONE_TASK_ROWS = 1000, 50_000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int, spread: list[str]) -> DataFrame:
    """Left join of big with small, whose rows are unique in `on`, by plain equality.

    `weight` is the column of small that says how many rows of big a key has at most, and
    `total` is at least their sum.  Keys above the larger of HOT_ROWS and total over
    BROADCAST_ROWS are hot: there are at most BROADCAST_ROWS of them, whatever the table, so
    they are broadcast, and their rows of big go on dealt by the columns `spread` (which
    null keys, meeting nothing, do too).  All other keys have few rows and meet by shuffle,
    as all do where total is no more than ONE_TASK_ROWS.
    """
    if total <= ONE_TASK_ROWS:
        key = {c: f"__key_{c}" for c in on}
        return big.join(small.withColumnsRenamed(key), reduce(and_, (F.col(c) == F.col(k) for c, k in key.items())), "left").drop(*key.values())
    least = max(HOT_ROWS, -(-total // BROADCAST_ROWS))
    added = [c for c in small.columns if c not in on]
    hot = small.filter(F.col(weight) >= least).select(*(F.col(c).alias(f"__hot_{c}") for c in small.columns))
    met = lambda mark: reduce(and_, (F.col(c) == F.col(f"__{mark}_{c}") for c in on))
    dealt = big.join(F.broadcast(hot), met("hot"), "left")
    apart = F.col(f"__hot_{weight}").isNotNull() | reduce(or_, (F.col(c).isNull() for c in on))
    dealt = dealt.withColumn("__salt", F.when(apart, F.xxhash64(*spread)).otherwise(F.lit(0).cast("long")))
    rest = small.filter(F.col(weight) < least).select(F.lit(0).cast("long").alias("__rest"), *(F.col(c).alias(f"__rest_{c}") for c in small.columns))
    joined = dealt.join(rest, met("rest") & (F.col("__salt") == F.col("__rest")), "left")
    return joined.select(*big.columns, *(F.coalesce(f"__hot_{c}", f"__rest_{c}").alias(c) for c in added))


#: Bits a key set has at least and at most; in runs of so many bytes they travel.
LEAST_BITS, MOST_BITS, BIT_RUN = 1 << 18, 1 << 27, 1 << 14


def _bit_of(keys: np.ndarray, n_bits: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(n_bits)


def gathered_bits(frame: DataFrame, key: str) -> np.ndarray:
    """A bit set of a long column: has_bit() is true for each key, and for few others.

    About 16 bits a key, up to MOST_BITS (16 MB): beyond that more others pass, which costs
    work but never changes results where callers join on the key afterwards.
    """
    n_bits = LEAST_BITS
    n = frame.count()
    while n_bits < min(16 * n, MOST_BITS):
        n_bits *= 2

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(n_bits // 8, dtype=np.uint8)
        for batch in batches:
            at = _bit_of(batch["key"].to_numpy(dtype=np.int64), n_bits)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)))
        runs = bits.reshape(-1, BIT_RUN)
        full = np.flatnonzero(runs.any(1))
        yield pd.DataFrame({"run": full, "bits": [runs[i].tobytes() for i in full]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in group["bits"]])
        return pd.DataFrame({"run": [int(group["run"].iloc[0])], "bits": [total.tobytes()]})

    marked = frame.select(F.col(key).cast("long").alias("key")).filter("key IS NOT NULL").mapInPandas(mark, "run long, bits binary")
    out = np.zeros((n_bits // 8 // BIT_RUN, BIT_RUN), dtype=np.uint8)
    for r in marked.groupBy("run").applyInPandas(merge, "run long, bits binary").collect():
        out[r.run] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bit_of(keys, 8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def components(links: DataFrame) -> DataFrame:
    """key and comp (least key of its component) of every end of the links (a, b).

    Large-star and small-star steps in turn: each hangs a node's neighbours on the least of
    them, until every component is one star.  Steps are written tables, so a lost executor
    costs one step; centres of large stars are joined as hot keys.  Links never reach the
    driver; only counts do.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("low")).distinct()
    edges = saved(edges, "edges")
    while True:
        n = edges.count()
        nested = edges.join(edges.select(F.col("up").alias("low")).distinct(), "low", "left_semi").limit(1).count()
        if not nested and n == edges.select("up").distinct().count():
            return edges.select(F.col("up").alias("key"), F.col("low").alias("comp")).union(edges.select("low", "low").distinct())
        both = edges.union(edges.select("low", "up"))
        least = both.groupBy("up").agg(F.least(F.min("low"), F.col("up")).alias("least"), F.count("*").alias("met"))
        large = saved(hot_join(both, least, ["up"], "met", 2 * n, ["low"]).filter("low > up").select(F.col("low").alias("up"), F.col("least").alias("low")).distinct(), "edges")
        least = large.groupBy("up").agg(F.min("low").alias("least"), F.count("*").alias("met"))
        small = hot_join(large, least, ["up"], "met", large.count(), ["low"]).filter("low != least").select(F.col("low").alias("up"), F.col("least").alias("low"))
        last, edges = edges, saved(small.union(least.select("up", F.col("least").alias("low"))).distinct(), "edges")
        dropped(last, large)
