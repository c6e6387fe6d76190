"""Line de-duplication across documents: explode, hash, count documents, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, hot_join, saved, space_trim


def line_key(line: Column) -> Column:
    """A line without surrounding white space, A-Z lower-cased."""
    return ascii_lower(space_trim(line))


def shared_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """Line hashes found in min_docs documents or more, with the smallest id holding each and
    the number of their lines.

    For two documents, least and greatest id tell: they differ exactly then.  Beyond that
    lines are first reduced to one per document, dealt by hash and id, and then counted.
    All of it is combined on the map side, so a line of every third document is one row a task.
    """
    if min_docs == 2:
        found = lines.groupBy("h1", "h2").agg(F.min("__id").alias("keeper"), F.max("__id").alias("last"), F.count("*").alias("held"))
        return found.filter("keeper < last").select("h1", "h2", "keeper", "held")
    once = lines.groupBy("h1", "h2", "__id").agg(F.count("*").alias("held"))
    found = once.groupBy("h1", "h2").agg(F.min("__id").alias("keeper"), F.count("*").alias("documents"), F.sum("held").alias("held"))
    return found.filter(F.col("documents") >= min_docs).select("h1", "h2", "keeper", "held")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Add n_lines, n_dropped and kept_text to every row of docs.

    Text is split at line feeds (null or empty text: one empty line).  Keys of at least
    min_chars code points that min_docs or more documents hold lose all their lines except in
    the smallest id that holds them.  Rows that share an id are one document when ids are
    counted, and each row is put together by itself.  Rows with a null id drop and cause
    nothing.  Lines are compared by 96 bits of hash.  Hot lines are broadcast, all others
    meet their counts by hash.  Columns of docs that clash with the added names are replaced.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    docs = docs.drop(*(c for c in added if c not in (text, doc_id)))
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    mark = F.xxhash64(F.col(text))
    lines = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), mark.alias("__mark"), F.posexplode(parts).alias("__pos", "line"))
    key = line_key(F.col("line"))
    lines = lines.withColumn("key", key).filter(F.length("key") >= min_chars).select("__id", "__mark", "__pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    shared = saved(shared_lines(lines, min_docs), "shared-lines")
    total = shared.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    gone = hot_join(lines, shared, ["h1", "h2"], "held", total, ["__id", "__mark", "__pos"]).filter("__id > keeper")
    gone = gone.groupBy("__id", "__mark").agg(F.collect_set("__pos").alias("__gone"))
    out = docs.withColumn("__m", mark).join(gone, (F.col(doc_id) == F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), parts).otherwise(F.transform(stay, lambda i: F.get(parts, i)))
    n_gone = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    return out.withColumns({"n_lines": F.size(parts).cast("long"), "n_dropped": n_gone.cast("long"), "kept_text": F.array_join(kept, "\n")}).drop("__m", "__id", "__mark", "__gone")
