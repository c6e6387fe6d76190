"""Articles to chunks, chunks to index points, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import ranges

#: Fixed value: texts longer than this are split into paragraphs.
THRESHOLD = 700
HEADS = ("book", "chapter", "section", "topic")


def paragraphs(text: Column, marker: str) -> Column:
    """Paragraphs of a text: a line with the marker begins one unless it is the first line.

    A marker is only sought within its own line, so the text is split in one pass.
    """
    begins = marker.replace("^", "").replace("\\s", "[\\s&&[^\n]]")
    flags = begins[: begins.index(")") + 1] if begins.startswith("(?U)") else ""
    return F.transform(F.split(text, f"{flags}\n(?={begins.removeprefix(flags)})", -1), T.strip)


def repealed_runs(articles: DataFrame, by: list[str]) -> DataFrame:
    """Add run (a number) and run_length: consecutive repealed articles of one text."""
    follows = F.col("is_repealed") & F.col("before.is_repealed") & (F.col("before.text_ar") == F.col("text_ar")) & (F.col("before.article_number") + 1 == F.col("article_number"))
    numbered = ranges.runs(ranges.compared(articles, by, "article_number", follows, "is_repealed", "text_ar"), by, "article_number")
    lengths = numbered.groupBy("run").agg(F.count("*").alias("run_length"))
    return numbered.join(lengths, "run").select(*articles.columns, "run", "run_length")


def build_chunks(articles: DataFrame, by: list[str], prefix: Column, threshold: int = THRESHOLD, dedupe_repealed: bool = True) -> DataFrame:
    """Chunks of articles.

    A run of more than one repealed article is one chunk.  Else a text over the threshold
    with more than one paragraph is split: with as many paragraphs in the second language
    pair by pair, without as first-language paragraphs and one chunk of the whole second
    text.  Everything else is one chunk.
    """
    dead = F.coalesce("is_repealed", F.lit(False))
    live, rows = articles.filter(~dead), articles.filter(dead).withColumns({"run": F.lit(0), "__run": F.lit(False)})
    if dedupe_repealed:  # runs need no text of what is in force
        slim = articles.select(*(c if c in (*by, "article_number", "is_repealed") else F.when(dead, F.col(c)).alias(c) for c in articles.columns))
        rows = repealed_runs(slim, by).filter(dead).withColumn("__run", F.col("run_length") > 1)
    collapsed = rows.filter("__run").groupBy(*by, "run").agg(F.array_sort(F.collect_list("article_number")).alias("article_numbers"), *(F.min_by(c, "article_number").alias(c) for c in (*HEADS, "text_ar", "text_en", "is_repealed", "source_page"))).drop("run")
    collapsed = collapsed.withColumns({"kind": F.lit("run"), "paragraph_index": F.lit(None).cast("int"), "flags": F.array(F.lit("deduped_repealed_range"))})
    single = live.unionByName(rows.filter("NOT __run").select(articles.columns)).withColumn("article_numbers", F.array("article_number"))
    first, second = paragraphs(F.col("text_ar"), T.PARAGRAPH_AR), paragraphs(F.col("text_en"), T.PARAGRAPH_EN)
    long = F.length("text_ar") > threshold
    single = single.withColumns({"__a": F.when(long, first), "__b": F.when(long, second)})
    split, aligned = F.coalesce(F.size("__a") > 1, F.lit(False)), F.size("__a") == F.size("__b")
    none = F.array().cast("array<string>")
    part = lambda kind, index, a, b, flags: F.struct(F.lit(kind).alias("kind"), index.cast("int").alias("paragraph_index"), a.alias("text_ar"), b.alias("text_en"), flags.alias("flags"))
    null = F.lit(None)
    paired = F.transform("__a", lambda a, i: part("paragraph", i + 1, a, F.get("__b", i), none))
    alone = F.transform("__a", lambda a, i: part("paragraph", i + 1, a, F.lit(""), F.array(F.lit("ar_only_paragraph_split"))))
    rest = F.array(part("second", null, F.lit(""), F.col("text_en"), F.array(F.lit("en_whole_unaligned_source"))))
    whole = F.array(part("whole", null, F.col("text_ar"), F.col("text_en"), none))
    parts = F.when(split & aligned, paired).when(split, F.concat(alone, rest)).otherwise(whole)
    single = single.select(*by, "article_numbers", *HEADS, "is_repealed", "source_page", F.explode(parts).alias("p")).select(*by, "article_numbers", *HEADS, "is_repealed", "source_page", "p.*")
    chunks = collapsed.unionByName(single)
    return chunks.select(*by, T.chunk_id(F.col("kind"), F.col("article_numbers"), F.col("paragraph_index")).alias("chunk_id"), "article_numbers", "paragraph_index", *HEADS, "text_ar", "text_en", "is_repealed", "source_page", T.citation(F.col("article_numbers"), prefix).alias("citation"), "flags", "kind")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    one = lambda k: F.count_if(F.col("kind") == k)
    return chunks.agg(F.count("*").alias("chunks"), one("whole").alias("whole_article"), one("paragraph").alias("paragraph"), one("second").alias("second_whole"), one("run").alias("repealed_run"))


def coverage(articles: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """Numbers that chunks miss or add (problem: missing, unexpected); no rows if none."""
    want = articles.select(*by, "article_number").distinct()
    have = chunks.select(*by, F.explode("article_numbers").alias("article_number")).distinct()
    keys = [*by, "article_number"]
    missing = want.join(have, keys, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.join(want, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def points(chunks: DataFrame, doc_id: Column, primary: str = T.PRIMARY_DOC) -> DataFrame:
    """One point per chunk and language with text, the first language before the second.

    The vector is left to the caller, who joins or computes it from `text`.
    """
    jobs = chunks.withColumn("doc_id", doc_id).select("*", F.expr("stack(2, 0, 'ar', text_ar, 1, 'en', text_en) AS (job, lang, text)"))
    jobs = jobs.filter(T.strip(F.col("text")) != "")
    return jobs.select(T.point_id(F.col("chunk_id"), F.col("lang"), F.col("doc_id"), primary).alias("point_id"), "doc_id", "chunk_id", "article_numbers", "lang", *HEADS, "is_repealed", "citation", "source_page", "flags", "text")
