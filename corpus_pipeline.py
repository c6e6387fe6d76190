"""Documents to packed training sequences, in five stages.

Each stage takes all its predecessor kept and returns the columns of documents; the last
returns the packed pieces.  A stage's result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import hot_join, saved
from quern.llm.line_dedup import dedup_lines
from quern.llm.mixing import mix_sources
from quern.llm.ngram_join import near_components
from quern.llm.packing import pack_documents
from quern.llm.quality_rules import quality_rules
from quern.llm.queries import tokenizer_path

#: The columns every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs).filter("kept").select(*COLUMNS)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold stay only in the smallest id; n_chars follows the text."""
    kept = dedup_lines(docs)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents one stays: that of the smallest id, nulls last, and
    of rows that share it one text.  Rows equal in id and text are copies too, so one stays;
    documents without words stay as they are."""
    linked = near_components(docs).filter("group_key IS NOT NULL").select("doc_id", "group_key", "mark")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
    groups = saved(linked.groupBy("group_key").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select("group_key", F.col("first.mark").alias("kept"), "n"), "near-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    others = hot_join(linked.select("mark", "group_key"), groups, ["group_key"], "n", total, ["mark"]).filter("mark != kept")
    mark = F.xxhash64("doc_id", "text")
    stay = docs.join(others.select(F.col("mark").alias("gone")).distinct(), mark == F.col("gone"), "left_anti").select(*COLUMNS)
    again = saved(linked.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("mark").alias("again")), "repeats")
    if again.limit(1).count():
        repeats = stay.join(again, mark == F.col("again"), "left_semi").dropDuplicates(["doc_id", "text"])
        stay = stay.join(again, mark == F.col("again"), "left_anti").unionByName(repeats)
    return stay


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mix_sources(docs).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens; equal pieces of
    a document that comes several times are numbered by copy."""
    pieces = pack_documents(docs, tokenizer_path())
    same = Window.partitionBy("doc_id", "piece", "start", "length", "ids_crc32").orderBy("sequence_id", "offset")
    return pieces.withColumn("copy", F.row_number().over(same) - 1)


STAGES = [
    ("quality rules", rule_filter),
    ("line dedup", shared_lines),
    ("n-gram join", near_duplicates),
    ("source mix", mixture),
    ("packing", packed),
]

#: Token ids come from a vocabulary file, which SQL cannot read.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
