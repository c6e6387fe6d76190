"""Readers.  Schemas are given, never inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Record layouts of the inputs.
ARTICLE = "article_number int, book string, chapter string, section string, topic string, text_ar string, text_en string, is_repealed boolean, source_page int"
CORPUS = ARTICLE + ", citation string, flags array<string>"
DOCUMENT = f"doc_id string, title string, citation_prefix string, source string, articles array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ARTICLE.split(', '))}>>"
QUESTION = "id string, category string, language string, question string, expected_articles array<int>, ground_truth string"
WORD = "page int, pos int, text string, x0 double, x1 double, top double, glyphs array<string>, width double"
ACCESS_LOG = "time string, method string, uri string, status int, request_time double, upstream string, release string"
STAGE_LINE = r'^rag_request_latency_seconds_(sum|count)\{[^}]*stage="(\w+)"[^}]*\}\s+([0-9.eE+-]+)$'
SAMPLE_LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, one machine
    by itself gets a folder of its own and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def params(spark: SparkSession, path: str) -> dict[str, dict[str, str | None]]:
    """Sections of a settings file: `section:` lines and, below them, indented `key: value`
    lines; null and empty values are None, comments and blank lines are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line")).orderBy("i")
    out: dict[str, dict[str, str | None]] = {}
    section = out.setdefault("", {})
    for r in lines.collect():
        line = r.line.split("#", 1)[0].rstrip()
        key, colon, value = line.partition(":")
        value = value.strip().strip("'\"")
        if not colon:
            continue
        if line[:1].isspace():
            section[key.strip()] = None if value in ("", "null", "~") else value
        elif value:
            out[""][key.strip()] = None if value in ("null", "~") else value
        else:
            section = out.setdefault(key.strip(), {})
    return out


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def positions(frame: DataFrame) -> DataFrame:
    """Add pos, the place in file order, for rules that read 'the first in the file'."""
    return frame.withColumn("pos", F.monotonically_increasing_id())


def document_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All *.json of a folder with their file name; a missing folder has no documents."""
    try:
        read = json_array(spark, f"{folder.rstrip('/')}/*.json", DOCUMENT)
    except AnalysisException:
        return spark.createDataFrame([], DOCUMENT + ", file string")
    return read.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are skipped, missing fields are null.  line_no follows file order,
    as pos does for first_lines()."""
    return spark.read.schema(ACCESS_LOG).json(path).select("*", F.monotonically_increasing_id().alias("line_no"), file_order().alias("pos"))


def file_order() -> Column:
    """The place of a scanned row among all files: path, part of the file, place in it."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def statistics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Load-test statistics as text columns, with the run that the file name tells
    (<run>_stats.csv) and pos, the place in file order."""
    read = spark.read.option("header", True).option("multiLine", True).csv(path)
    run = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"_stats\.csv$", "")
    return read.select("*", run.alias("run"), file_order().alias("pos"))


def first_rows(rows: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """Of the rows that are equal in `by` the first in file order."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), order).alias("__r")).select("__r.*")


def first_lines(rows: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first n rows in file order; every task sends n at most."""
    return rows.orderBy(order).limit(n)


def stage_samples(spark: SparkSession, path: str) -> DataFrame:
    """stage, kind, value of the latency histogram's sums and counts in a metrics text."""
    line = F.trim("value")
    parts = [F.regexp_extract(line, STAGE_LINE, i) for i in (1, 2, 3)]
    return spark.read.text(path).filter(line.rlike(STAGE_LINE)).select(parts[0].alias("kind"), parts[1].alias("stage"), parts[2].cast("double").alias("value"))


def metric_samples(spark: SparkSession, path: str) -> DataFrame:
    """metric, labels and value of every sample of a text exposition; comments are skipped."""
    line = F.trim("value")
    found = spark.read.text(path).filter(~line.startswith("#") & line.rlike(SAMPLE_LINE))
    body = F.regexp_extract(line, SAMPLE_LINE, 2)
    pattern = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*+)"'
    labels = F.map_from_arrays(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)))
    return found.select(F.regexp_extract(line, SAMPLE_LINE, 1).alias("metric"), labels.alias("labels"), F.regexp_extract(line, SAMPLE_LINE, 3).try_cast("double").alias("value"))


def last_match(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """value: the last match of a pattern in each whole file; null if there is none."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.try_element_at(F.regexp_extract_all("value", F.lit(pattern), F.lit(group)), F.lit(-1)).alias("value"))


def query_windows(spark: SparkSession, path: str) -> DataFrame:
    """window, i, query of a file that maps window names to their queries."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<description: string, queries: array<string>>>"
    return text.select(F.explode(F.from_json("value", kind)).alias("window", "w")).select("window", F.posexplode("w.queries").alias("i", "query"))


def lock_md5(lock: DataFrame, path: str) -> DataFrame:
    """md5 of the first output with the path; lock: stages map<string, struct<outs array<..>>>."""
    outs = lock.select(F.explode("stages").alias("stage", "s")).select("stage", F.posexplode("s.outs").alias("i", "o"))
    hit = outs.filter(F.col("o.path") == path)
    return hit.groupBy().agg(F.min_by("o.md5", F.struct("stage", "i")).alias("md5"))


def report_rows(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of an evaluation report, bare or as {meta, aggregate, rows}."""
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{row}>>")
    full = F.from_json("value", f"struct<rows: array<struct<{row}>>>")["rows"]
    return text.select(F.inline(F.when(F.ltrim(F.col("value")).startswith("["), bare).otherwise(full)))


def public_columns(frame: DataFrame) -> DataFrame:
    """Without the bookkeeping columns, whose names begin with an underscore."""
    return frame.select(*(F.col(f"`{c}`") for c in frame.columns if not c.startswith("_")))
