"""Queries that run whole flows: questions to answers, lines to articles, files, the index's life,
alerts, dashboards and reports.  Generated inputs (lines, words, files) follow from the tables
by a rule, so that SQL can say what must come out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import stats, text as T, vector as V
from quern.operators import drift, embedding, evaluation, index, metrics, ops, parsing, profile, rangevec, retrieval
from quern.plans import queries as Q
from quern.plans.config import HIGH_MEAN, settings
from quern.plans.queries import _r, t
from quern.sources import readers, reports, sinks
from quern.sources.line_log import LineLog
from quern.streaming import alerting, channel, rates
from quern.streaming.running import run_to_end

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFIGS = ["src0", "src1", "src2", "src3", "src4"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def _joined(c: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by)


# --- questions to answers ------------------------------------------------------------------


def _index(spark, d) -> DataFrame:
    """Vectors as points: two languages a chunk, every third chunk of another document."""
    chunk = F.floor(F.col("vec_id") / 2)
    lang = F.when(F.col("vec_id") % 2 == 0, "en").otherwise("ar")
    doc = F.when(chunk % 3 == 0, "other").otherwise(T.PRIMARY_DOC)
    p = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), chunk.cast("string").alias("chunk_id"), lang.alias("lang"), doc.alias("doc_id"), F.array("label").alias("article_numbers"), (chunk % 5 == 0).alias("is_repealed"))
    p = p.withColumns({"citation": F.concat(F.lit("Law, Article "), _joined(F.col("article_numbers"))), "text": F.concat(F.lit("text "), F.col("vec_id").cast("string"))})
    return p.withColumn("point_id", T.point_id(F.col("chunk_id"), F.col("lang"), F.col("doc_id"))).drop("vec_id")


def _asked(spark, d) -> DataFrame:
    """Questions that name a number in either language, hold an address, or are blank."""
    e = t(spark, d, "embeddings").filter("vec_id % 50 = 0")
    v = F.col("vec_id")
    said = F.when(v % 400 == 300, "  ").when(v % 150 == 0, F.concat(F.lit("Is Article "), F.col("label").cast("string"), F.lit(" in force?"))).when(v % 150 == 50, F.concat(F.lit("ما حكم المادة "), (v % 7).cast("string"))).otherwise("who pays? mail a@b.co")
    return e.select(v.alias("query_id"), said.alias("question"), F.reverse("embedding").alias("query_vector"))


def _told(prompts: DataFrame) -> DataFrame:
    """What the external model would say."""
    return prompts.select("query_id", F.concat(F.lit("<think>plan</think>Answer "), F.col("query_id").cast("string"), F.lit(", write to x@law.org")).alias("answer"))


@query
def retrieve_contexts(spark, d):
    """Exact lane, similarity, first-wins distinct and language twins by the library."""
    hits = retrieval.retrieve(_asked(spark, d), _index(spark, d))
    return hits.select("query_id", "place", "lane", "point_id", "lang", "doc_id", _joined(F.col("article_numbers")).alias("numbers"), _r(F.col("score")).alias("score"))


@query
def twin_lookup(spark, d):
    """twins() alone: every point asked for in the other language, one document's copies gone."""
    points = _index(spark, d)
    held = points.filter("NOT (doc_id = 'other' AND lang = 'ar')")
    hits = points.withColumns({"question_lang": F.when(F.col("lang") == "en", "ar").otherwise("en"), "score": F.lit(0.5), "was": F.col("point_id")})
    return retrieval.twins(hits, held).select("was", "point_id", "lang", "text", "score")


@query
def bucketed_twins(spark, d):
    """twin_lookup over an index in buckets, from which one document's copies were deleted and
    to which every fifth point came anew."""
    points, at = _index(spark, d), readers.scratch(spark, "buckets")
    first = index.create_bucketed(points.withColumn("text", F.lit("old")).filter("NOT is_repealed"), f"{at}/first")
    held = index.replace_bucketed(first, points, points.filter("doc_id = 'other' AND lang = 'ar'"), f"{at}/second")
    hits = points.withColumns({"question_lang": F.when(F.col("lang") == "en", "ar").otherwise("en"), "score": F.lit(0.5), "was": F.col("point_id")})
    return retrieval.twins(hits, held).select("was", "point_id", "lang", "text", "score")


@query
def ask_batch(spark, d):
    out = retrieval.ask(_asked(spark, d), _index(spark, d), _told, 0.3)
    return out.select("query_id", "status", "answer", F.array_join("sources", "|").alias("sources"), F.array_join("entities", ",").alias("entities"))


#: Pieces of a file of a micro-batch, about.
FILE_PIECES = 100_000
#: Places at which pieces of 1 to 7 characters begin within 28, by the answer's kind.
_CUTS = [[sum(1 + (3 * j + kind) % 7 for j in range(i)) for i in range(7)] for kind in range(7)]


def _spoken(spark, d) -> DataFrame:
    """Conversations as requests: query_id, question, query_vector and the answer's whole text,
    every fourth with an address and a card number."""
    talk = t(spark, d, "conversations")
    one = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"), F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("asked"))
    planted = F.when(F.col("conv_id") % 4 == 1, F.lit("Mail ann.b@law.org or pay from 4111 1111 1111 1111 now. ")).otherwise("")
    question = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Is Article "), (F.col("conv_id") % 7).cast("string"), F.lit(" in force?"))).otherwise(F.col("asked.text"))
    one = one.select(F.col("conv_id").alias("query_id"), question.alias("question"), F.concat(planted, F.array_join(F.transform("turns", lambda x: x["text"]), "\n")).alias("whole"))
    return one.join(t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("query_vector")), "query_id")


def _in_pieces(said: DataFrame) -> DataFrame:
    """The answers (query_id, status, whole, sources, asked_entities) in pieces as they arrive:
    in slices, one of eleven a slice late; some answers fail at the end, some never end.  Only
    an answer's last piece has its sources and entities."""
    cuts = F.array(*(F.array(*(F.struct(F.lit(at + 1).alias("at"), F.lit(to - at).alias("n")) for at, to in zip(row, [*row[1:], 28], strict=True))) for row in _CUTS))
    blocks = F.regexp_extract_all("whole", F.lit("(?s).{1,28}"), F.lit(0))
    kind_of = F.pmod("query_id", F.lit(7)).cast("int")
    pieces = F.filter(F.flatten(F.transform(blocks, lambda b: F.transform(F.get("cuts", kind_of), lambda c: F.substring(b, c["at"], c["n"])))), lambda x: x != "")
    cut = said.withColumn("cuts", cuts).withColumn("cut", F.when(F.col("whole") == "", F.array(F.lit(""))).otherwise(pieces)).drop("whole", "cuts")
    cut = cut.select(*(c for c in cut.columns if c != "cut"), F.size("cut").alias("pieces"), F.posexplode("cut").alias("seq", "piece"))
    last, kind, answered = F.col("seq") + 1 == F.col("pieces"), F.pmod("query_id", F.lit(10)), F.col("status") == "answered"
    slice_ = F.floor(F.col("seq") * 5 / F.col("pieces")) + F.when(F.col("seq") % 11 == 5, 1).otherwise(0)
    return cut.select(
        F.col("query_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), "piece",
        (last & ~(answered & (kind == 7))).alias("is_last"), ((F.col("status") == "invalid") | (last & answered & (kind == 3))).alias("failed"), F.when(last, F.col("sources")).alias("sources"), F.when(last, F.col("asked_entities")).alias("entities"),
        F.timestamp_seconds(F.lit(1_704_067_200) + 60 * slice_).alias("ts"), slice_.cast("int").alias("slice"),
    )


@query
def ask_stream(spark, d):
    """Conversations asked as a stream of questions in two micro-batches, answered in pieces of
    1 to 7 characters that reach the channel in six; a last row an hour later ends what is silent."""
    at, spoken = readers.scratch(spark, "asking"), _spoken(spark, d)
    spoken.write.parquet(f"{at}/spoken")
    spoken, points = spark.read.parquet(f"{at}/spoken"), _index(spark, d)
    for turn in range(2):
        spoken.filter(F.col("query_id") % 2 == turn).drop("whole").coalesce(1).write.mode("append").parquet(f"{at}/questions")
    questions = spark.readStream.schema(spark.read.parquet(f"{at}/questions").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/questions")

    def answer(batch: DataFrame, number: int) -> None:
        ready = retrieval.prepare(batch, points, 0.3).join(spoken.select("query_id", "whole"), "query_id")
        said = ready.withColumn("whole", F.when(F.col("status") == "answered", F.col("whole")).otherwise(F.coalesce("canned", F.lit(""))))
        said.select("query_id", "status", "whole", "sources", "asked_entities").write.mode("overwrite").parquet(f"{at}/said/turn={number}")

    run_to_end(questions, f"{at}/asked", answer)
    said = spark.read.parquet(f"{at}/said").drop("turn")
    _in_pieces(said).write.partitionBy("slice").parquet(f"{at}/arriving")
    arriving = spark.read.parquet(f"{at}/arriving")
    clock = spark.createDataFrame([("", None, None, False, False, None, None, 1_704_070_800)], channel.PIECE.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    files = 1 + arriving.count() // (6 * FILE_PIECES)
    for part in [*(arriving.filter(F.col("slice") == k).drop("slice").repartition(files, "request_id").sortWithinPartitions("request_id") for k in range(6)), clock.coalesce(1)]:
        part.write.mode("append").parquet(f"{at}/pieces")
    pieces = spark.readStream.schema(channel.PIECE).option("maxFilesPerTrigger", files).parquet(f"{at}/pieces")
    events = run_to_end(channel.answer_channel(pieces, 300), f"{at}/channel", schema=channel.EVENT)
    one = events.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("n", "type", "text", "event"))).alias("e"))
    ending, failed = F.element_at("e", -1)["event"], F.element_at("e", -1)["event"].contains(channel.FAILED)
    text = F.array_join(F.transform(F.filter("e", lambda x: x["type"] == "token"), lambda x: x["text"]), "")
    in_order = F.transform("e", lambda x: x["n"]) == F.sequence(F.lit(0).cast("long"), F.size("e").cast("long") - 1)
    one = one.select(F.col("request_id").cast("long").alias("query_id"), F.when(~failed, F.md5(text)).alias("text"), ending.alias("ending"), in_order.alias("in_order"))
    return one.join(said.select("query_id", "status"), "query_id")



def _alert_changes(spark, d) -> DataFrame:
    """An alert a type of event and part of the users, seen hourly: it fires while the mean is high."""
    hour = F.date_trunc("hour", "ts")
    seen = t(spark, d, "events").groupBy(F.col("event_type").alias("alertname"), (F.col("user_id") % 4).cast("string").alias("instance"), hour.alias("ts")).agg(F.avg("value").alias("mean"))
    severity = F.when(F.col("alertname") == "error", "critical").otherwise("warning")
    return seen.filter("alertname IS NOT NULL AND instance IS NOT NULL AND ts IS NOT NULL").select("alertname", severity.alias("severity"), "instance", F.when(F.col("mean") > HIGH_MEAN, "firing").otherwise("resolved").alias("status"), "ts")


@query
def alert_notifications(spark, d):
    """Alerts as a stream in six micro-batches of hours, and a last row that tells the time."""
    at = readers.scratch(spark, "alerts")
    changes = _alert_changes(spark, d)
    changes.write.parquet(f"{at}/changes")
    changes = spark.read.parquet(f"{at}/changes")
    lo, hi = changes.agg(F.min("ts"), F.max("ts")).first()
    if lo is not None:
        part = F.floor((F.unix_timestamp("ts") - int(lo.timestamp())) * 6 / (int(hi.timestamp()) - int(lo.timestamp()) + 3600))
        changes.select(*changes.columns, part.cast("int").alias("part")).write.partitionBy("part").parquet(f"{at}/arriving")
        arriving = spark.read.parquet(f"{at}/arriving")
        clock = changes.agg(F.max("ts").alias("ts")).select(F.lit("").alias("alertname"), F.lit("").alias("severity"), F.lit(None).cast("string").alias("instance"), F.lit("").alias("status"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
        for slice_ in [*(arriving.filter(F.col("part") == k).drop("part") for k in range(6)), clock]:
            slice_.coalesce(1).write.mode("append").parquet(f"{at}/in")
    else:
        changes.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    out = run_to_end(alerting.notifications(stream), f"{at}/told", schema=alerting.NOTIFICATION)
    return out.select("route", "alertname", "told_at", "status", F.array_join("firing", ",").alias("firing"), F.array_join("resolved", ",").alias("resolved"))


def _scraped(spark, path: str, counters: DataFrame) -> DataFrame:
    """Counters written as a text exposition and read from it as a scrape reads them."""
    metrics.write_exposition(counters, path)
    label = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("-"))
    one = readers.metric_samples(spark, path)
    return one.select("metric", F.concat_ws("|", *(label(k) for k in ("service", "status", "where", "entity", "stage", "le"))).alias("labels"), _r(F.col("value"), 4).alias("value")).filter("value <> 0")


@query
def request_counters(spark, d):
    """Counters of a batch of questions, observed while its answers are written."""
    at = readers.scratch(spark, "counters")
    seen = Observation("requests")
    retrieval.ask(_asked(spark, d), _index(spark, d), _told, 0.3, counts=seen).write.parquet(f"{at}/answers")
    metrics.add(spark, seen.get, f"{at}/table", "batch")
    metrics.add(spark, seen.get, f"{at}/table", "batch")  # a batch told twice counts once
    return _scraped(spark, f"{at}/metrics", metrics.totals(spark, f"{at}/table"))


@query
def stream_counters(spark, d):
    """Events as requests in five micro-batches, whose counts a listener adds up."""
    at = readers.scratch(spark, "listened")
    e = t(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "refused").otherwise("ok")
    rows = e.select(status.alias("status"), F.col("value").alias("seconds"), F.floor(F.col("event_id") % 5).alias("slice"))
    rows.write.partitionBy("slice").parquet(f"{at}/arriving")
    for k in range(5):
        spark.read.parquet(f"{at}/arriving").filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("status string, seconds double").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    listener = metrics.CounterListener(spark, "listened", f"{at}/table")
    spark.streams.addListener(listener)
    try:
        run_to_end(metrics.observed(stream, "listened", metrics.request_metrics("events", F.col("status"), seconds=F.col("seconds"))), f"{at}/run", schema="status string, seconds double")
        listener.ended.wait(120)
    finally:
        spark.streams.removeListener(listener)
    return _scraped(spark, f"{at}/metrics", metrics.totals(spark, f"{at}/table"))

@query
def ask_without_threshold(spark, d):
    """No least score: nothing is refused."""
    return retrieval.ask(_asked(spark, d), _index(spark, d), _told, None).groupBy("status").agg(F.count("*").alias("n"))


@query
def answer_events(spark, d):
    return retrieval.answer_events(retrieval.ask(_asked(spark, d), _index(spark, d), _told, 0.3))


@query
def prompt_text(spark, d):
    out = retrieval.prompts(retrieval.retrieve(_asked(spark, d), _index(spark, d)))
    return out.select("query_id", F.md5("prompt").alias("prompt"))


@query
def eval_rows(spark, d):
    asked = _asked(spark, d)
    hits = retrieval.retrieve(asked, _index(spark, d))
    questions = asked.select("query_id", F.when(F.col("query_id") % 100 == 0, evaluation.OUT_OF_CORPUS).otherwise("substantive").alias("category"), "question", F.lit("truth").alias("ground_truth"), F.when(F.col("query_id") % 100 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(3), F.lit(4))).alias("expected_articles"))
    said = retrieval.ask(asked, _index(spark, d), _told, 0.3)
    out = evaluation.eval_rows(questions, hits, said)
    return out.select("id", "category", F.array_join("retrieved_contexts", "|").alias("contexts"), "response", "reference", F.array_join("sources", "|").alias("sources"), "article_hit")


@query
def config_sweep(spark, d):
    out = evaluation.sweep(Q._eval(spark, d), CONFIGS)
    return out.select("config", "place", "chosen", _r(F.col("faithfulness")).alias("faithfulness"), _r(F.col("refusal_rate")).alias("refusal_rate"))


@query
def runs_by_faithfulness(spark, d):
    """Logged runs, best first; a column that no run logged is left out."""
    runs = evaluation.mean_scores(Q._eval(spark, d), ["config"])
    out = evaluation.ranked_runs(runs, ["config", "chunk_size", "faithfulness", "context_recall"])
    return out.withColumns({c: _r(F.col(c)) for c in ("faithfulness", "context_recall")})


@query
def index_health(spark, d):
    return index.health(_index(spark, d), "stable")


@query
def bucket_sample(spark, d):
    rows = t(spark, d, "labels").select("doc_id")
    return evaluation.bucket_sample(rows, "doc_id", 20, rows.filter("doc_id % 97 = 0"), seed=3)


@query
def embedded_index_knn(spark, d):
    """Chunks to points whose vectors a model gives, written as an index, and questions (of the
    same model) asked of it."""
    at = readers.scratch(spark, "embedded")
    embed = embedding.embedder(embedding.hash_model(16))
    points = index.create(embedding.embedded_points(Q._chunks(spark, d), F.lit(T.PRIMARY_DOC), embed), at)
    asked = t(spark, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("Is Article "), F.col("doc_id").cast("string"), F.lit(" in force?")).alias("question"))
    found = index.knn_arrow(asked.withColumn("query_vector", embed(F.col("question"))), points, 3)
    return found.join(points.select("point_id", "chunk_id", "lang"), "point_id").select("query_id", "rank", "chunk_id", "lang", _r(F.col("score")).alias("score"))


@query
def hash_embeddings(spark, d):
    """The embedder that stands in for a model: a component and the norm of each text's vector."""
    v = t(spark, d, "documents").select("doc_id", V.hash_embedding(F.coalesce("text", F.lit("")), 16).alias("v"))
    return v.select("doc_id", _r(F.get("v", F.lit(5))).alias("x5"), _r(V.norm(F.col("v"))).alias("norm"))


# --- lines and words to articles -----------------------------------------------------------


def _arabic(c: Column) -> Column:
    return F.translate(c.cast("string"), T.DIGITS, T.ARABIC_DIGITS)


def _lines(spark, d, made: Callable[[Column, Column, Column], list[Column]]) -> DataFrame:
    """One stream of lines a document; n is the number of its first article."""
    n = (F.col("doc_id") % 90 + 1).cast("int")
    docs = t(spark, d, "documents")
    parts = F.array(*made(n, F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string")))
    return docs.select(F.col("doc_id").cast("string").alias("doc"), n.alias("n"), F.posexplode(parts).alias("line_no", "text")).withColumns({"line_no": F.col("line_no").cast("long"), "page": F.floor(F.col("line_no") / 5).cast("int")})


def _first_lines(spark, d) -> DataFrame:
    head = lambda n: F.concat(F.lit("مادة "), _arabic(n))
    said = [F.lit(x) for x in ("الكتاب الأول", "الباب الثاني", "line two", "old body", "الفصل الثالث", "stray line", "tail")]
    notice = lambda n: F.concat(F.lit("المواد من "), _arabic(n + 2), F.lit(" إلى "), _arabic(n + 4), F.lit(" ملغاة"))
    return _lines(spark, d, lambda n, md5, doc: [F.lit("مادة ٩"), said[0], said[1], head(n), F.concat(F.lit("text "), md5), said[2], head(n + 1), said[3], said[4], said[5], head(n + 1), F.concat(F.lit("new body "), doc), notice(n), head(n + 6), said[6]])


def _first(spark, d) -> tuple[DataFrame, DataFrame]:
    topics = spark.range(1, 200).filter("id % 2 = 0").select(F.col("id").cast("int").alias("article_number"), F.concat(F.lit("T "), F.col("id").cast("string")).alias("topic"))
    return parsing.first_stream(_first_lines(spark, d), ["doc"], topics)


@query
def first_stream_articles(spark, d):
    """Front matter, headings, a number given twice, a closing heading and topic overrides."""
    articles, _ = _first(spark, d)
    return articles.select("doc", "article_number", "text", "page", "book", "chapter", "section", "topic", "duplicate")


@query
def varied_stream_articles(spark, d):
    """One to four articles a document as its length says, with gaps between their numbers, no
    heading in every fourth (so all is front matter) and, in every third, a repeal told over two
    lines of the second article's body."""
    n, j = (F.col("doc_id") % 90 + 1).cast("int"), lambda i: (F.col("doc_id") % 90 + 1 + 2 * i).cast("int")
    held = lambda i: F.lit(i) < F.coalesce(F.col("n_chars"), F.lit(0)) % 4 + 1
    parts = [F.when(F.col("doc_id") % 4 != 1, F.lit("الكتاب الأول"))]
    for i in range(4):
        parts += [F.when(held(i), F.concat(F.lit("مادة "), _arabic(j(i)))), F.when(held(i), F.concat(F.lit(f"body {i} "), F.md5(F.coalesce("text", F.lit("")))))]
        if i == 1:
            told = held(1) & (F.col("doc_id") % 3 == 0)
            parts += [F.when(told, F.concat(F.lit("المواد من "), _arabic(n + 20), F.lit(" إلى "), _arabic(n + 22))), F.when(told, F.lit("ملغاة"))]
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.array_compact(F.array(*parts))).alias("line_no", "text"))
    lines = docs.withColumns({"line_no": F.col("line_no").cast("long"), "page": F.floor(F.col("line_no") / 5).cast("int")})
    articles, notices = parsing.first_stream(lines, ["doc"])
    ranges_ = notices.select(F.col("doc").alias("d2"), F.col("text").alias("t2"), "lo", "hi", F.col("line_no").isNull().alias("in_body"))
    joined = articles.join(ranges_, (F.col("doc") == F.col("d2")) & (F.col("text") == F.col("t2")), "left")
    return joined.select("doc", "article_number", F.md5("text").alias("text"), "book", "page", "lo", "hi", "in_body")


@query
def repeal_notices(spark, d):
    _, notices = _first(spark, d)
    return notices.select("doc", "lo", "hi", "text", "book", "section", "line_no")


@query
def bis_headers(spark, d):
    """No header pattern admits the mark of an inserted article, so none is ever found."""
    made = _lines(spark, d, lambda n, md5, doc: [F.concat(F.lit("مادة "), _arabic(n)), F.concat(F.lit("مادة "), _arabic(n), F.lit(" مكرر")), F.lit("مكرر")])
    return parsing.bis_headers(made).select("doc", "line_no", "text")


@query
def second_stream_articles(spark, d):
    """Strict headers, a loose one on its article's page, and loose ones that are text."""
    s = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    num = lambda n, k: (n + k).cast("string")
    lines = _lines(spark, d, lambda n, md5, doc: [s("Article ", num(n, 0)), F.lit("text one"), s("rticle ", num(n, 1), " begins"), F.lit("goes on"), s("Article ", num(n, 1), " again"), s("Article ", num(n, 2), " elsewhere"), s("Article ", num(n, 6)), md5])
    known = lines.filter("line_no = 0").select("doc", F.explode(F.array(F.struct((F.col("n") + 1).alias("article_number"), F.lit(0).alias("page")), F.struct((F.col("n") + 2).alias("article_number"), F.lit(3).alias("page")))).alias("k")).select("doc", "k.*")
    return parsing.second_stream(lines, known, ["doc"]).select("doc", "article_number", "text", "duplicate")


@query
def page_lines(spark, d):
    """Words of two columns a page: the left reads on, the right from its far end with turned letters."""
    word = lambda x0, x1, top, text: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), F.lit(top).alias("top"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    words = F.array(word(50.0, 80.0, 10.5, "beta"), word(10.0, 40.0, 10.0, "alpha"), word(10.0, 60.0, 20.0, F.col("lang")), word(320.0, 350.0, 10.0, "دج"), word(360.0, 390.0, 11.0, "با"), word(330.0, 380.0, 30.0, F.col("doc_id").cast("string")))
    w = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("page"), F.posexplode(words).alias("pos", "w")).select("doc", "page", "pos", "w.*", F.lit(500.0).alias("width"), F.array().cast("array<string>").alias("glyphs"))
    return parsing.page_lines(w, by=("doc", "page")).select("doc", "lang", "line_no", "text")


@query
def ligature_check(spark, d):
    return parsing.ligature_check(t(spark, d, "documents"), "text", ["tlie"], ["the", "The"])


@query
def text_predicates(spark, d):
    """Headings, topics, Arabic letters, ranges that hold a number, joined book names, turned words."""
    k = F.col("doc_id") % 6
    line = F.element_at(F.array(*map(F.lit, ["الكتاب الأول", "القسم الثاني", "١ - تمهيد", "مادة ٥", "a line", "Article 7"])), (k + 1).cast("int"))
    notice = F.concat(F.lit("Articles 5 - 9 "), F.when(F.col("doc_id") % 2 == 0, "repealed").otherwise("stay"))
    docs = t(spark, d, "documents")
    return docs.select("doc_id", T.is_heading(line, "book").alias("book"), T.is_heading(line, "part").alias("part"), T.is_topic(line).alias("topic"), line.rlike(T.ARABIC_LETTER).alias("arabic"), T.is_repeal_notice((F.col("doc_id") % 12).cast("int"), notice).alias("repeal"), T.book_field(F.when(k == 1, "P").otherwise(""), F.when(k < 3, "B").otherwise("")).alias("field"), T.logical_word(line, F.array().cast("array<string>")).alias("turned"), T.event_json(F.lit("token"), text=F.col("lang")).alias("event"))


# --- files -----------------------------------------------------------------------------------


@query
def read_access_log(spark, d):
    """The events written as JSON lines with blank ones between, and read again."""
    path = readers.scratch(spark, "log")
    log = Q._log(spark, d).select(F.to_json(F.struct(F.col("ts").cast("string").alias("time"), F.lit("GET").alias("method"), "uri", "status", "request_time", "upstream", "release")).alias("value"), "line_no")
    log.select(F.when(F.col("line_no") % 10 == 0, F.concat("value", F.lit("\n"))).otherwise(F.col("value")).alias("value")).write.text(path)
    back = readers.access_log(spark, path)
    return back.groupBy("release", "status").agg(F.count("*").alias("n"), F.countDistinct("line_no").alias("places"), _r(F.avg("request_time"), 4).alias("mean_s"))


@query
def read_statistics(spark, d):
    path = readers.scratch(spark, "statistics")
    one = t(spark, d, "events").groupBy(F.concat(F.lit("/"), F.col("event_type")).alias("Name")).agg(F.count("*").alias("Request Count"), F.count_if(F.col("user_id") % 10 == 0).alias("Failure Count"), F.lit("N/A").alias("Requests/s"), F.max(F.floor("value")).alias("50%"), F.max(F.ceil("value")).alias("95%"), F.lit(None).cast("string").alias("99%"), F.lit(2500).alias("Max Response Time"))
    one.coalesce(1).write.option("header", True).csv(path)
    return ops.load_summary(readers.statistics_csv(spark, path), "/view").withColumn("failure_rate", _r(F.col("failure_rate")))


@query
def read_first_statistics(spark, d):
    """A statistics file a source, in which names come several times: the first row counts."""
    path = readers.scratch(spark, "statistics")
    n = F.col("n_chars")
    rows = t(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("run"), "doc_id", F.when(F.col("lang") == "en", "/ask").otherwise("/health").alias("Name"), n.alias("Request Count"), F.when(n % 3 == 0, "N/A").otherwise((n % 10).cast("string")).alias("Failure Count"), F.lit("1.5").alias("Requests/s"), *(F.lit("N/A").alias(c) for c in ("50%", "95%", "99%")), n.alias("Max Response Time"))
    rows.repartitionByRange(4, "run", "doc_id").sortWithinPartitions("run", "doc_id").drop("doc_id").withColumn("file", F.col("run")).write.partitionBy("file").option("header", True).csv(path)
    read = readers.statistics_csv(spark, path).drop("run").withColumnRenamed("file", "of")
    first = readers.first_rows(read, ["of", "Name"])
    return ops.load_summary(first, keep=["of"]).select(F.col("of").cast("string").alias("run"), "requests", "failures", _r(F.col("failure_rate")).alias("failure_rate"), "max_s")


@query
def read_first_lines(spark, d):
    """The first hundred lines of an access log, in file order."""
    path = readers.scratch(spark, "log")
    log = Q._log(spark, d).select(F.to_json(F.struct("uri", "status", "release")).alias("value"), "line_no")
    log.repartitionByRange(3, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return readers.first_lines(readers.access_log(spark, path), 100).groupBy("uri", "status").agg(F.count("*").alias("n"))


@query
def read_server_log(spark, d):
    """The last figure that a server's log tells, of one log a type of event."""
    path = readers.scratch(spark, "server")
    e = t(spark, d, "events").filter("event_type IS NOT NULL")
    line = F.concat(F.lit("INFO "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" cache holds "), (F.col("event_id") * 7).cast("string"), F.lit(" tokens"))).otherwise(" idle"))
    e.select("event_type", line.alias("value"), "event_id").repartition(1).sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]
    found = [readers.last_match(spark, f"{path}/event_type={k}", r"cache holds (\d+) tokens").select(F.lit(k).alias("server"), F.col("value").cast("long").alias("tokens")) for k in sorted(kinds)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "server string, tokens long")


@query
def calibration_rows(spark, d):
    fine = _asked(spark, d).filter(F.trim("question") != "")
    return retrieval.calibration_rows(fine, _index(spark, d))


def _exposition(spark, d) -> str:
    """Samples of two services in the text form, with comments and blank lines."""
    path = readers.scratch(spark, "metrics")
    e = t(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("service")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("s"))
    label = F.format_string('{service="s%d",stage="%s"}', "service", "event_type")
    line = lambda kind, v: F.concat(F.lit(f"rag_request_latency_seconds_{kind}"), label, F.lit(" "), F.col(v).cast("string"))
    e.select(F.explode(F.array(F.lit("# HELP rag_request_latency_seconds time"), line("sum", "s"), F.lit(""), line("count", "n"), F.lit("up 1")))).write.text(path)
    return path


@query
def read_metric_samples(spark, d):
    one = readers.metric_samples(spark, _exposition(spark, d))
    return one.select("metric", F.coalesce(F.try_element_at("labels", F.lit("service")), F.lit("-")).alias("service"), F.coalesce(F.try_element_at("labels", F.lit("stage")), F.lit("-")).alias("stage"), "value").distinct()


@query
def read_stage_samples(spark, d):
    return ops.stage_means(readers.stage_samples(spark, _exposition(spark, d))).withColumn("mean_s", _r(F.col("mean_s")))


@query
def read_documents(spark, d):
    """A folder of one JSON document a source, in order of file names, and no such folder."""
    path = readers.scratch(spark, "documents")
    article = F.struct(F.col("doc_id").cast("int").alias("article_number"), F.lit("b").alias("book"), F.lit("").alias("chapter"), F.lit("").alias("section"), F.lit("").alias("topic"), F.coalesce("text", F.lit("")).alias("text_ar"), F.col("lang").alias("text_en"), (F.col("doc_id") % 2 == 0).alias("is_repealed"), F.lit(1).alias("source_page"))
    docs = t(spark, d, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("doc_id")).agg(F.lit("t").alias("title"), F.lit("P").alias("citation_prefix"), F.lit("gazette").alias("source"), F.collect_list(article).alias("articles"))
    docs.write.option("maxRecordsPerFile", 1).json(path)
    read = readers.document_folder(spark, path).unionByName(readers.document_folder(spark, path + "-none"))
    return read.select("doc_id", F.explode("articles").alias("a")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("a.text_ar")).alias("chars"), F.count_if("a.is_repealed").alias("repealed"))


@query
def read_query_windows(spark, d):
    """Windows of queries as one JSON file, read by name and place."""
    path = readers.scratch(spark, "windows")
    w = t(spark, d, "benchmark").groupBy((F.col("item_id") % 3).cast("string").alias("w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]).alias("queries"))
    whole = w.agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct(F.lit("d").alias("description"), "queries")))).alias("m"))
    whole.select(F.to_json("m").alias("value")).write.text(path)
    return readers.query_windows(spark, path).select("window", "i", F.md5("query").alias("md5"))


@query
def read_report(spark, d):
    """An evaluation report in its full form; bookkeeping columns go."""
    path = readers.scratch(spark, "report")
    rows = t(spark, d, "labels").select(F.col("doc_id").alias("_id"), F.lit("x").alias("_category"), (F.col("quality") / 2).alias("faithfulness"), F.concat(F.lit("q "), F.col("doc_id").cast("string")).alias("user_input"))
    rows.agg(F.to_json(F.struct(F.struct(F.lit("c").alias("config")).alias("meta"), F.collect_list(F.struct("*")).alias("rows"))).alias("value")).write.text(path)
    return readers.public_columns(readers.report_rows(spark, path, "_id bigint, _category string, faithfulness double, user_input string"))


@query
def read_settings(spark, d):
    """A settings file, then what the caller gives; the lock's checksum of an output."""
    path = readers.scratch(spark, "params")
    text = "# settings\nchunking:\n  threshold: 400   # characters\n  dedupe_repealed: false\nembedding:\n  embedding_model: 'm-1'\nretrieval:\n  min_score: null\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    s = settings(readers.params(spark, path), batch_size=8)
    lock = spark.createDataFrame([({"extract": {"outs": [{"path": "data/corpus.json", "md5": "abc"}]}, "index": {"outs": [{"path": "data/corpus.json", "md5": "later"}]}},)], "stages map<string, struct<outs: array<struct<path: string, md5: string>>>>")
    one = spark.createDataFrame([(s.threshold, s.dedupe_repealed, s.embedding_model, s.batch_size, s.min_score is None, s.primary_doc)], "threshold int, dedupe boolean, model string, batch_size int, gate_off boolean, primary_doc string")
    return one.join(readers.lock_md5(lock, "data/corpus.json"), F.lit(True))


@query
def settings_of_tables(spark, d):
    """A settings file whose values are figures of the tables, and the checksum that a lock
    file, a stage a region with its nations' names as outputs, has for a path."""
    path = readers.scratch(spark, "params")
    figures = t(spark, d, "labels").agg(F.count("*").alias("n"), F.max("doc_id").alias("hi")).join(t(spark, d, "documents").agg(F.min("lang").alias("lang")), F.lit(True))
    text = F.concat(F.lit("chunking:\n  threshold: "), F.col("n").cast("string"), F.lit("  # labels\n  dedupe_repealed: "), (F.col("n") % 2 == 0).cast("string"), F.lit("\nembedding:\n  embedding_model: '"), F.col("lang"), F.lit("'\n  batch_size: 7\nretrieval:\n  min_score: "), (F.col("hi") % 10 / 10).cast("string"), F.lit("\n"))
    figures.select(text.alias("value")).coalesce(1).write.text(path)
    s = settings(readers.params(spark, path), batch_size=9)
    nations = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.substring("n_name", 1, 1).alias("path"), F.md5("n_name").alias("md5")))).alias("o"))
    stage = F.struct(F.col("n_regionkey").cast("string").alias("k"), F.struct(F.transform("o", lambda x: F.struct(x["path"].alias("path"), x["md5"].alias("md5"))).alias("outs")).alias("v"))
    lock = nations.agg(F.map_from_entries(F.collect_list(stage)).alias("stages"))
    one = spark.createDataFrame([(s.threshold, s.dedupe_repealed, s.embedding_model, s.batch_size, s.min_score)], "threshold int, dedupe boolean, model string, batch_size int, min_score double")
    return one.join(readers.lock_md5(lock, "C"), F.lit(True))


# --- the index's life, runs, registry -------------------------------------------------------


def _stored(spark, d) -> tuple[DataFrame, str]:
    path = readers.scratch(spark, "index")
    p = t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("point_id"), F.col("embedding").alias("vector"), F.concat(F.lit("law"), (F.col("label") % 3).cast("string")).alias("doc_id"), F.array("label").alias("article_numbers"))
    return index.create(p, path), path


def _copied(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """A copy elsewhere, for a frame whose own files are about to be overwritten."""
    path = readers.scratch(spark, "copy")
    frame.write.parquet(path)
    return spark.read.parquet(path)


@query
def index_of_settings(spark, d):
    """The index that a settings file names, opened by it."""
    at = readers.scratch(spark, "params")
    _, path = _stored(spark, d)
    spark.createDataFrame([(f"retrieval:\n  index_path: '{path}'\n",)], "value string").coalesce(1).write.text(at)
    found = index.open_index(spark, settings(readers.params(spark, at)).index_path)
    return found.groupBy("doc_id").agg(F.count("*").alias("points"), _r(F.sum("norm"), 3).alias("norms"))


@query
def index_created(spark, d):
    """Points and numbers covered of every document of a stored index, read back by a scan."""
    stored, _ = _stored(spark, d)
    covered = stored.groupBy("doc_id").agg(F.count("*").alias("points"), _r(F.sum("norm"), 3).alias("norms"))
    return covered.join(index.covered_numbers(stored).agg(F.count("*").alias("numbers")), F.lit(True))


@query
def index_reindexed(spark, d):
    """One document's new version written in place: points before and after, the others as they were."""
    stored, path = _stored(spark, d)
    new = stored.filter("doc_id = 'law1' AND pmod(int(point_id), 4) != 0").drop("norm")
    counted = index.reindex(spark, path, _copied(spark, new), ["law1"], "law0")
    made = spark.createDataFrame([(k, *v) for k, v in counted.items()], "doc_id string, before long, after long")
    return made.join(spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("points")), "doc_id", "right")


@query
def index_seeded(spark, d):
    """Copied, skipped as complete, and copied again on demand."""
    _, path = _stored(spark, d)
    target = readers.scratch(spark, "seeded")
    steps = [index.seed(spark, path, target), index.seed(spark, path, target), index.seed(spark, path, target, recreate=True)]
    return spark.createDataFrame([(i, s["copied"], s["points"], s["skipped"]) for i, s in enumerate(steps)], "step int, copied long, points long, skipped boolean")


@query
def corpus_checksum(spark, d):
    """Equal for the rows in any order, another for other rows."""
    docs = t(spark, d, "documents")
    one, two, other = (profile.checksum(x) for x in (docs, docs.repartition(7, "source"), docs.filter("doc_id % 2 = 0")))
    named = lambda x, n: x.withColumnRenamed("md5", n)
    return named(one, "a").join(named(two, "b"), F.lit(True)).join(named(other, "c"), F.lit(True)).select((F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("same_as_part"))


@query
def run_log(spark, d):
    """Two runs appended to the experiment log and read back, missing metrics left out."""
    path = readers.scratch(spark, "runs")
    scores = evaluation.mean_scores(Q._eval(spark, d), ["config"]).select("config", "faithfulness", "refusal_rate")
    for c in CONFIGS[:2]:
        sinks.log_run(f"run-{c}", {"config": c, "threshold": "700"}, scores.filter(F.col("config") == c).select("faithfulness", "refusal_rate", F.lit(None).cast("double").alias("absent")), path)
    back = spark.read.parquet(path).select("run", F.col("params.config").alias("config"), F.explode("metrics").alias("metric", "value"))
    return back.withColumn("value", _r(F.col("value")))


@query
def registry_promotions(spark, d):
    """Three versions of two models; the last of each carries the alias."""
    registry = spark.createDataFrame([], "model string, version int, alias string, config string, tags map<string,string>")
    n = t(spark, d, "labels").count()
    for model, config in (("qa", "700"), ("qa", "400"), ("other", "700")):
        registry = ops.promote(registry, model, config, {"faithfulness": n / 1000, "faithfulness_n_scored": 5.0, "absent": None})
    return registry.select("model", "version", "alias", "config", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tags"), F.col("tags")["faithfulness"].alias("faithfulness"))


@query
def alert_log(spark, d):
    """Notifications appended to a text log, one line an alert."""
    path = readers.scratch(spark, "alerts")
    hourly = t(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(F.avg("value").alias("x"))
    label = lambda k, v: F.map_from_arrays(F.array(F.lit(k)), F.array(v))
    one = F.struct(F.lit(None).cast("string").alias("status"), F.map_concat(label("alertname", F.col("event_type")), label("severity", F.lit("warning"))).alias("labels"), label("summary", F.date_format("ts", "yyyy-MM-dd")).alias("annotations"))
    sinks.append_text(sinks.alert_lines(hourly.select(F.when(F.col("x") > 50, "firing").otherwise("resolved").alias("status"), F.array(one).alias("alerts")), F.lit("now")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def alert_line_log(spark, d):
    """Alert lines streamed into a log in three micro-batches, and all of it run once more as
    after a crash that lost the progress: every line is there once."""
    spark.dataSource.register(LineLog)
    at = readers.scratch(spark, "line-log")
    lines = Q.alert_lines(spark, d).withColumn("slice", F.pmod("event_id", F.lit(3)))
    for k in range(3):
        lines.filter(F.col("slice") == k).select(F.col("line").alias("value")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    for run in ("first", "again"):
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        stream.writeStream.format("line_log").option("path", f"{at}/log").option("stream", "alerts").option("checkpointLocation", f"{at}/{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("line_log").load(f"{at}/log").select(F.col("value").alias("line"))


def _counters(spark, d) -> DataFrame:
    """A counter a type of event, one sample an event, that starts anew every 500 events."""
    e = t(spark, d, "events").filter("event_type IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return e.select("event_type", "ts", (n % 500).cast("double").alias("value"))


@query
def range_rates(spark, d):
    """Growth of counters at every 15 s over 5 and 15 minutes and an hour, summed up by day."""
    found = [rangevec.increases(_counters(spark, d), ["event_type"], s).withColumn("lookback", F.lit(s)) for s in (300, 900, 3600)]
    one = reduce(DataFrame.unionByName, found).groupBy("event_type", "lookback", F.date_format("at", "yyyy-MM-dd").alias("day"))
    return one.agg(F.count("*").alias("steps"), F.sum("increase").alias("increase"), _r(F.max("rate")).alias("most"))


@query
def score_median_15m(spark, d):
    """Median of the last quarter of an hour's scores at every 15 s, the mean of it by day."""
    e = t(spark, d, "events").filter("ts IS NOT NULL AND value IS NOT NULL")
    score, w = F.least(F.col("value") / 100, F.lit(1.0)), Window.partitionBy("le").orderBy("ts", "event_id")
    bounds = F.array(*(F.lit(float(b)) for b in ops.SCORE_BOUNDS), F.lit(float("inf")))
    held = e.select("event_id", "ts", score.alias("s"), F.explode(bounds).alias("le"))
    buckets = held.select("le", "ts", F.sum(F.when(F.col("s") <= F.col("le"), 1.0).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("value"))
    found = rangevec.quantiles(buckets, 0.5, [], 900)
    return found.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("steps"), _r(F.avg("value"), 5).alias("median"))


@query
def down_alert(spark, d):
    """Targets (a type of event a half of the users) that do not answer for a minute, by day."""
    up = t(spark, d, "events").select((F.col("user_id") % 2).alias("target"), "ts", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("value"))
    found = ops.down_for(up, ["target"])
    return found.groupBy("target", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("steps"), F.count_if("firing").alias("firing"))


# --- drift, alerts, dashboards, reports ------------------------------------------------------


def _drift(spark, d) -> DataFrame:
    thresholds = spark.createDataFrame([("0", 0.5), ("1", 0.9), ("2", 0.7)], "window string, threshold double")
    return drift.drift_report(Q._windows(spark, d), Q._baseline(spark, d), thresholds)


@query
def drift_report(spark, d):
    return _drift(spark, d).select("window", "n_queries", _r(F.col("drift")).alias("drift"), "threshold", "drifted")


@query
def drift_alert_shifted(spark, d):
    """The alert of windows of which one has lost half a point of every score."""
    best = Q._knn(spark, d, 1).select("query_id", "score")
    scores = best.join(Q._windows(spark, d).select(F.col("id").alias("query_id"), "window"), "query_id").withColumn("score", F.col("score") - F.when(F.col("window") == "2", 0.5).otherwise(0.0))
    n = scores.groupBy("window").agg(F.count("*").alias("n_queries"))
    report = drift.off_corpus(scores.filter("window = '0'"), scores.select("window", "score"))
    return ops.drift_alert(report.join(n, "window")).select("window", _r(F.col("off_corpus_share")).alias("off_corpus_share"))


@query
def drift_alert(spark, d):
    n = Q._windows(spark, d).groupBy("window").agg(F.count("*").alias("n_queries"))
    return ops.drift_alert(Q.off_corpus_share(spark, d).join(n, "window")).select("window", "off_corpus_share")


@query
def alert_predicates(spark, d):
    """Low faithfulness, slow 95th percentiles, and targets that are down."""
    gauge = evaluation.mean_scores(Q._eval(spark, d), ["config"], ("faithfulness",)).select(F.coalesce("config", F.lit("-")).alias("of"), F.col("faithfulness").alias("value"))
    buckets = stats.bucket_counts(Q._ms(spark, d), "v", ops.LATENCY_BOUNDS, ["event_type"])
    p95 = stats.bucket_quantile(buckets, 0.95, ["event_type"]).select(F.col("event_type").alias("of"), "value")
    up = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("of"), F.when(F.col("n_nationkey") % 5 != 1, (F.col("n_nationkey") % 3).cast("double")).alias("value"))
    found = [(ops.low_faithfulness(gauge), "faithfulness"), (ops.slow_p95(p95), "p95"), (ops.down(up), "up")]
    out = None
    for frame, name in found:
        one = frame.select(F.lit(name).alias("alert"), "of", "firing")
        out = one if out is None else out.unionByName(one)
    return out


@query
def increase_1h(spark, d):
    counter = t(spark, d, "events").groupBy("event_type", F.date_trunc("minute", "ts").alias("ts")).agg((F.sum(F.floor("value")) % 97).cast("double").alias("value"))
    return ops.windowed_rate(ops.counter_increase(counter, ["event_type"]), ["event_type"], "1 hour", None, 3600.0).select("window_start", "event_type", "increase")


@query
def median_15m(spark, d):
    """Median latency from histogram buckets of quarter hours."""
    e = t(spark, d, "events").select(F.window("ts", "15 minutes")["start"].alias("w"), F.col("value").alias("v"))
    return stats.bucket_quantile(stats.bucket_counts(e, "v", ops.LATENCY_BOUNDS, ["w"]), 0.5, ["w"]).withColumn("value", _r(F.col("value")))


@query
def score_histogram(spark, d):
    best = Q._knn(spark, d, 1).select((F.col("query_id") % 100 == 0).alias("even"), "score")
    out = stats.bucket_counts(best, "score", ops.SCORE_BOUNDS, ["even"])
    return out.select("even", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_string("%.1f", "le")).alias("le"), "cum_count")


@query
def sliding_rates(spark, d):
    out = rates.event_rates(t(spark, d, "events"), "10 minutes", "5 minutes", "1 hour", ["event_type"], 600.0)
    return out.withColumn("rate", _r(F.col("rate")))


@query
def report_drift(spark, d):
    return reports.drift(_drift(spark, d))


@query
def report_load(spark, d):
    n = F.col("n_chars").cast("string")
    rows = t(spark, d, "documents").filter("doc_id % 100 = 7").select(F.col("doc_id").cast("string").alias("run"), F.lit("/ask").alias("Name"), n.alias("Request Count"), F.lit("3").alias("Failure Count"), F.lit("").alias("Requests/s"), n.alias("50%"), F.lit("N/A").alias("95%"), n.alias("99%"), n.alias("Max Response Time"))
    place = F.row_number().over(Window.orderBy(F.col("run").cast("int"))).cast("string")
    named = rows.withColumn("run", F.lpad(place, 4, "0"))
    runs = None
    for r in ("0001", "0002"):
        one = ops.load_summary(named.filter(F.col("run") == r)).withColumn("run", F.lit(r))
        runs = one if runs is None else runs.unionByName(one)
    return reports.load(runs)


@query
def report_variants(spark, d):
    return reports.variants(evaluation.latency_summary(Q._latencies(spark, d), ["variant"]))


@query
def report_calibration(spark, d):
    return reports.calibration(Q.refusal_threshold_sweep(spark, d))
