"""Questions to contexts: two lanes, first-wins distinct, language twins, gate and prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quern.functions import pii
from quern.functions import text as T
from quern.operators.index import TOP_K_RAW, knn_arrow, near_pairs, ranked
from quern.operators.metrics import observed, request_metrics
from quern.sources.readers import scratch

#: Contexts kept; best score below which a question is refused.
TOP_K_DISTINCT, MIN_SCORE = 3, 0.47
NO_CONTEXT = "No relevant articles were found."


def exact_lane(questions: DataFrame, points: DataFrame, primary: str = T.PRIMARY_DOC, k: int = TOP_K_RAW) -> DataFrame:
    """knn() among the primary document's points that hold a number the question names.

    Only pairs that share a number are scored; those that share several count once.
    """
    named = questions.select("query_id", "query_vector", F.explode(F.array_distinct("numbers")).alias("asked"))
    payload = [c for c in ("norm",) if c in points.columns]
    held = points.filter(F.col("doc_id") == primary).select("point_id", "vector", *payload, F.explode(F.array_distinct("article_numbers")).alias("held"))
    return ranked(near_pairs(named, held, k, ("asked", "held")).dropDuplicates(["query_id", "point_id"]), k)


def distinct_top(hits: DataFrame, group: Column, k: int = TOP_K_DISTINCT) -> DataFrame:
    """First hit per group in (lane, rank) order, then the first k: place counts from 1."""
    order = ("lane", "rank")
    one = hits.withColumn("__g", group).withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "__g").orderBy(*order))).filter("__rn = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return one.withColumn("place", place).filter(F.col("place") <= k).drop("__g", "__rn")


def twins(hits: DataFrame, points: DataFrame, primary: str = T.PRIMARY_DOC) -> DataFrame:
    """Swap a hit's payload for its copy in the question's language, if the index has it.

    The copy's id follows from chunk, language and document; score and place stay the hit's.
    """
    payload = [c for c in points.columns if c not in ("vector", "norm")]
    other = points.select(*(F.col(c).alias(f"__{c}") for c in payload))
    want = F.when(F.col("lang") != F.col("question_lang"), T.point_id(F.col("chunk_id"), F.col("question_lang"), F.col("doc_id"), primary))
    same = (F.col("__lang") == F.col("question_lang")) & (F.col("__chunk_id") == F.col("chunk_id")) & (F.col("__doc_id") == F.col("doc_id"))
    joined = hits.withColumn("__want", want).join(other, (F.col("__want") == F.col("__point_id")) & same, "left")
    swapped = {c: F.when(F.col("__point_id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in payload}
    return joined.withColumns(swapped).select(hits.columns)


def retrieve(questions: DataFrame, points: DataFrame, primary: str = T.PRIMARY_DOC) -> DataFrame:
    """query_id, place, score and payload of the contexts of each question.

    questions: query_id, question, query_vector.  Numbers named in a question are looked up
    first; the rest comes by similarity; equal article_numbers count once.
    """
    q = questions.withColumns({"numbers": T.article_references(F.col("question")), "question_lang": T.language(F.col("question"))})
    lanes = exact_lane(q, points, primary).withColumn("lane", F.lit(0)).unionByName(knn_arrow(q, points).withColumn("lane", F.lit(1)))
    payload = [c for c in points.columns if c not in ("vector", "norm")]
    hits = lanes.join(points.select(payload), "point_id")
    top = distinct_top(hits, F.col("article_numbers")).join(q.select("query_id", "question", "numbers", "question_lang"), "query_id")
    return twins(top, points, primary)


def gate(hits: DataFrame, min_score: float | None = MIN_SCORE, primary: str = T.PRIMARY_DOC) -> DataFrame:
    """query_id, best_score, exempt, refused.

    Refused: the best score is below min_score (strictly) and no hit of the primary document
    (or of none named) holds a number the question names.  No hits or no min_score: never.
    """
    own = F.coalesce(F.col("doc_id"), F.lit(primary)) == primary
    exempt = F.coalesce(F.bool_or(own & F.arrays_overlap("article_numbers", "numbers")), F.lit(False))
    out = hits.groupBy("query_id").agg(F.max("score").alias("best_score"), exempt.alias("exempt"))
    low = F.lit(False) if min_score is None else F.coalesce(F.col("best_score") < F.lit(float(min_score)), F.lit(False))
    return out.withColumn("refused", ~F.col("exempt") & low)


def calibration_rows(questions: DataFrame, points: DataFrame, primary: str = T.PRIMARY_DOC) -> DataFrame:
    """query_id, top_score (four places) and exempt: what threshold_sweep() reads of a question.

    The gate is asked with a threshold that nothing reaches, so whoever it lets pass is exempt.
    """
    judged = gate(retrieve(questions, points, primary), float("inf"), primary)
    return judged.select("query_id", F.bround("best_score", 4).alias("top_score"), (~F.col("refused")).alias("exempt"))


def prompts(hits: DataFrame, question: str = "question") -> DataFrame:
    """query_id, contexts in order, sources in order (repeats kept) and the prompt."""
    shown = T.context(F.col("citation"), F.col("text"), F.col("is_repealed"), F.col("article_numbers"), F.col(question))
    rows = hits.select("query_id", F.col(question).alias("q"), F.struct("place", shown.alias("context"), "citation").alias("s"))
    one = rows.groupBy("query_id").agg(F.first("q").alias("q"), F.array_sort(F.collect_list("s")).alias("s"))
    contexts = F.transform("s", lambda x: x["context"])
    asked = F.concat(F.lit("Answer the question from these articles only.\n\n"), F.array_join(contexts, "\n\n"), F.lit("\n\nQuestion: "), F.col("q"))
    return one.select("query_id", contexts.alias("contexts"), F.transform("s", lambda x: x["citation"]).alias("sources"), asked.alias("prompt"))


def answers(questions: DataFrame, hits: DataFrame, generated: DataFrame, min_score: float | None = MIN_SCORE, primary: str = T.PRIMARY_DOC) -> DataFrame:
    """query_id, status (no_context, refused, answered), answer, sources.

    generated: query_id, answer of the external model.  Refused and contextless questions
    never show it, nor any source.
    """
    verdict = gate(hits, min_score, primary).join(prompts(hits), "query_id")
    q = questions.select("query_id", T.language(F.col("question")).alias("lang"))
    row = q.join(verdict, "query_id", "left").join(generated.select("query_id", F.col("answer").alias("__a")), "query_id", "left")
    status = F.when(F.col("best_score").isNull(), "no_context").when(F.col("refused"), "refused").otherwise("answered")
    row = row.withColumn("status", status)
    said = F.when(F.col("status") == "no_context", F.lit(NO_CONTEXT)).when(F.col("status") == "refused", T.refusal_text(F.col("lang"))).otherwise(T.without_thinking(F.col("__a")))
    return row.select("query_id", "status", said.alias("answer"), F.when(F.col("status") == "answered", F.col("sources")).otherwise(F.array().cast("array<string>")).alias("sources"))


def prepare(questions: DataFrame, points: DataFrame, min_score: float | None = MIN_SCORE, primary: str = T.PRIMARY_DOC) -> DataFrame:
    """query_id, status, prompt, sources, canned, asked_entities and best_score: all that stands before an answer is generated.

    questions: query_id, question, query_vector.  Blank questions are invalid.  Personal data
    is taken out of questions before anything reads them.  Questions without a context and
    refused ones have their answer (canned) and neither prompt nor sources.  Hits are written
    once, since gate, prompts and sources all read them.
    """
    blank = T.strip(F.coalesce("question", F.lit(""))) == ""
    spans = pii.spans(F.col("question"))
    fine = questions.filter(~blank).select("query_id", pii.redact(F.col("question"), spans).alias("question"), "query_vector", pii.entities(spans).alias("asked_entities"), T.language(F.col("question")).alias("lang"))
    spark = questions.sparkSession
    at = scratch(spark, "hits")
    retrieve(fine.select("query_id", "question", "query_vector"), points, primary).write.parquet(at)
    hits = spark.read.parquet(at)
    row = fine.select("query_id", "lang", "asked_entities").join(gate(hits, min_score, primary), "query_id", "left").join(prompts(hits), "query_id", "left")
    status = F.when(F.col("best_score").isNull(), "no_context").when(F.col("refused"), "refused").otherwise("answered")
    none, told = F.array().cast("array<string>"), F.col("status") == "answered"
    canned = F.when(F.col("status") == "no_context", F.lit(NO_CONTEXT)).when(F.col("status") == "refused", T.refusal_text(F.col("lang")))
    row = row.withColumn("status", status).select("query_id", "status", F.when(told, F.col("prompt")).alias("prompt"), F.when(told, F.col("sources")).otherwise(none).alias("sources"), canned.alias("canned"), "asked_entities", "best_score")
    text = lambda: F.lit(None).cast("string")
    return row.unionByName(questions.filter(blank).select("query_id", F.lit("invalid").alias("status"), text().alias("prompt"), none.alias("sources"), text().alias("canned"), none.alias("asked_entities"), F.lit(None).cast("double").alias("best_score")))


def ask(questions: DataFrame, points: DataFrame, generate: Callable[[DataFrame], DataFrame], min_score: float | None = MIN_SCORE, primary: str = T.PRIMARY_DOC, counts: Observation | str | None = None, service: str = "batch") -> DataFrame:
    """query_id, status, answer, sources, entities of a batch of questions.

    questions: query_id, question, query_vector; see prepare().  Personal data is taken out of
    answers before anyone reads them; entities are those of the answer.  generate() turns
    query_id, prompt and sources of the answered questions into (query_id, answer).  With
    `counts`, request_metrics() of the service are observed under it as the answers are read.
    """
    ready = prepare(questions, points, min_score, primary)
    generated = generate(ready.filter("status = 'answered'").select("query_id", "prompt", "sources")).select("query_id", F.col("answer").alias("__a"))
    said = ready.join(generated, "query_id", "left").withColumn("__a", F.when(F.col("status") == "answered", T.without_thinking(F.col("__a"))).otherwise(F.col("canned")))
    said = said.withColumn("__f", pii.spans(F.col("__a")))
    entities = F.when(F.col("status") == "invalid", F.array().cast("array<string>")).otherwise(pii.entities(F.col("__f")))
    said = said.withColumn("entities", entities)
    if counts is not None:
        said = observed(said, counts, request_metrics(service, F.col("status"), F.col("asked_entities"), F.col("entities"), F.col("best_score")))
    return said.select("query_id", "status", pii.redact(F.col("__a"), F.col("__f")).alias("answer"), "sources", "entities")


def answer_events(said: DataFrame) -> DataFrame:
    """query_id, seq and event (JSON) of answers told as a stream: the text and then its end with
    the sources, or one error where there is no answer."""
    token = F.to_json(F.struct(F.lit("token").alias("type"), F.col("answer").alias("text")))
    done = F.to_json(F.struct(F.lit("done").alias("type"), F.col("status"), F.col("sources")))
    error = F.to_json(F.struct(F.lit("error").alias("type"), F.col("status").alias("message")))
    told = F.when(F.col("answer").isNull(), F.array(error)).otherwise(F.array(token, done))
    return said.select("query_id", F.posexplode(told).alias("seq", "event"))
