"""Queries over the driver tables, one per operator or small group of operators.

Searches ask with every vector whose id 50 divides; those questions also make the windows of
the drift queries, all other vectors their baseline.  Lines are documents split at line
feeds; a document's id stands for an article number; user_id % 2 stands for a release.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import pii, stats, text as T, vector as V
from quern.operators import cells, chunking, documents, drift, evaluation, index, ops, parsing, profile, retrieval
from quern.sources.readers import scratch

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Pieces of text set before the driver's texts, which have no such scripts.
MIXED_DIGITS, REFERENCE = "٠١٢ ۳۴ 7 ", "المادة ١٤٧ and Article: 54 of Articles 9-12 "


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def _points(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def _questions(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


def _knn(spark, d, k=index.TOP_K_RAW) -> DataFrame:
    return index.knn(_questions(spark, d), _points(spark, d), k, apart=True)


# --- retrieval -----------------------------------------------------------------------------


@query
def knn_top8(spark, d):
    return _knn(spark, d).withColumn("score", _r(F.col("score")))


@query
def knn_top8_arrow(spark, d):
    """The same search as matrix products; asks for one more and drops the query itself."""
    found = index.knn_arrow(_questions(spark, d), _points(spark, d), index.TOP_K_RAW + 1).filter("point_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= index.TOP_K_RAW).withColumn("score", _r(F.col("score")))


@query
def knn_bounded_top8(spark, d):
    """The same search by cells: only pairs that the triangle inequality cannot rule out."""
    found = cells.knn_bounded(_questions(spark, d), cells.build(_points(spark, d)), index.TOP_K_RAW + 1).filter("point_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.drop("scored").withColumn("rank", rank).filter(F.col("rank") <= index.TOP_K_RAW).withColumn("score", _r(F.col("score")))


@query
def knn_distinct_top3(spark, d):
    hits = _knn(spark, d).withColumn("lane", F.lit(0)).join(_points(spark, d).select("point_id", "label"), "point_id")
    return retrieval.distinct_top(hits, F.col("label")).select("query_id", "place", "point_id", "label", _r(F.col("score")).alias("score"))


def _two_lanes(spark, d) -> DataFrame:
    q, p = _questions(spark, d), _points(spark, d)
    exact = index.knn(q, p, same=("query_label", "label"), apart=True).withColumn("lane", F.lit(0))
    lanes = exact.unionByName(_knn(spark, d).withColumn("lane", F.lit(1)))
    return lanes.join(p.select("point_id", "label"), "point_id")


@query
def hybrid_two_lane_topk(spark, d):
    top = retrieval.distinct_top(_two_lanes(spark, d), F.col("label"))
    return top.select("query_id", "place", "lane", "point_id", "label", _r(F.col("score")).alias("score"))


@query
def twin_swap(spark, d):
    """Hits of the distinct top 3; point p's twin is p + 1 if it carries the same label."""
    hits = knn_distinct_top3(spark, d)
    twin = _points(spark, d).select(F.col("point_id").alias("twin_id"), F.col("label").alias("twin_label"))
    joined = hits.join(twin, (F.col("point_id") + 1 == F.col("twin_id")) & (F.col("label") == F.col("twin_label")), "left")
    return joined.select("query_id", "place", F.coalesce("twin_id", "point_id").alias("point_id"), "score", F.col("twin_id").isNotNull().alias("swapped"))


@query
def point_lookup(spark, d):
    ids = t(spark, d, "labels").select(F.col("doc_id").alias("point_id"))
    return index.lookup(_points(spark, d), ids).select("point_id", "label")


@query
def payload_filter(spark, d):
    p = _points(spark, d).withColumn("article_numbers", F.array(F.col("label"), F.col("label") + 1))
    return index.where(p, numbers=[3, 5], label=4).select("point_id", "label")


@query
def refusal_gate(spark, d):
    """Threshold 0.35; questions of even id name their own label."""
    hits = retrieval.distinct_top(_knn(spark, d).withColumn("lane", F.lit(0)).join(_points(spark, d).select("point_id", "label"), "point_id"), F.col("label"))
    q = _questions(spark, d).select("query_id", F.when(F.col("query_id") % 100 == 0, F.array("query_label")).otherwise(F.array().cast("array<int>")).alias("numbers"))
    h = hits.join(q, "query_id").withColumns({"article_numbers": F.array("label"), "doc_id": F.when(F.col("point_id") % 2 == 0, T.PRIMARY_DOC).otherwise("other")})
    return retrieval.gate(h, 0.35).withColumn("best_score", _r(F.col("best_score")))


def _gate_rows(spark, d) -> DataFrame:
    best = _knn(spark, d, 1).select("query_id", F.bround("score", 4).alias("top_score"))
    return best.select(F.col("query_id").cast("string").alias("question"), "top_score", F.when(F.col("query_id") % 100 == 0, "tune").otherwise("check").alias("set"), (F.col("query_id") % 150 != 0).alias("in_corpus"), (F.col("query_id") % 250 == 0).alias("exempt"))


@query
def refusal_threshold_sweep(spark, d):
    thresholds = spark.createDataFrame([(0.3,), (0.35,), (0.4,), (0.45,)], "threshold double")
    return drift.threshold_sweep(_gate_rows(spark, d), thresholds)


@query
def recommended_threshold(spark, d):
    return drift.recommended_threshold(_gate_rows(spark, d))


@query
def closest_calls(spark, d):
    return drift.closest_calls(_gate_rows(spark, d), 3).select("question", "in_corpus", "top_score")


@query
def prompt_assembly(spark, d):
    """Labels are numbers, every third point is repealed; the question names label 4."""
    top = retrieval.distinct_top(_knn(spark, d).withColumn("lane", F.lit(0)).join(_points(spark, d).select("point_id", "label"), "point_id"), F.col("label"))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text")
    h = top.join(docs, "point_id").withColumns({"citation": F.concat(F.lit("Doc, Article "), F.col("label").cast("string")), "is_repealed": F.col("point_id") % 3 == 0, "article_numbers": F.array("label", F.col("label") + 1), "question": F.lit("Is Article 4 in force?")})
    out = retrieval.prompts(h)
    return out.select("query_id", F.md5(F.array_join("contexts", "\n\n")).alias("contexts"), F.array_join("sources", "|").alias("sources"))


# --- drift ---------------------------------------------------------------------------------


def _windows(spark, d) -> DataFrame:
    q = _questions(spark, d)
    return q.select((F.floor(F.col("query_id") / 50) % 3).cast("string").alias("window"), F.col("query_id").alias("id"), F.col("query_vector").alias("vector"))


def _baseline(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").filter("vec_id % 50 != 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query
def centroid_drift(spark, d):
    out = drift.centroid_drift(_windows(spark, d), _baseline(spark, d))
    return out.withColumns({"centroid_cosine": _r(F.col("centroid_cosine")), "drift": _r(F.col("drift"))})


@query
def nearest_baseline(spark, d):
    near = drift.nearest_baseline(_windows(spark, d), _baseline(spark, d))
    return near.groupBy("window").agg(_r(F.avg("similarity")).alias("nearest_baseline_similarity_mean"))


@query
def off_corpus_share(spark, d):
    """Best scores of the questions among all other vectors; window 0 sets the cut-off."""
    best = _knn(spark, d, 1).select("query_id", "score")
    scores = best.join(_windows(spark, d).select(F.col("id").alias("query_id"), "window"), "query_id")
    out = drift.off_corpus(scores.filter("window = '0'"), scores.select("window", "score"))
    return out.withColumns({c: _r(F.col(c)) for c in ("corpus_score_mean", "corpus_cutoff", "off_corpus_share")})


@query
def binomial_limit(spark, d):
    return spark.range(1, 61).select(F.col("id").alias("n"), stats.binomial_limit(F.col("id")).alias("limit_k"))


@query
def drift_threshold_md5perm(spark, d):
    """The questions are the baseline here; two window sizes."""
    sizes = spark.createDataFrame([("small", 3), ("large", 10_000)], "window string, n int")
    out = drift.permuted_threshold(_windows(spark, d), sizes)
    return out.withColumn("threshold", _r(F.col("threshold")))


@query
def drift_threshold_baseline(spark, d):
    """The same calibration on the whole baseline."""
    sizes = spark.createDataFrame([("small", 3), ("large", 40)], "window string, n int")
    return drift.permuted_threshold(_baseline(spark, d), sizes).withColumn("threshold", _r(F.col("threshold")))


@query
def cosine_pairs(spark, d):
    return index.all_cosines(_questions(spark, d), _points(spark, d), 6)


# --- text functions ------------------------------------------------------------------------


@query
def digits_normalize(spark, d):
    c = t(spark, d, "conversations")
    s = F.concat(F.lit(MIXED_DIGITS), F.col("turn").cast("string"), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", T.western_digits(s).alias("digits"), T.western_digits(s, persian=True).alias("all_digits"), T.to_int(s.substr(1, 3)).alias("number"), T.reversed_int(F.col("conv_id")).alias("turned"))


@query
def article_refs(spark, d):
    c = t(spark, d, "conversations")
    q = F.concat(F.lit(REFERENCE + "article #"), F.col("turn").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", F.array_join(F.transform(T.article_references(q), lambda n: n.cast("string")), ",").alias("numbers"), T.language(F.coalesce("text", F.lit(""))).alias("lang"), T.language(q).alias("mixed_lang"))


@query
def strip_think(spark, d):
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", T.without_thinking(F.concat(F.lit(" <think>a\nb</think>  "), F.coalesce("text", F.lit("")), F.lit("<think>c</think>\n "))).alias("answer"))


@query
def point_id_uuid5(spark, d):
    docs = t(spark, d, "documents")
    return docs.select("doc_id", T.point_id(F.col("doc_id").cast("string"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, T.PRIMARY_DOC).otherwise(F.col("source"))).alias("point_id"))


@query
def citation_format(spark, d):
    docs = t(spark, d, "documents")
    n = F.when(F.col("doc_id") % 2 == 0, F.array("doc_id")).otherwise(F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") + 2))
    return docs.select("doc_id", T.citation(n, F.lit("Law")).alias("citation"), T.chunk_id(F.when(F.size(n) > 1, "run").otherwise("whole"), n, F.lit(None)).alias("chunk_id"), F.md5("text").alias("md5"))


@query
def report_cells(spark, d):
    docs = t(spark, d, "documents")
    x = F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") / 1024.0)
    return docs.select("doc_id", T.fixed(F.floor(x * 4) / 4, 2, " s").alias("fixed"), T.percent(F.floor(x * 8) / 125).alias("share"), F.md5(T.table_cell(F.col("text"))).alias("cell"))


@query
def refusal_answers(spark, d):
    c = t(spark, d, "conversations")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("The provided articles DO NOT contain it. "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.is_refusal(said).alias("refused"))


# --- lines, chunks, documents ----------------------------------------------------------------


def _lines(spark, d) -> DataFrame:
    parts = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text")
    return t(spark, d, "documents").select("doc_id", parts)


@query
def segment_lines(spark, d):
    """Lines that end in a full stop begin a segment."""
    seg = parsing.segment(_lines(spark, d), F.col("text").endswith("."), ["doc_id"])
    return seg.groupBy("doc_id", "segment").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query
def heading_carry_forward(spark, d):
    """Levels by line length: below 20 characters is a part, below 40 a book, below 60 a chapter."""
    n, line = F.length("text"), F.col("text")
    levels = {"part": F.when(n < 20, line), "book": F.when((n >= 20) & (n < 40), line), "chapter": F.when((n >= 40) & (n < 60), line)}
    return parsing.carry_levels(_lines(spark, d), levels, ["doc_id"]).select("doc_id", "line_no", "part", "book", "chapter")


@query
def paragraph_split(spark, d):
    """A line that begins with an upper-case T begins a paragraph."""
    docs = t(spark, d, "documents")
    p = docs.select("doc_id", F.posexplode(chunking.paragraphs(F.coalesce("text", F.lit("")), "^T")).alias("i", "p"))
    return p.select("doc_id", "i", F.length("p").alias("n_chars"), F.md5("p").alias("md5"))


def _articles(spark, d) -> DataFrame:
    """Articles from documents: long ones have two marked paragraphs, in the second language
    too unless 5 divides the id; ids of the upper half of each block of 8 are repealed."""
    docs = t(spark, d, "documents")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \n]+", " ")
    marked = F.concat(F.lit("(١) "), body, F.lit("\n(٢) "), body)
    second = F.when(F.col("doc_id") % 5 == 0, body).otherwise(F.concat(F.lit("(1) "), F.col("lang"), F.lit("\n(2) "), body))
    repealed = F.col("doc_id") % 8 >= 5
    return docs.select(
        F.lit("d").alias("doc"), F.col("doc_id").cast("int").alias("article_number"), F.lit("b").alias("book"), F.lit("c").alias("chapter"), F.lit("s").alias("section"), F.lit("t").alias("topic"),
        F.when(repealed, F.concat(F.lit("repealed "), F.floor(F.col("doc_id") / 8).cast("string"))).otherwise(marked).alias("text_ar"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(second).alias("text_en"), repealed.alias("is_repealed"), (F.col("doc_id") % 50).cast("int").alias("source_page"),
    )


@query
def run_collapse(spark, d):
    runs = chunking.repealed_runs(_articles(spark, d), ["doc"])
    one = runs.filter("is_repealed").groupBy("run").agg(F.min("article_number").alias("lo"), F.max("article_number").alias("hi"), F.count("*").alias("n"))
    return one.select("lo", "hi", "n")


def _chunks(spark, d) -> DataFrame:
    return chunking.build_chunks(_articles(spark, d), ["doc"], F.lit("Law"), 700)


@query
def chunk_build(spark, d):
    c = _chunks(spark, d)
    return c.select("chunk_id", F.array_join(F.transform("article_numbers", lambda n: n.cast("string")), ",").alias("numbers"), "paragraph_index", "citation", "is_repealed", F.md5("text_ar").alias("ar"), F.md5("text_en").alias("en"), F.array_join("flags", ",").alias("flags"))


@query
def chunk_coverage(spark, d):
    return chunking.coverage(_articles(spark, d), _chunks(spark, d).filter("NOT is_repealed"), ["doc"]).select("article_number", "problem")


@query
def chunk_stats(spark, d):
    return chunking.chunk_counts(_chunks(spark, d))


@query
def index_points(spark, d):
    p = chunking.points(_chunks(spark, d), F.lit(T.PRIMARY_DOC))
    return p.select("point_id", "chunk_id", "lang", F.length("text").alias("n_chars"))


@query
def numbering_gaps(spark, d):
    """Corpus checks of all documents as articles, expected from 1 to 1,200."""
    return parsing.check_corpus(_articles(spark, d), 1200, [1000, 1001]).select("severity", "check", "article_number")


def _supplements(spark, d) -> DataFrame:
    """Ten articles a document; a rule is broken where an id divides."""
    a = _articles(spark, d).withColumn("n", F.col("article_number"))
    first = F.when(F.col("n") % 11 == 0, "TODO").when(F.col("n") % 17 == 0, "short").otherwise(F.col("text_ar"))
    one = F.struct(F.when(F.col("n") % 19 == 0, -1).otherwise(F.when(F.col("n") % 10 == 7, F.col("n") - 1).otherwise(F.col("n"))).alias("article_number"), F.when(F.col("n") % 23 != 0, F.col("book")).alias("book"), "chapter", "section", "topic", first.alias("text_ar"), "text_en", "is_repealed", "source_page")
    g = a.withColumn("g", F.floor(F.col("n") / 10)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", one.alias("a")))).alias("x"))
    name = F.when(F.col("g") % 4 == 1, F.concat(F.lit("Bad "), F.col("g").cast("string"))).when(F.col("g") == 0, T.PRIMARY_DOC).otherwise(F.concat(F.lit("law_"), F.col("g").cast("string")))
    return g.select(name.alias("doc_id"), F.lit("t").alias("title"), F.when(F.col("g") % 5 == 2, " ").otherwise("P").alias("citation_prefix"), F.when(F.col("g") % 6 == 3, "<where>").otherwise("gazette").alias("source"), F.transform("x", lambda y: y["a"]).alias("articles"))


@query
def validate_documents(spark, d):
    return documents.violations(_supplements(spark, d)).select("doc_id", "article_at", "message")


@query
def first_violation(spark, d):
    return documents.first_violation(documents.violations(_supplements(spark, d)))


# --- personal data ---------------------------------------------------------------------------


def _pii_spans(spark, d, table: str, key: str, text: str) -> DataFrame:
    return t(spark, d, table).select(F.col(key).alias("key"), F.col(text).alias("text"), pii.spans(F.col(text)).alias("found"))


@query
def pii_email_card(spark, d):
    rows = _pii_spans(spark, d, "documents", "doc_id", "text")
    n = lambda e: F.size(F.filter("found", lambda s: s["entity"] == e)).cast("long")
    return rows.select(F.col("key").alias("doc_id"), n("EMAIL").alias("n_email"), n("CREDIT_CARD").alias("n_card"))


@query
def pii_pages(spark, d):
    rows = _pii_spans(spark, d, "pages", "page_id", "html")
    return rows.select(F.col("key").alias("page_id"), F.size(F.filter("found", lambda s: s["entity"] == "EMAIL")).cast("long").alias("n_email"))


@query
def pii_redact(spark, d):
    rows = _pii_spans(spark, d, "documents", "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), F.md5(pii.redact(F.col("text"), F.col("found"))).alias("md5"), F.array_join(pii.entities(F.col("found")), ",").alias("entities"))


@query
def pii_counts(spark, d):
    """Entity types per text, once each, by place."""
    docs = _pii_spans(spark, d, "documents", "doc_id", "text").withColumn("place", F.lit("documents"))
    talk = t(spark, d, "conversations").select(F.col("conv_id").alias("key"), "text", pii.spans(F.col("text")).alias("found"), F.lit("conversations").alias("place"))
    return docs.unionByName(talk).select("place", F.explode(pii.entities(F.col("found"))).alias("entity")).groupBy("place", "entity").agg(F.count("*").alias("n"))


# --- evaluation ------------------------------------------------------------------------------


def _eval(spark, d) -> DataFrame:
    l, docs = t(spark, d, "labels"), t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    x = l.join(docs, "doc_id")
    score = lambda m: F.when(F.col("doc_id") % m == 0, None).when(F.col("doc_id") % (m + 1) == 0, float("nan")).otherwise((F.col("n_chars") * m % 1000) / 1000.0)
    return x.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, evaluation.OUT_OF_CORPUS).when(F.col("doc_id") % 6 == 1, "article_lookup").otherwise("substantive").alias("category"), F.col("lang").alias("language"), F.col("source").alias("config"),
        F.when(F.col("toxic") == 1, "not covered here").otherwise("see Article 4").alias("response"), F.when(F.col("doc_id") % 4 != 0, F.col("quality") == 1).alias("article_hit"),
        *(score(m).alias(name) for m, name in zip((7, 11, 13, 17), evaluation.METRICS, strict=True)),
    )


@query
def eval_mean_scores(spark, d):
    out = evaluation.mean_scores(_eval(spark, d), ["config"])
    return out.withColumns({c: _r(F.col(c)) for c in (*evaluation.METRICS, "article_hit_rate", "refusal_rate", "false_refusal_rate")})


@query
def eval_stratum_means(spark, d):
    out = evaluation.stratum_means(_eval(spark, d), ("faithfulness",))
    return out


@query
def article_hit_rate(spark, d):
    hits = evaluation.article_hit(F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("doc_id") % 10)), F.array(F.col("n_chars") % 10, F.col("n_chars") % 7))
    return t(spark, d, "documents").groupBy("lang").agg(_r(F.avg(hits.cast("double"))).alias("hit_rate"), F.count(hits).alias("n"))


@query
def best_of_config(spark, d):
    scores = evaluation.mean_scores(_eval(spark, d), ["config"], ("faithfulness", "context_precision"))
    placed = scores.withColumn("position", F.row_number().over(Window.orderBy("config")) - 1).select("position", "config", "faithfulness", "context_precision", "article_hit_rate")
    return evaluation.best_of(placed).select("config", _r(F.col("faithfulness")).alias("faithfulness"))


@query
def ci_subset(spark, d):
    quotas = {("substantive", "en"): 4, ("substantive", "fr"): 3, ("article_lookup", "en"): 2, (evaluation.OUT_OF_CORPUS, "en"): 2, (evaluation.OUT_OF_CORPUS, "de"): 2}
    return evaluation.stratified_subset(_eval(spark, d), quotas, "id").select("id", "category", "language")


@query
def release_gate(spark, d):
    rows = _eval(spark, d)
    meta = spark.createDataFrame([("700", "m", "x")], "chunking string, embedding string, corpus_md5 string")
    now = spark.createDataFrame([("700", "n", "x")], "chunking string, embedding string, corpus_md5 string")
    out = evaluation.release_gate(rows.filter("language <> 'fr'"), rows.select("id", "category"), meta, now)
    return out.withColumns({"faithfulness": _r(F.col("faithfulness")), "failures": F.array_join("failures", "|")})


@query
def faithfulness_gauge(spark, d):
    return evaluation.faithfulness_gauge(_eval(spark, d)).select(_r(F.col("value")).alias("value"))


@query
def low_spread(spark, d):
    return evaluation.low_spread(_eval(spark, d)).withColumn("std", _r(F.col("std")))


def _latencies(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    return e.select((F.col("user_id") % 2).cast("string").alias("variant"), F.col("value").alias("latency_s"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 4).alias("ttft_s"), (F.col("event_id") % 40).cast("int").alias("output_tokens"))


@query
def latency_summary(spark, d):
    out = evaluation.latency_summary(_latencies(spark, d), ["variant"])
    return out.withColumns({c: _r(F.col(c)) for c in out.columns if c != "variant"})


@query
def quality_compare(spark, d):
    lat = evaluation.latency_summary(_latencies(spark, d), ["variant"])
    score = evaluation.mean_scores(_eval(spark, d).withColumn("variant", (F.col("id") % 2).cast("string")), ["variant"], ("faithfulness",))
    both = lat.join(score, "variant").withColumn("requests_per_s", F.when(F.col("variant") == "0", 2.0).otherwise(5.0))
    out = evaluation.compare_variants(both.filter("variant = '0'"), both.filter("variant = '1'"))
    return out.withColumns({c: _r(F.col(c)) for c in ("faithfulness_drop", "speedup_latency_p50", "speedup_concurrent_rps")})


@query
def recall_at_3(spark, d):
    q = _questions(spark, d)
    hits = _knn(spark, d).join(_points(spark, d).select("point_id", "label"), "point_id").withColumn("article_numbers", F.array("label"))
    expected = q.select("query_id", F.array("query_label").alias("expected"))
    return evaluation.recall_at(hits, expected, 3, []).select(_r(F.col("recall")).alias("recall"))


# --- operations ------------------------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    status = F.when(F.col("event_type") == "error", 502).otherwise(200)
    release = F.when(status == 502, "").when(F.col("user_id") % 2 == 0, "stable-1").otherwise("canary-2")
    return e.select(F.col("event_id").alias("line_no"), F.col("ts"), F.when(F.col("event_type") == "view", "/ask").otherwise("/health").alias("uri"), status.alias("status"), F.col("value").alias("request_time"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")).alias("upstream"), release.alias("release"))


@query
def header_attribution(spark, d):
    return ops.attribute(_log(spark, d)).groupBy("release").agg(F.count("*").alias("n"))


@query
def canary_report(spark, d):
    out = ops.release_stats(ops.attribute(_log(spark, d)))
    return out.withColumns({"share": _r(F.col("share")), "error_rate": _r(F.col("error_rate")), "ask_p95": _r(F.col("ask_p95"))})


@query
def canary_gates(spark, d):
    s = ops.release_stats(ops.attribute(_log(spark, d)))
    return ops.canary_gates(ops.pick_release(s, "stable"), ops.pick_release(s, "canary"))


def _ms(spark, d) -> DataFrame:
    return t(spark, d, "events").select("ts", "event_type", F.col("value").alias("v"))


@query
def latency_histogram(spark, d):
    out = stats.bucket_counts(_ms(spark, d), "v", ops.LATENCY_BOUNDS, ["event_type"])
    return out.select("event_type", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_string("%.1f", "le")).alias("le"), "cum_count")


@query
def histogram_quantile(spark, d):
    b = stats.bucket_counts(_ms(spark, d), "v", ops.LATENCY_BOUNDS, ["event_type"])
    return stats.bucket_quantile(b, 0.95, ["event_type"]).withColumn("value", _r(F.col("value")))


@query
def stage_means(spark, d):
    e = t(spark, d, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "sum").otherwise("count")
    samples = e.filter("NOT (event_type = 'view' AND event_id % 2 = 1)").select(F.col("event_type").alias("stage"), kind.alias("kind"), F.floor("value").cast("double").alias("value"))
    return ops.stage_means(samples).withColumn("mean_s", _r(F.col("mean_s")))


@query
def rate_5m(spark, d):
    e = t(spark, d, "events")
    counter = e.groupBy("event_type", F.date_trunc("minute", "ts").alias("ts")).agg((F.sum(F.floor("value")) % 97).cast("double").alias("value"))
    out = ops.windowed_rate(ops.counter_increase(counter, ["event_type"]), ["event_type"], "5 minutes", None, 300.0)
    return out.withColumn("rate", _r(F.col("rate")))


@query
def cost_per_hour(spark, d):
    one = t(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return one.select("event_type", F.col("w.start").alias("hour"), _r(ops.cost_per_hour(F.col("n") / 3600.0, 0.25)).alias("cost"))


@query
def error_ratio_alert(spark, d):
    e = t(spark, d, "events").select("ts", (F.col("event_type") == "error").alias("failed"))
    return ops.error_ratio(e, "1 hour").withColumn("ratio", _r(F.col("ratio")))


@query
def alert_held_for(spark, d):
    """Per event type: hours at which the mean value has been above 40 for three hours."""
    hourly = t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("x"))
    return ops.held_for(hourly, F.col("x") > 40, 10_800, ["event_type"]).select("event_type", "ts", "firing")


@query
def throughput(spark, d):
    calls = t(spark, d, "events").select("event_type", F.col("ts").alias("start"), F.col("ts").alias("end"))
    return ops.throughput(calls, ["event_type"]).select("event_type", "amount", _r(F.col("per_s"), 9).alias("per_s"))


@query
def length_stats_floor_pct(spark, d):
    out = profile.describe(t(spark, d, "documents").select("lang", "n_chars"), "n_chars", ["lang"])
    return out.withColumns({"mean": _r(F.col("mean")), "std": _r(F.col("std"))})


@query
def bench_p95(spark, d):
    return stats.bench_percentile(t(spark, d, "documents").select("lang", "n_chars"), "n_chars", 0.95, ["lang"])


@query
def fixed_width_histogram(spark, d):
    return profile.fixed_width_histogram(t(spark, d, "documents"), "n_chars", 500)


@query
def duplicate_detection(spark, d):
    return profile.duplicates(t(spark, d, "documents"), md5=F.md5("text"), x=F.bround(F.col("n_chars") / 10.0, 1))


# --- index life cycle --------------------------------------------------------------------------


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """An index of documents by source, and a new version of one source: points gone by
    their payload, the others changed, some added."""
    old = t(spark, d, "documents").select(F.col("doc_id").alias("point_id"), F.col("source").alias("doc_id"), F.col("n_chars").alias("payload"))
    new = old.filter("doc_id = 'src3' AND payload % 3 != 0").select("point_id", "doc_id", (F.col("payload") + 1).alias("payload"))
    added = old.filter("doc_id = 'src3' AND payload % 5 = 0").select((F.col("point_id") + 1_000_000_000).alias("point_id"), "doc_id", "payload")
    return old, new.unionByName(added)


@query
def index_upsert_stale_delete(spark, d):
    old, new = _versions(spark, d)
    return index.reindex_document(old, new, "src3")


@query
def index_stale_ids(spark, d):
    old, new = _versions(spark, d)
    return index.stale(old, new, "src3").select("point_id")


@query
def index_counts(spark, d):
    old, _ = _versions(spark, d)
    return profile.counts(old, ["doc_id"], "points")


@query
def disjointness(spark, d):
    """Documents whose text is also a benchmark item: 0 where the sets are disjoint."""
    return profile.n_common(t(spark, d, "documents"), t(spark, d, "benchmark"), "text")


# --- pages, merges, alerts, streams --------------------------------------------------------


def _words(spark, d) -> DataFrame:
    """Events as positioned words: a user is a page."""
    e = t(spark, d, "events")
    return e.select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), F.col("value").alias("x0"), (F.col("value") + 2).alias("x1"), F.col("value").alias("top"), F.lit(500.0).alias("width"))


@query
def split_positions(spark, d):
    return parsing.split_positions(_words(spark, d))


@query
def row_clusters(spark, d):
    pages = _words(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("top", "pos"))).alias("ws"))
    return pages.select("page", (F.array_max(parsing.cluster_rows(F.col("ws"))) + 1).alias("n_rows"), F.size("ws").alias("n_words"))


def _streams(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = t(spark, d, "documents").select(F.lit("d").alias("doc"), F.col("doc_id").cast("int").alias("article_number"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("int").alias("page"), F.col("source").alias("book"), F.lit("c").alias("chapter"), F.lit("s").alias("section"), F.lit("t").alias("topic"))
    return docs.filter("page % 3 != 0"), docs.filter("page % 5 != 0").select("doc", "article_number", "text")


@query
def merge_records(spark, d):
    records, _ = parsing.merge_languages(*_streams(spark, d), ["doc"], "Law")
    return records.select("article_number", "book", F.md5("text_ar").alias("ar"), F.md5("text_en").alias("en"), "is_repealed", "source_page", "citation")


@query
def merge_errors(spark, d):
    """One-sided articles; those that a patch supplies no longer block."""
    first, second = _streams(spark, d)
    _, errors = parsing.merge_languages(first, second, ["doc"], "Law")
    patches = t(spark, d, "labels").select(F.lit("d").alias("doc"), F.col("doc_id").cast("int").alias("article_number"))
    return parsing.open_errors(errors, patches, ["doc"]).select("article_number", "error", "blocking")


@query
def fill_repealed(spark, d):
    """Toxic documents are notices for their own number and the three after it."""
    first, _ = _streams(spark, d)
    notices = t(spark, d, "labels").filter("toxic = 1").select(F.lit("d").alias("doc"), F.col("doc_id").alias("line_no"), F.col("doc_id").cast("int").alias("lo"), (F.col("doc_id") + 3).cast("int").alias("hi"), F.concat(F.lit("notice "), F.col("doc_id").cast("string")).alias("text"))
    return parsing.fill_repealed(first, notices, ["doc"], ["text"]).select("article_number", F.md5("text").alias("md5"))


@query
def patched_articles(spark, d):
    """Labelled numbers are patched: texts where quality is 1, repeal where toxic."""
    records, _ = parsing.merge_languages(*_streams(spark, d), ["doc"], "Law")
    patches = t(spark, d, "labels").select(F.lit("d").alias("doc"), F.col("doc_id").cast("int").alias("article_number"), F.when(F.col("quality") == 1, "patched").alias("text_ar"), F.lit(None).cast("string").alias("text_en"), F.when(F.col("toxic") == 1, True).alias("is_repealed"))
    out = parsing.patch_articles(records, patches, ["doc"], "Law")
    return out.select("article_number", "book", F.md5("text_ar").alias("ar"), F.md5("text_en").alias("en"), "is_repealed", "source_page", F.array_join("flags", ",").alias("flags"))


@query
def alert_lines(spark, d):
    e = t(spark, d, "events")
    label = lambda k, v, on: F.when(on, F.map_from_arrays(F.array(F.lit(k)), F.array(v))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    labels = F.map_concat(label("alertname", F.col("event_type"), F.lit(True)), label("severity", F.lit("critical"), F.col("value") > 100), label("window", F.col("user_id").cast("string"), F.col("user_id") % 3 == 0))
    line = T.alert_line(F.when(F.col("event_type") == "error", "firing").otherwise("resolved"), labels, label("summary", F.col("props"), F.col("user_id") % 2 == 0), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", line.alias("line"))


@query
def grouped_alerts(spark, d):
    """Hourly alerts per event type, firing while the mean value is above 50."""
    hourly = t(spark, d, "events").groupBy(F.col("event_type").alias("alertname"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("x"))
    rows = hourly.withColumns({"severity": F.when(F.col("alertname") == "error", "critical").otherwise("warning"), "status": F.when(F.col("x") > 50, "firing").otherwise("resolved")})
    return ops.grouped_alerts(rows).select("alertname", "ts", "status", "notify")


@query
def load_summary(spark, d):
    """Statistics rows from documents, texts as a file would hold them."""
    n = F.col("n_chars")
    text = lambda c, na: F.when(n % na == 0, "N/A").when(n % na == 1, "").otherwise(c.cast("string"))
    rows = t(spark, d, "documents").select(F.when(F.col("lang") == "en", "/ask").otherwise("/health").alias("Name"), text(n, 11).alias("Request Count"), text(n % 10, 13).alias("Failure Count"), text(n / 4, 7).alias("Requests/s"), text(n, 3).alias("50%"), text(n * 2, 5).alias("95%"), text(n * 3, 5).alias("99%"), text(n * 4, 9).alias("Max Response Time"))
    out = ops.load_summary(rows)
    return out.withColumn("failure_rate", _r(F.col("failure_rate")))


@query
def drift_gauges(spark, d):
    n = _windows(spark, d).groupBy("window").agg(F.count("*").alias("n_queries"))
    return ops.drift_gauges(off_corpus_share(spark, d).join(n, "window")).withColumn("value", _r(F.col("value")))


@query
def stream_redact(spark, d):
    """Conversations as streams of pieces, redacted with held-back text that a conversation's
    greatest turn releases; no SQL for it."""
    from quern.streaming.redaction import redact_stream

    at = scratch(spark, "stream")
    talk = t(spark, d, "conversations")
    stream = spark.readStream.schema(talk.schema).parquet(f"{d}/conversations.parque[t]")
    ends = talk.groupBy(F.col("conv_id").alias("__id")).agg(F.max("turn").alias("__end"))
    stream = stream.join(ends, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    pieces = stream.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ")).alias("piece"), F.col("turn").eqNullSafe(F.col("__end")).alias("is_last"))
    run = redact_stream(pieces).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("request_id string, seq long, text string, entities array<string>, is_last boolean").parquet(f"{at}/out").select("request_id", "seq", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quern.plans import flows

    return REGISTRY | flows.REGISTRY
