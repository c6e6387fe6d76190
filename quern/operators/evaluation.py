"""Scores of evaluation runs, the choice of a configuration, release and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranges import ranked

from quern.functions.stats import nearest_rank
from quern.functions.text import is_refusal

#: The category outside the corpus, metrics, and the limits of the gates.
OUT_OF_CORPUS = "out_of_corpus"
METRICS = ("faithfulness", "context_precision", "context_recall", "answer_relevancy")
MIN_FAITHFULNESS, MIN_REFUSAL, MIN_SCORED = 0.75, 0.75, 0.8
MIN_GAIN, MAX_DROP = 0.05, 0.03


def in_corpus(category: Column) -> Column:
    return ~category.eqNullSafe(F.lit(OUT_OF_CORPUS))


def scored(x: Column) -> Column:
    """The value, null where it is null or NaN."""
    return F.when(~F.isnan(x), x)


def article_hit(expected: Column, cited: Column) -> Column:
    """Whether any expected number is cited; null where none is expected."""
    return F.when(F.size(expected) > 0, F.arrays_overlap(expected, cited))


def mean_scores(rows: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per group: means of in-corpus scores and how many there are, hit rate, refusal rates.

    rows: category, response, article_hit (nullable) and the metrics.  Nothing to average
    gives null, never 0.
    """
    inside = in_corpus(F.col("category"))
    declined = is_refusal(F.col("response")).cast("double")
    out = []
    for m in metrics:
        x = F.when(inside, scored(F.col(m)))
        out += [F.avg(x).alias(m), F.count(x).alias(f"{m}_n_scored")]
    out += [F.avg(F.col("article_hit").cast("double")).alias("article_hit_rate"), F.avg(F.when(~inside, declined)).alias("refusal_rate"), F.avg(F.when(inside, declined)).alias("false_refusal_rate")]
    return rows.groupBy(*by).agg(*out)


def stratum_means(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means by category and language over all rows, to three places."""
    return rows.groupBy("category", "language").agg(*(F.round(F.avg(scored(F.col(m))), 3).alias(m) for m in metrics))


def low_spread(rows: DataFrame, metrics: tuple[str, ...] = METRICS, least: float = 0.02) -> DataFrame:
    """metric, std and suspicious (std below least) of each metric."""
    stats = rows.agg(*(F.stddev_samp(scored(F.col(m))).alias(m) for m in metrics))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("std")) for m in metrics))
    return stats.select(F.inline(pairs)).withColumn("suspicious", F.coalesce(F.col("std") < least, F.lit(False)))


def best_of(results: DataFrame, min_gain: float = MIN_GAIN) -> DataFrame:
    """The winning row of results (position, faithfulness, context_precision, article_hit_rate).

    Order: faithfulness, precision, hit rate (null: -1), earliest first among equals.
    Position 0 is the incumbent; it stays unless the winner's faithfulness gains min_gain;
    without either faithfulness the winner stands.
    """
    key = F.struct(*(F.coalesce(c, F.lit(-1.0)) for c in ("faithfulness", "context_precision", "article_hit_rate")), (-F.col("position")).alias("p"))
    row = F.struct(*results.columns)
    one = results.agg(F.max_by(row, key).alias("w"), F.min_by(row, F.col("position")).alias("i"))
    kept = F.coalesce(F.col("w.faithfulness") - F.col("i.faithfulness") < min_gain, F.lit(False))
    return one.select(F.when(kept, F.col("i")).otherwise(F.col("w")).alias("r")).select("r.*")


def ranked_runs(runs: DataFrame, columns: list[str], by: str = "faithfulness") -> DataFrame:
    """Those of `columns` that the logged runs have, and a run's place by score, best first.

    Runs of equal score share a place; without a score they come last.
    """
    held = [c for c in columns if c in runs.columns]
    return runs.select(F.rank().over(Window.orderBy(F.col(by).desc_nulls_last())).alias("place"), *held)


def stratified_subset(questions: DataFrame, quotas: dict[tuple[str, str], int], position: str = "pos") -> DataFrame:
    """The first questions in order of each (category, language), up to its quota."""
    quota = F.lit(0)
    for (category, lang), n in quotas.items():
        quota = F.when((F.col("category") == category) & (F.col("language") == lang), n).otherwise(quota)
    rn = F.row_number().over(Window.partitionBy("category", "language").orderBy(position))
    return questions.withColumn("__rn", rn).filter(F.col("__rn") <= quota).drop("__rn")


def bucket_sample(rows: DataFrame, order: str, n: int, forced: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Forced rows and one of each of n contiguous buckets, that of the least seeded hash."""
    total = rows.count()
    less, more = total // n, total % n  # the first `more` buckets have one row more
    long = more * (less + 1)
    bucket = F.when(F.col("rank") < long, F.floor(F.col("rank") / (less + 1))).otherwise(more + F.floor((F.col("rank") - long) / max(less, 1)))
    drawn = F.struct(F.md5(F.concat_ws("|", F.lit(seed), order)), order)
    dealt = ranked(rows, order).withColumn("__b", bucket)
    picked = dealt.groupBy("__b").agg(F.min_by(F.struct(*rows.columns), drawn).alias("r")).select("r.*")
    return picked if forced is None else picked.unionByName(rows.join(forced.select(order).distinct(), order, "left_semi")).distinct()


def release_gate(rows: DataFrame, subset: DataFrame, meta: DataFrame, current: DataFrame, threshold: float = MIN_FAITHFULNESS, min_refusal: float = MIN_REFUSAL) -> DataFrame:
    """One row: declined, expected_declines, scored, expected_scored, faithfulness, failures, passed.

    rows: id, response, faithfulness; subset: id, category; meta and current (one row each):
    chunking, embedding, corpus_md5.  Questions without a row count as not declined and not
    scored; NaN scores count as missing.
    """
    wanted = subset.select(F.col("id").alias("__id"), in_corpus(F.col("category")).alias("inside"))
    joined = wanted.join(rows, F.col("__id") == F.col("id"), "left")
    x = F.when(F.col("inside"), scored(F.col("faithfulness")))
    sums = joined.agg(
        F.count_if(~F.col("inside") & is_refusal(F.col("response"))).alias("declined"), F.count_if(~F.col("inside")).alias("expected_declines"), F.count(x).alias("scored"), F.count_if("inside").alias("expected_scored"), F.avg(x).alias("faithfulness")
    )
    sides = meta.select(*(F.col(c).alias(f"m_{c}") for c in ("chunking", "embedding", "corpus_md5"))).join(current.select("chunking", "embedding", "corpus_md5"), F.lit(True))
    all_of = sums.join(sides, F.lit(True), "left")
    failures = F.array_compact(F.array(
        F.when((F.col("expected_declines") > 0) & (F.col("declined") < min_refusal * F.col("expected_declines")), "too few declined"),
        F.when(F.col("scored") < MIN_SCORED * F.col("expected_scored"), "too few scored"),
        F.when(F.col("faithfulness") < threshold, "faithfulness below the threshold"),
        F.when(~F.col("m_chunking").eqNullSafe(F.col("chunking")), "stale chunking"),
        F.when(~F.col("m_embedding").eqNullSafe(F.col("embedding")), "stale embedding"),
        F.when(F.col("corpus_md5").isNotNull() & ~F.col("m_corpus_md5").eqNullSafe(F.col("corpus_md5")), "stale corpus"),
    ))
    return all_of.select("declined", "expected_declines", "scored", "expected_scored", "faithfulness", failures.alias("failures"), (F.size(failures) == 0).alias("passed"))


def latency_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Nearest-rank percentiles of latency_s, ttft_s and tokens per second (zeros skipped)."""
    rate = F.when((F.col("output_tokens") != 0) & (F.col("latency_s") != 0), F.col("output_tokens") / F.col("latency_s"))
    made = rows.withColumn("__rate", rate)
    return made.groupBy(*by).agg(nearest_rank("latency_s", 50).alias("latency_p50_s"), nearest_rank("latency_s", 95).alias("latency_p95_s"), nearest_rank("ttft_s", 50).alias("ttft_p50_s"), nearest_rank("ttft_s", 95).alias("ttft_p95_s"), nearest_rank("__rate", 50).alias("tokens_per_s_p50"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is null or 0."""
    return F.when((a != 0) & (b != 0), a / b)


def compare_variants(base: DataFrame, other: DataFrame, max_drop: float = MAX_DROP) -> DataFrame:
    """One row from two one-row summaries (faithfulness, latency_p50_s, requests_per_s)."""
    b, o = base.select(*(F.col(c).alias(f"b_{c}") for c in ("faithfulness", "latency_p50_s", "requests_per_s"))), other.select(*(F.col(c).alias(f"o_{c}") for c in ("faithfulness", "latency_p50_s", "requests_per_s")))
    drop = F.col("b_faithfulness") - F.col("o_faithfulness")
    return b.join(o, F.lit(True)).select(drop.alias("faithfulness_drop"), F.coalesce(drop < max_drop, F.lit(False)).alias("passed"), ratio(F.col("b_latency_p50_s"), F.col("o_latency_p50_s")).alias("speedup_latency_p50"), ratio(F.col("o_requests_per_s"), F.col("b_requests_per_s")).alias("speedup_concurrent_rps"))


def faithfulness_gauge(rows: DataFrame) -> DataFrame:
    """The mean over in-corpus scores; no row when there is none."""
    x = F.when(in_corpus(F.col("category")), scored(F.col("faithfulness")))
    return rows.agg(F.avg(x).alias("value")).filter("value IS NOT NULL")


def recall_at(hits: DataFrame, expected: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Share of queries with any expected number among their first k hits (number lists)."""
    found = hits.filter(F.col("rank") <= k).join(expected, "query_id").groupBy(*by, "query_id").agg(F.max(F.arrays_overlap("article_numbers", "expected").cast("double")).alias("hit"))
    every = expected.select("query_id").join(hits.select(*by).distinct(), F.lit(True)) if by else expected.select("query_id")
    return every.join(found, [*by, "query_id"], "left").groupBy(*by).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def eval_rows(questions: DataFrame, hits: DataFrame, said: DataFrame) -> DataFrame:
    """One row per question as judges read it: id, category, user_input, retrieved_contexts (as
    placed), response, reference, sources and article_hit.

    questions: query_id, category, question, ground_truth, expected_articles; hits: query_id,
    place, text, article_numbers; said: query_id, answer, sources.
    """
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("c"), F.flatten(F.collect_list("article_numbers")).alias("cited"))
    row = questions.join(got, "query_id", "left").join(said.select("query_id", "answer", "sources"), "query_id", "left")
    contexts = F.transform(F.coalesce("c", F.array().cast("array<struct<place:int,text:string>>")), lambda x: x["text"])
    hit = article_hit(F.col("expected_articles"), F.coalesce("cited", F.array().cast("array<int>")))
    return row.select(F.col("query_id").alias("id"), "category", F.col("question").alias("user_input"), contexts.alias("retrieved_contexts"), F.col("answer").alias("response"), F.col("ground_truth").alias("reference"), "sources", hit.alias("article_hit"))


def sweep(rows: DataFrame, configs: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Scores of every configuration (rows: config and what mean_scores() reads), its position in
    `configs` (the first is the incumbent), its place by faithfulness and whether it is chosen."""
    position = F.array_position(F.array(*map(F.lit, configs)), F.col("config")) - 1
    scores = mean_scores(rows, ["config"], metrics).withColumn("position", position).filter("position >= 0")
    best = best_of(scores.select("position", "config", "faithfulness", "context_precision", "article_hit_rate")).select(F.col("config").alias("__best"))
    place = F.row_number().over(Window.orderBy(F.col("faithfulness").desc_nulls_last(), "position"))
    return scores.withColumn("place", place).join(best, F.lit(True), "left").withColumn("chosen", F.col("config") == F.col("__best")).drop("__best")
