"""Drift of query windows against a baseline, and calibration of the refusal threshold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.stats import binomial_limit
from quern.functions.vector import centroids, dot
from quern.operators.index import knn_arrow

#: Trials and percentile of the calibration, low percentile, alpha, margin.
TRIALS, PERCENTILE, LOW_PERCENTILE, ALPHA, MARGIN = 1000, 99, 5, 0.01, 0.005


#: Rows whose hashes of all trials are held at once.
DRAWN_ROWS = 512


def centroid_drift(windows: DataFrame, baseline: DataFrame, vector: str = "vector") -> DataFrame:
    """window, n_queries, centroid_cosine, drift against the whole baseline."""
    base = centroids(baseline, vector).select(F.col("centroid").alias("__b"))
    sizes = windows.groupBy("window").agg(F.count("*").alias("n_queries"))
    own = centroids(windows, vector, "window").join(sizes, "window").join(base, F.lit(True))
    near = dot(F.col("centroid"), F.col("__b"))
    return own.select("window", "n_queries", near.alias("centroid_cosine"), (1 - near).alias("drift"))


def nearest_baseline(windows: DataFrame, baseline: DataFrame, vector: str = "vector", key: str = "id") -> DataFrame:
    """window, key and the largest cosine of each window query to any baseline query."""
    asked = windows.select(F.concat_ws("|", F.col(key).cast("string"), "window").alias("query_id"), F.col(vector).alias("query_vector"), "window", key)
    near = knn_arrow(asked, baseline.select(F.monotonically_increasing_id().alias("point_id"), F.col(vector).alias("vector")), 1)
    return asked.join(near, "query_id").select("window", key, F.col("score").alias("similarity"))


def _drawn(keys: pd.Series, trials: int) -> np.ndarray:
    """trials x keys: the first 64 bits of the MD5 of trial and key."""
    heads = [f"{trial}|".encode() for trial in range(trials)]
    data = [k.encode() for k in keys]
    digests = b"".join(hashlib.md5(h + k).digest()[:8] for h in heads for k in data)
    return np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(trials, len(data))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), DRAWN_ROWS):
            yield batch.iloc[start : start + DRAWN_ROWS]


def permuted_threshold(baseline: DataFrame, sizes: DataFrame, trials: int = TRIALS, percentile: float = PERCENTILE, vector: str = "vector", key: str = "id") -> DataFrame:
    """window and the drift that chance alone reaches: the percentile over trials.

    A trial takes the n rows of least MD5 of trial and key as the sample, the rest as the
    other side.  sizes: window, n, a few rows; at most one less than the baseline is taken.
    Keys are unique.  The baseline is scanned in blocks three times: counts of the hashes'
    first byte show where the n-th lies, the rows there are ordered to find it, and then
    every block multiplies who is in by its vectors.  Tasks send sums of fixed size.
    """
    spark, total = baseline.sparkSession, baseline.count()
    wanted = [(r.window, min(r.n, total - 1)) for r in sizes.select("window", "n").collect()]
    if total < 2 or not wanted:
        return spark.createDataFrame([], "window string, threshold double")
    keys = baseline.select(F.col(key).cast("string").alias("k"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((trials, 256), dtype=np.int64)
        for block in _blocks(batches):
            first = (_drawn(block["k"], trials) >> np.uint64(56)).astype(np.int64)
            held += np.bincount((first + 256 * np.arange(trials)[:, None]).ravel(), minlength=256 * trials).reshape(trials, 256)
        at = np.argwhere(held)
        yield pd.DataFrame({"trial": at[:, 0], "bin": at[:, 1], "n": held[at[:, 0], at[:, 1]]})

    bins = keys.mapInPandas(counted, "trial int, bin int, n long").groupBy("trial", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("trial").orderBy("bin"))
    asked = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(wanted)], "size int, take long")
    edges = bins.withColumn("upto", upto).join(F.broadcast(asked), (F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
    edges = {(r.size, r.trial): (r.bin, r.place) for r in edges.select("size", "trial", "bin", (F.col("take") - F.col("upto") + F.col("n")).alias("place")).collect()}
    edge_bin = np.array([[edges[s, t][0] for t in range(trials)] for s in range(len(wanted))])

    def near_edge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            h = _drawn(block["k"], trials)
            for s in range(len(wanted)):
                trial, row = np.nonzero((h >> np.uint64(56)) == edge_bin[s].astype(np.uint64)[:, None])
                # as signed numbers in the same order
                yield pd.DataFrame({"size": s, "trial": trial, "h": (h[trial, row] ^ np.uint64(1 << 63)).view(np.int64)})

    place = F.row_number().over(Window.partitionBy("size", "trial").orderBy("h"))
    need = spark.createDataFrame([(s, t, p) for (s, t), (_, p) in edges.items()], "size int, trial int, place long")
    last = keys.mapInPandas(near_edge, "size int, trial int, h long").withColumn("place", place.cast("long")).join(F.broadcast(need), ["size", "trial", "place"])
    cut = np.zeros((len(wanted), trials), dtype=np.int64)
    for r in last.select("size", "trial", "h").collect():
        cut[r["size"], r.trial] = r.h
    cut = cut.view(np.uint64) ^ np.uint64(1 << 63)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = whole = None
        for block in _blocks(batches):
            v = np.vstack(block["v"].to_numpy()).astype(np.float64)
            u, h = v / np.linalg.norm(v, axis=1, keepdims=True), _drawn(block["k"], trials)
            part = np.stack([(h <= c[:, None]).astype(np.float64) @ u for c in cut])
            held, whole = (part, u.sum(0)) if held is None else (held + part, whole + u.sum(0))
        if held is not None:
            rows = [(s, t, held[s, t].tolist()) for s in range(len(cut)) for t in range(trials)]
            yield pd.DataFrame([*rows, (-1, -1, whole.tolist())], columns=["size", "trial", "sums"])

    vectors = baseline.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v"))
    sums = vectors.mapInPandas(summed, "size int, trial int, sums array<double>").select("size", "trial", F.posexplode("sums").alias("dim", "x")).groupBy("size", "trial", "dim").agg(F.sum("x").alias("a"))
    sums = F.broadcast(sums.filter("size < 0").select("dim", F.col("a").alias("whole"))).join(sums.filter("size >= 0"), "dim").withColumn("b", F.col("whole") - F.col("a"))
    near = F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    drifts = sums.groupBy("size", "trial").agg((1 - near).alias("drift")).groupBy("size").agg(F.percentile("drift", percentile / 100).alias("threshold"))
    names = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(wanted)], "size int, window string")
    return drifts.join(F.broadcast(names), "size").select("window", "threshold")


def numpy_threshold(baseline: DataFrame, sizes: DataFrame, trials: int = TRIALS, percentile: float = PERCENTILE, seed: int = 0, vector: str = "vector", key: str = "id") -> DataFrame:
    """permuted_threshold() with numpy's generator, drawn by seed, for equal numbers.

    The baseline is a question set of stated size; it is one group per window.
    """

    def calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        v = np.vstack(pdf["v"].to_numpy()).astype(np.float64)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        rng, n = np.random.default_rng(seed), min(int(pdf["n"].iloc[0]), len(u) - 1)
        whole, out = u.sum(0), []
        for _ in range(trials):
            part = u[rng.permutation(len(u))[:n]].sum(0)
            rest = whole - part
            out.append(1 - float(part @ rest / (np.linalg.norm(part) * np.linalg.norm(rest))))
        return pd.DataFrame({"window": [pdf["window"].iloc[0]], "threshold": [float(np.percentile(out, percentile))]})

    rows = baseline.select(F.col(key).alias("k"), F.col(vector).alias("v")).join(sizes.select("window", "n"), F.lit(True))
    return rows.groupBy("window").applyInPandas(calibrate, "window string, threshold double")


def drift_report(windows: DataFrame, baseline: DataFrame, thresholds: DataFrame) -> DataFrame:
    return centroid_drift(windows, baseline).join(thresholds, "window").withColumn("drifted", F.col("drift") > F.col("threshold"))


def off_corpus(baseline_scores: DataFrame, window_scores: DataFrame, low: float = LOW_PERCENTILE, alpha: float = ALPHA) -> DataFrame:
    """Per window: mean best score, cut-off, low queries, their limit and share, off_corpus.

    baseline_scores: score of the substantive baseline questions; window_scores: window, score.
    """
    cut = baseline_scores.agg(F.percentile("score", low / 100).alias("cut"))
    joined = window_scores.join(cut, F.lit(True))
    one = joined.groupBy("window").agg(F.avg("score").alias("corpus_score_mean"), F.max("cut").alias("corpus_cutoff"), F.count_if(F.col("score") < F.col("cut")).alias("low_similarity_queries"), F.count("*").alias("n"))
    one = one.withColumn("low_similarity_limit", binomial_limit(F.col("n"), low / 100, alpha))
    return one.withColumns({"off_corpus_share": F.col("low_similarity_queries") / F.col("n"), "off_corpus": F.col("low_similarity_queries") >= F.col("low_similarity_limit")}).drop("n")


def threshold_sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per threshold and set: refused and all questions, in and out of the corpus.

    rows: set, in_corpus, exempt, top_score (null: no hits).  Refused: not exempt and below.
    """
    refused = ~F.col("exempt") & F.coalesce(F.col("top_score") < F.col("threshold"), F.lit(False))
    joined = rows.join(thresholds.select("threshold").distinct(), F.lit(True)).withColumn("r", refused)
    side = F.col("in_corpus")
    return joined.groupBy("threshold", "set").agg(F.count_if(side & F.col("r")).alias("in_corpus_refused"), F.count_if(side).alias("in_corpus"), F.count_if(~side & F.col("r")).alias("out_of_corpus_refused"), F.count_if(~side).alias("out_of_corpus"))


def recommended_threshold(rows: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Just below the lowest best score of the in-corpus tuning questions that are gated."""
    gated = F.when((F.col("set") == "tune") & F.col("in_corpus") & ~F.col("exempt"), F.col("top_score"))
    return rows.agg(F.bround(F.min(gated) - margin, 3).alias("threshold"))


def closest_calls(rows: DataFrame, n: int = 6) -> DataFrame:
    """The n lowest in-corpus and the n highest out-of-corpus best scores."""
    low = rows.filter("in_corpus AND top_score IS NOT NULL").orderBy("top_score", "question").limit(n)
    return low.unionByName(rows.filter("NOT in_corpus AND top_score IS NOT NULL").orderBy(F.desc("top_score"), "question").limit(n))
