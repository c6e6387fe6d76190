"""The four Markdown reports: a heading and one table, as a frame of one row, `text`.

Reports are of stated size: windows, runs, figures and thresholds, never rows of a corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import fixed, percent
from quern.sources.sinks import markdown


def _headed(table: DataFrame, title: str) -> DataFrame:
    return table.select(F.concat(F.lit(f"# {title}\n\n"), F.col("text")).alias("text"))


def drift(report: DataFrame) -> DataFrame:
    """report: window, n_queries, centroid_cosine, drift, threshold, drifted."""
    said = F.when(F.col("drifted"), "drifted").otherwise("stable")
    cells = {"window": F.col("window"), "queries": F.col("n_queries").cast("string"), "cosine": fixed(F.col("centroid_cosine"), 4), "drift": fixed(F.col("drift"), 4), "threshold": fixed(F.col("threshold"), 4), "verdict": said}
    return _headed(markdown(report, cells, ["window"]), "Embedding drift")


def load(runs: DataFrame) -> DataFrame:
    """runs: run and what load_summary() gives."""
    cells = {"run": F.col("run"), "requests": F.col("requests").cast("string"), "failures": F.col("failures").cast("string"), "failure rate": percent(F.col("failure_rate"), 2), "p50": fixed(F.col("p50_s"), 2, " s"), "p95": fixed(F.col("p95_s"), 2, " s")}
    return _headed(markdown(runs, cells, ["run"]), "Load test")


def variants(summary: DataFrame) -> DataFrame:
    """summary: variant and what latency_summary() gives."""
    cells = {"variant": F.col("variant"), "p50": fixed(F.col("latency_p50_s"), 2, " s"), "p95": fixed(F.col("latency_p95_s"), 2, " s"), "first token p50": fixed(F.col("ttft_p50_s"), 2, " s"), "tokens/s p50": fixed(F.col("tokens_per_s_p50"), 2)}
    return _headed(markdown(summary, cells, ["variant"]), "Variants")


def calibration(sweep: DataFrame) -> DataFrame:
    """sweep: what threshold_sweep() gives."""
    share = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" of "), F.col(b).cast("string"))
    cells = {"threshold": fixed(F.col("threshold"), 3), "set": F.col("set"), "in corpus refused": share("in_corpus_refused", "in_corpus"), "out of corpus refused": share("out_of_corpus_refused", "out_of_corpus")}
    return _headed(markdown(sweep, cells, ["threshold", "set"]), "Refusal threshold")
