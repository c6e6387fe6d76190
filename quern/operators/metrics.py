"""Counters and histograms with labels, counted while queries run, and their text exposition.

A frame is observed, so its counts come with whatever action runs it anyway.  What was
observed, by a batch or by each micro-batch of a stream, is added to a table of increments;
sums over that table are the counters.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quern.functions.pii import PATTERNS
from quern.operators.ops import LATENCY_BOUNDS, SCORE_BOUNDS

#: Names, kinds and help of the metrics; what a request's status counts as.
FAMILIES = {
    "rag_requests_total": ("counter", "Completed requests"),
    "rag_request_latency_seconds": ("histogram", "Seconds a request takes"),
    "rag_pii_redactions_total": ("counter", "Kinds of personal data taken out of questions and answers"),
    "rag_retrieval_top_score": ("histogram", "Best score of a request"),
}
STATUS = {"answered": "ok", "no_context": "no_context", "refused": "refused", "invalid": "error"}
INCREMENT = "metric string, labels map<string,string>, value double, run string, batch long"


def sample(metric: str, **labels: str) -> str:
    """A sample's name as it stands in an exposition."""
    quoted = (f'{k}="' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' for k, v in labels.items())
    return metric + ("{" + ",".join(quoted) + "}" if labels else "")


def histogram(metric: str, value: Column, bounds: list[float], **labels: str) -> dict[str, Column]:
    """Cumulative buckets, sum and count of the values that are not null."""
    out = {sample(f"{metric}_bucket", **labels, le=repr(float(b))): F.count_if(value <= b) for b in bounds}
    out[sample(f"{metric}_bucket", **labels, le="+Inf")] = F.count(value)
    return out | {sample(f"{metric}_sum", **labels): F.coalesce(F.sum(value.cast("double")), F.lit(0.0)), sample(f"{metric}_count", **labels): F.count(value)}


def request_metrics(service: str, status: Column, asked: Column | None = None, answered: Column | None = None, score: Column | None = None, seconds: Column | None = None) -> dict[str, Column]:
    """What is counted of requests: one each by status, one a kind of personal data found in
    question and answer, and histograms of best score and of seconds.  Label values are fixed
    sets, so their number is bounded."""
    kinds = F.coalesce(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[status], status)
    out = {sample("rag_requests_total", service=service, status=s): F.count_if(kinds == s) for s in dict.fromkeys(STATUS.values())}
    for where, found in (("question", asked), ("answer", answered)):
        if found is not None:
            out |= {sample("rag_pii_redactions_total", service=service, where=where, entity=e): F.count_if(F.coalesce(F.array_contains(found, e), F.lit(False))) for e in PATTERNS}
    if score is not None:
        out |= histogram("rag_retrieval_top_score", score, SCORE_BOUNDS, service=service)
    if seconds is not None:
        out |= histogram("rag_request_latency_seconds", seconds, LATENCY_BOUNDS, service=service, stage="total")
    return out


def observed(frame: DataFrame, name: str | Observation, metrics: dict[str, Column]) -> DataFrame:
    """The frame, which counts the metrics of its rows as they pass."""
    return frame.observe(name, *(c.alias(k) for k, c in metrics.items()))


def _rows(found: dict, run: str, batch: int) -> list[tuple]:
    return [(key, float(value), run, batch) for key, value in found.items() if value is not None]


def add(spark: SparkSession, found: dict, path: str, run: str, batch: int = 0) -> None:
    """Add what was observed in one batch of a run; done again, it takes its own place."""
    rows = spark.createDataFrame(_rows(found, run, batch), "key string, value double, run string, batch long")
    name = F.regexp_extract("key", r"^([^{]*)", 1)
    pattern = r'([A-Za-z_]\w*)="((?:[^"\\]|\\.)*+)"'
    labels = F.map_from_arrays(F.regexp_extract_all("key", F.lit(pattern), F.lit(1)), F.regexp_extract_all("key", F.lit(pattern), F.lit(2)))
    rows.select(name.alias("metric"), labels.alias("labels"), "value").coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """metric, labels and value of all counters of the table at path."""
    held = spark.read.schema(INCREMENT).parquet(path)
    one = held.groupBy("metric", F.array_sort(F.map_entries("labels")).alias("l")).agg(F.sum("value").alias("value"))
    return one.select("metric", F.map_from_entries("l").alias("labels"), "value")


class CounterListener(StreamingQueryListener):
    """Adds what the micro-batches of queries with `name` observed to a counter table."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and event.progress.numInputRows:
            add(self.spark, found.asDict(), self.path, str(event.progress.id), event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def exposition(counters: DataFrame) -> DataFrame:
    """value: the lines of the text format in order, each family after its help and type.

    Label values are as samples wrote them, escapes and all.
    """
    family = F.regexp_replace("metric", "_(bucket|sum|count)$", "")
    known = F.create_map(*(x for k, v in FAMILIES.items() for x in (F.lit(k), F.struct(*map(F.lit, v)))))
    labels = F.transform(F.map_entries("labels"), lambda x: F.concat(x["key"], F.lit('="'), x["value"], F.lit('"')))
    bound = F.coalesce(F.try_element_at("labels", F.lit("le")).try_cast("double"), F.lit(-1.0))
    name = F.concat("metric", F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(labels, ","), F.lit("}"))).otherwise(""))
    rows = counters.select(family.alias("family"), F.lit(1).alias("part"), F.to_json(F.map_filter("labels", lambda k, _: k != "le")).alias("who"), "metric", bound.alias("bound"), F.concat(name, F.lit(" "), F.col("value").cast("string")).alias("value"))
    heads = rows.select("family").distinct().withColumn("known", known[F.col("family")])
    head = F.concat(F.lit("# HELP "), "family", F.lit(" "), F.coalesce("known.col2", F.lit("")), F.lit("\n# TYPE "), "family", F.lit(" "), F.coalesce("known.col1", F.lit("untyped")))
    heads = heads.select("family", F.lit(0).alias("part"), F.lit("").alias("who"), F.lit("").alias("metric"), F.lit(0.0).alias("bound"), head.alias("value"))
    return heads.unionByName(rows).orderBy("family", "part", "who", "metric", "bound").select("value")


def write_exposition(counters: DataFrame, path: str) -> None:
    """One text file, as a scrape gets it; counters are as few as their fixed labels."""
    exposition(counters).coalesce(1).write.mode("overwrite").text(path)
