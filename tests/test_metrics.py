"""Counters observed while frames are read, and their text exposition."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quern.operators import metrics, ops
from quern.sources import readers

ROWS = [("answered", ["EMAIL"], [], 0.95, 0.4), ("answered", [], ["EMAIL", "IBAN"], 0.2, 3.0), ("refused", None, None, 0.1, 400.0), ("invalid", [], [], None, None), ("answered", [], [], 1.0, 0.1)]
SCHEMA = "status string, asked array<string>, found array<string>, score double, seconds double"


def observed_once(spark, rows):
    seen = Observation()
    frame = spark.createDataFrame(rows, SCHEMA)
    cols = metrics.request_metrics("a\"b\\c\nd", F.col("status"), F.col("asked"), F.col("found"), F.col("score"), F.col("seconds"))
    assert metrics.observed(frame, seen, cols).count() == len(rows)
    return seen.get


def test_counters_are_added_told_and_read_back(spark, tmp_path):
    path = str(tmp_path / "table")
    metrics.add(spark, observed_once(spark, ROWS), path, "r", 0)
    metrics.add(spark, observed_once(spark, ROWS), path, "r", 0)  # the same batch again
    metrics.add(spark, observed_once(spark, ROWS[:2]), path, "r", 1)
    metrics.write_exposition(metrics.totals(spark, path), str(tmp_path / "text"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
    service = 'service="a\\"b\\\\c\\nd"'
    assert f'rag_requests_total{{{service},status="ok"}} 5.0' in lines
    assert f'rag_requests_total{{{service},status="error"}} 1.0' in lines
    assert f'rag_pii_redactions_total{{entity="EMAIL",{service},where="question"}} 2.0' in lines
    assert lines.index("# TYPE rag_requests_total counter") == lines.index("# HELP rag_requests_total Completed requests") + 1
    scores = [r[3] for r in [*ROWS, *ROWS[:2]] if r[3] is not None]
    buckets = [line.rsplit(" ", 1)[1] for line in lines if line.startswith("rag_retrieval_top_score_bucket")]
    told = [sum(s <= b for s in scores) for b in ops.SCORE_BOUNDS] + [len(scores)]
    assert sorted(map(float, buckets)) == sorted(told)
    samples = {(r.metric, r.labels.get("status"), r.labels.get("le")): r.value for r in readers.metric_samples(spark, str(tmp_path / "text")).collect()}
    assert samples["rag_requests_total", "ok", None] == 5 and samples["rag_requests_total", "refused", None] == 1
    assert samples["rag_request_latency_seconds_count", None, None] == 6 and samples["rag_request_latency_seconds_bucket", None, "+Inf"] == 6
    assert samples["rag_request_latency_seconds_bucket", None, "0.5"] == 3


def test_no_rows_count_nothing(spark, tmp_path):
    metrics.add(spark, observed_once(spark, []), str(tmp_path / "t"), "r")
    assert metrics.totals(spark, str(tmp_path / "t")).agg(F.sum("value")).first()[0] == 0
