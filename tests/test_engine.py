import json
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import pii, stats
from quern.functions import text as T
from quern.operators import drift, evaluation, index, ops, retrieval
from quern.plans.config import settings
from quern.sources import readers, sinks
from quern.streaming import rates, redaction

CASES = [
    ("mail a.b@c.org now", "mail [EMAIL] now", ["EMAIL"]),
    ("card 4111 1111 1111 1111 ok", "card [CREDIT_CARD] ok", ["CREDIT_CARD"]),
    ("card 4111 1111 1111 1112 no", "card 4111 1111 1111 1112 no", []),
    ("id ٢٩٠٠١٠١١٢٣٤٥٦٧ x", "id [EG_NATIONAL_ID] x", ["EG_NATIONAL_ID"]),
    ("id 29013011234567", "id 29013011234567", []),
    ("call +20 1012345678 or 0020-1112345678", "call [EG_PHONE] or [EG_PHONE]", ["EG_PHONE"]),
    ("iban EG38 0019 0005 0000 0000 2631 8000 2", "iban [IBAN]", ["IBAN"]),
    ("Articles 54-80 of law 131 of 1948, 1000000", "Articles 54-80 of law 131 of 1948, 1000000", []),
    ("01012345678a@b.cd", "[EMAIL]", ["EMAIL"]),
    ("", "", []),
]


def test_redaction(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").withColumn("s", pii.spans(F.col("t")))
    got = {r.i: (r.o, r.e) for r in df.select("i", pii.redact(F.col("t"), F.col("s")).alias("o"), pii.entities(F.col("s")).alias("e")).collect()}
    for i, (_, out, kinds) in enumerate(CASES):
        assert got[i] == (out, kinds)


def test_streamed_text_equals_the_whole(spark):
    rng, whole = random.Random(5), "x " * 40 + " and ".join(c[0] for c in CASES) + " y" * 50
    want = "x " * 40 + " and ".join(c[1] for c in CASES) + " y" * 50
    for _ in range(50):
        held, told, out, at = "", 0, "", 0
        while at < len(whole):
            n = rng.randint(1, 7)
            text, _, held, told = redaction.released(held, told, whole[at : at + n], at + n >= len(whole))
            out, at = out + text, at + n
        assert out == want


def test_both_forms_of_spans_agree_on_random_texts(spark):
    rng = random.Random(8)
    parts = [c[0] for c in CASES] + ["١٢٣٤٥٦٧٨٩٠", "4111-1111-1111-1111", "+201012345678", "a@b", "@c.de", " ", "-", "۰۱۰۱۲۳۴۵۶۷۸", "é", "EG38", "2", "0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pii.spans(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(x.start, x.end, x.entity) for x in r.s] == redaction.found_spans(r.t), r.t


def test_refusal_texts_are_refusals(spark):
    rows = spark.createDataFrame([(t,) for t in T.REFUSAL_TEXT.values()], "t string").select(T.is_refusal(F.col("t")).alias("r")).collect()
    assert all(r.r for r in rows)


def test_stream_query(spark, tmp_path):
    pieces = [(f"r{k}", i, whole[i * 3 : i * 3 + 3], i * 3 + 3 >= len(whole)) for k, whole in enumerate(("z" * 70 + " a.b@c.org " + "w" * 90, "plain")) for i in range(-(-len(whole) // 3))]
    kind = "request_id string, seq long, piece string, is_last boolean"
    spark.createDataFrame(pieces, kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = redaction.redact_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    text = {}
    for r in out.orderBy("request_id", "seq").collect():
        text[r.request_id] = text.get(r.request_id, "") + r.text
    assert text == {"r0": "z" * 70 + " [EMAIL] " + "w" * 90, "r1": "plain"}
    events = [json.loads(r.event) for r in redaction.events(out).filter("request_id = 'r1'").collect()]
    assert {e["type"] for e in events} == {"token", "done"}
    started = spark.sql("SELECT 'r1' AS request_id, timestamp'2024-01-01 00:00:00' AS ts")
    emitted = spark.sql("SELECT * FROM VALUES ('r1', '', timestamp'2024-01-01 00:00:01'), ('r1', 'a', timestamp'2024-01-01 00:00:03') AS t(request_id, text, ts)")
    assert redaction.first_text(emitted, started).first().seconds == 3.0


def test_rates_and_alerts_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, 'a' AS k FROM range(900)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = rates.event_rates(stream, "5 minutes", "5 minutes", "1 minute", ["k"], 300.0).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.n, r.rate) for r in spark.table("rates").collect()} == {(300, 1.0)}
    note = [("firing", [("resolved", {"alertname": "X", "window": "w"}, {"summary": "s"}), (None, {}, {})])]
    df = spark.createDataFrame(note, "status string, alerts array<struct<status: string, labels: map<string,string>, annotations: map<string,string>>>")
    lines = [r.value for r in sinks.alert_lines(df, F.lit("T")).collect()]
    assert lines == ["[T] RESOLVED - X window=w: s", "[T] FIRING - ?: "]


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id string, doc_id string, vector array<float>, article_numbers array<int>, payload int")


def test_index_life_cycle(spark, tmp_path):
    path = str(tmp_path / "index")
    old = points(spark, [("a", "main", [1.0, 0.0], [1], 0), ("b", "law", [0.0, 1.0], [1], 0), ("c", "law", [1.0, 1.0], [2], 0)])
    assert index.create(old, path).count() == 3
    new = points(spark, [("b", "law", [0.0, 2.0], [1], 1)])
    assert index.reindex(spark, path, new, ["law"], "main") == {"law": (2, 1)}
    assert index.reindex(spark, path, new, ["law"], "main") == {"law": (1, 1)}
    assert {r.point_id for r in spark.read.parquet(path).collect()} == {"a", "b"}
    with pytest.raises(index.IndexMismatch):
        index.reindex(spark, path, points(spark, [("d", "law", [1.0], [1], 0)]), ["law"], "main")
    with pytest.raises(index.IndexMismatch):
        index.create(old.unionByName(old), path)
    target = str(tmp_path / "copy")
    assert index.seed(spark, path, target) == {"copied": 2, "points": 2, "skipped": False}
    assert index.seed(spark, path, target)["skipped"] and not index.seed(spark, path, target, recreate=True)["skipped"]
    assert index.covered_numbers(spark.read.parquet(path)).count() == 1


def test_retrieval_lanes_twins_and_gate(spark):
    rows = []
    for n, lang, doc, v in ((1, "en", "primary", [1.0, 0.1]), (1, "ar", "primary", [0.2, 1.0]), (2, "en", "primary", [0.9, 0.3]), (2, "en", "other", [1.0, 0.0]), (3, "en", "other", [0.8, 0.0])):
        rows.append((str(n), lang, doc, v, [n], f"{doc} {n} {lang}", f"L, Article {n}", False))
    df = spark.createDataFrame(rows, "chunk_id string, lang string, doc_id string, vector array<float>, article_numbers array<int>, text string, citation string, is_repealed boolean")
    df = df.withColumn("point_id", T.point_id(F.col("chunk_id"), F.col("lang"), F.col("doc_id")))
    q = spark.createDataFrame([(1, "What of Article 1?", [1.0, 0.0]), (2, "مادة ١", [1.0, 0.0]), (3, "anything", [-1.0, 0.0])], "query_id int, question string, query_vector array<float>")
    hits = retrieval.retrieve(q, df)
    got = {}
    for r in hits.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert got[1] == ["primary 1 en", "other 2 en", "other 3 en"]
    assert got[2][0] == "primary 1 ar" and len(got[2]) == 3
    verdict = {r.query_id: r for r in retrieval.gate(hits).collect()}
    assert verdict[1].exempt and not verdict[1].refused and verdict[3].refused and not verdict[3].exempt
    said = {r.query_id: r for r in retrieval.answers(q, hits, spark.createDataFrame([(1, "<think>x</think>yes"), (2, "no"), (3, "never")], "query_id int, answer string")).collect()}
    assert (said[1].status, said[1].answer, said[1].sources) == ("answered", "yes", ["L, Article 1", "L, Article 2", "L, Article 3"])
    assert said[3].status == "refused" and said[3].sources == []
    assert retrieval.gate(hits, None).filter("refused").count() == 0


def test_binomial_and_percentiles(spark):
    assert spark.range(1).select(stats.binomial_limit(F.lit(16).cast("long")).alias("k")).first().k == 4
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "g string, x double")
    assert df.agg(stats.nearest_rank("x", 95).alias("p")).first().p == 19.0
    assert stats.floor_percentile(df, "x", 95, ["g"]).first().value == 20.0
    assert stats.bench_percentile(df, "x", 0.95, ["g"]).first().value == 19.0
    b = stats.bucket_counts(df, "x", [5.0, 10.0], ["g"])
    assert stats.bucket_quantile(b, 0.25, ["g"]).first().value == 5.0 and stats.bucket_quantile(b, 0.95, ["g"]).first().value == 10.0


def test_drift_thresholds(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 8)) + 2)], "id int, vector array<double>")
    far = spark.createDataFrame([("same", i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(16, 8)) + 2)] + [("off", i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(16, 8)) - 2)], "window string, id int, vector array<double>")
    sizes = far.groupBy("window").agg(F.count("*").cast("int").alias("n"))
    for threshold in (drift.permuted_threshold(base, sizes, 100), drift.numpy_threshold(base, sizes, 100)):
        got = {r.window: r.drifted for r in drift.drift_report(far, base, threshold).collect()}
        assert got == {"same": False, "off": True}


def test_best_of_keeps_the_incumbent(spark):
    kind = "position int, config string, faithfulness double, context_precision double, article_hit_rate double"
    best = lambda rows: evaluation.best_of(spark.createDataFrame(rows, kind)).first().config
    assert best([(0, "now", 0.8, 0.5, 0.5), (1, "new", 0.84, 0.9, 0.9)]) == "now"
    assert best([(0, "now", 0.8, 0.5, 0.5), (1, "new", 0.86, 0.1, 0.1)]) == "new"
    assert best([(0, "now", None, None, 0.5), (1, "new", None, None, 0.6)]) == "new"
    assert best([(0, "now", 0.8, 0.5, 0.5), (1, "x", 0.9, 0.5, 0.5), (2, "y", 0.9, 0.5, 0.5)]) == "x"


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    log = readers.access_log(spark, put("log", '{"uri":"/ask","status":200,"request_time":1.5,"upstream":"u","release":"stable-1"}\n\n{"uri":"/ask","status":502,"upstream":"u","release":""}\n{"uri":"/ask","status":502,"upstream":"v"}\n'))
    assert {r.release: r["count"] for r in ops.attribute(log).groupBy("release").count().collect()} == {"stable-1": 2, "unknown": 1}
    metrics = put("m", '# HELP x\nrag_request_latency_seconds_sum{service="a",stage="total"} 10.5\nrag_request_latency_seconds_count{service="a",stage="total"} 2\nrag_request_latency_seconds_sum{service="b",stage="total"} 1.5\nother{a="1",b="q\\"x"} 3\nplain 4\n')
    assert ops.stage_means(readers.stage_samples(spark, metrics)).first().mean_s == 6.0
    samples = {r.metric: r for r in readers.metric_samples(spark, metrics).filter("metric IN ('other', 'plain')").collect()}
    assert samples["other"].labels["a"] == "1" and samples["plain"].value == 4.0
    csv = put("s_stats.csv", "Type,Name,Request Count,Failure Count,Requests/s,50%,95%,99%,Max Response Time\nPOST,/ask,47,0,0.4,1200,2200,N/A,2540\n,Aggregated,47,0,0.4,1,2,3,4\n")
    one = ops.load_summary(readers.statistics_csv(spark, csv)).first()
    assert (one.requests, one.failure_rate, one.rps, one.p95_s, one.p99_s) == (47, 0.0, 0.4, 2.2, 0.0)
    assert readers.last_match(spark, put("l", "took 1.5 GiB\ntook 2.85 GiB\n"), r"took ([0-9.]+) GiB").first().value == "2.85"
    assert readers.last_match(spark, put("l2", "none"), r"took ([0-9.]+) GiB").first().value is None
    windows = readers.query_windows(spark, put("w", json.dumps({"a": {"description": "d", "queries": ["x", "y"]}, "b": {"queries": ["z"]}})))
    assert sorted((r.window, r.i, r.query) for r in windows.collect()) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    rows = [{"_id": "1", "faithfulness": 0.5}]
    for i, body in enumerate((rows, {"meta": {}, "rows": rows})):
        got = readers.report_rows(spark, put(f"r{i}", json.dumps(body)), "_id: string, faithfulness: double")
        assert got.first().faithfulness == 0.5 and readers.public_columns(got).columns == ["faithfulness"]
    assert readers.document_folder(spark, str(tmp_path / "absent")).count() == 0


def test_sinks_settings_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|c"), (1, "a\nd")], "i int, t string")
    text = sinks.markdown(df, {"I": F.col("i").cast("string"), "T": F.col("t")}, ["i"]).first().text
    assert text == "| I | T |\n|---|---|\n| 1 | a d |\n| 2 | b\\|c |\n"
    sinks.log_run("r", {"threshold": "700"}, spark.sql("SELECT 0.5D AS f, CAST(NULL AS DOUBLE) AS g"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).first().metrics == {"f": 0.5}
    assert settings({"chunking": {"threshold": 400}}, threshold=None).threshold == 400 and settings({"threshold": 400}, threshold=9).threshold == 9
    registry = spark.createDataFrame([], "model string, version int, alias string, config string, tags map<string,string>")
    registry = ops.promote(ops.promote(registry, "m", "a", {"f": 0.5}), "m", "b", {"f": 0.91234, "f_n_scored": 3, "g": None})
    got = {r.version: r for r in registry.collect()}
    assert got[1].alias is None and got[2].alias == "production" and got[2].tags == {"f": "0.9123"}
