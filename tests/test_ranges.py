"""Whole orders over ranges and drift in blocks, against plain programs."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.operators import drift, evaluation, ranges


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_places_in_the_whole_order(spark):
    rows = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("v"))
    got = ranges.ranked(rows, "k").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r.k)] == list(range(5000))
    assert ranges.ranked(rows.filter("false"), "k").count() == 0


def test_bucket_sample_takes_one_of_each_contiguous_bucket(spark):
    for total, n in ((103, 10), (100, 10), (7, 10), (1, 1), (0, 3)):
        rows = spark.range(total).select((F.col("id") * 3).alias("k"), F.lit("x").alias("t"))
        sample = evaluation.bucket_sample(rows, "k", n)
        assert "SinglePartition" not in plan_of(sample).split("rank")[0]
        h = lambda k: hashlib.md5(f"0|{k}".encode()).hexdigest()
        plain = [min(b, key=lambda k: (h(k), k)) for b in np.array_split(np.arange(total) * 3, n) if len(b)]
        assert sorted(r.k for r in sample.collect()) == sorted(map(int, plain))


def test_thresholds_equal_a_plain_permutation(spark, monkeypatch):
    monkeypatch.setattr(drift, "DRAWN_ROWS", 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(330, 6)) + 1
    base = spark.createDataFrame(pd.DataFrame({"id": np.arange(330), "vector": [v.tolist() for v in x]}), "id long, vector array<double>").repartition(4)
    sizes = spark.createDataFrame([("a", 1), ("b", 25), ("c", 200), ("d", 10_000)], "window string, n int")
    got = {r.window: r.threshold for r in drift.permuted_threshold(base, sizes, trials=60).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for window, n in (("a", 1), ("b", 25), ("c", 200), ("d", 329)):
        out = []
        for trial in range(60):
            order = sorted(range(330), key=lambda i: hashlib.md5(f"{trial}|{i}".encode()).hexdigest())
            a, b = u[order[:n]].sum(0), u[order[n:]].sum(0)
            out.append(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        assert np.isclose(got[window], np.percentile(out, 99))
    assert drift.permuted_threshold(base.limit(1), sizes).count() == 0
