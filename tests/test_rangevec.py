"""Steps of range and instant vectors against evaluation step by step."""

import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from quern.operators import ops, rangevec

T0 = 1_704_067_200


def made(seed, n=160):
    rng, rows = random.Random(seed), []
    for series in ("a", "b", None):
        t, v = T0, 0.0
        for _ in range(n):
            t += rng.choice([1, 5, 14, 15, 16, 30, 90, 400])
            v = v + rng.randint(0, 9) if rng.random() < 0.9 else float(rng.randint(0, 3))
            rows.append((series, datetime.fromtimestamp(t, UTC), v, t))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "s string, ts timestamp, value double, t long").repartition(3)


def steps_of(rows):
    return range(T0, max(r[3] for r in rows) + 4000, 15)


def test_increases_equal_a_plain_evaluation(spark):
    rows = made(1)
    for lookback in (60, 300, 3600):
        want = {}
        for s in ("a", "b", None):
            own = sorted((t, v) for x, _, v, t in rows if x == s)
            for at in steps_of(rows):
                seen = [v for t, v in own if at - lookback < t <= at]
                if len(seen) > 1:
                    want[s, at] = sum(b if b < a else b - a for a, b in zip(seen, seen[1:], strict=False))
        got = {(r.s, r.at): (r.increase, r.rate) for r in rangevec.increases(frame(spark, rows), ["s"], lookback).withColumn("at", F.unix_timestamp("at")).collect()}
        assert {k: v[0] for k, v in got.items()} == want
        assert all(abs(v[0] / lookback - v[1]) < 1e-12 for v in got.values())


def test_instants_and_holds_equal_a_plain_evaluation(spark):
    rows = [(s, ts, float(int(v) % 3 > 0), t) for s, ts, v, t in made(2)]
    last, firing = {}, {}
    for s in ("a", "b", None):
        own, since = sorted((t, v) for x, _, v, t in rows if x == s), None
        for at in steps_of(rows):
            seen = [v for t, v in own if at - 300 < t <= at]
            if not seen:
                since = None
                continue
            last[s, at] = seen[-1]
            since = (since if since is not None else at) if seen[-1] == 0 else None
            firing[s, at] = since is not None and at - since >= 60
    key = F.unix_timestamp("at")
    assert {(r.s, r.at): r.value for r in rangevec.instant(frame(spark, rows), ["s"]).withColumn("at", key).collect()} == last
    assert {(r.s, r.at): r.firing for r in ops.down_for(frame(spark, rows), ["s"]).withColumn("at", key).collect()} == firing
    assert any(firing.values()) and not all(firing.values())


def test_sums_of_a_step_are_kept_without_sorting(spark):
    said = rangevec.increases(frame(spark, made(4, 20)), ["s"], 300)._jdf.queryExecution().toString()
    assert "SortAggregate" not in said
