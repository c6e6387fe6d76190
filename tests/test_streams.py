"""Ordered answer channels and alert groups, in many micro-batches, against plain programs."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.functions import pii
from quern.streaming import alerting, channel
from quern.streaming.running import run_to_end

BEGIN = datetime(2024, 1, 1, tzinfo=UTC)


def stream_of(spark, batches, schema, path):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def pieces_of(rng, name, text, ending, sources=("Law, Article 1",)):
    cut, at = [], 0
    while at < len(text) or not cut:
        n = rng.randint(1, 7)
        cut.append(text[at : at + n])
        at += n
    return [(name, i, p, i + 1 == len(cut) and ending == "last", i + 1 == len(cut) and ending == "failed", list(sources), ["IBAN"]) for i, p in enumerate(cut)]


def test_channel_orders_redacts_and_ends(spark, tmp_path):
    rng = random.Random(3)
    long = "x " * 60 + "mail a.b@c.org, call +20 1012345678 or pay 4111 1111 1111 1111. " * 3 + "end ٠١٠١٢٣٤٥٦٧٨"
    asked = {"whole": (long, "last"), "short": ("a@b.co", "last"), "empty": ("", "last"), "fails": (long, "failed"), "silent": (long, "none"), "gap": (long, "last")}
    batches = [[] for _ in range(6)]
    for name, (text, ending) in asked.items():
        rows = pieces_of(rng, name, text, ending)
        for i, row in enumerate(rows):
            slice_ = min(4, 5 * i // len(rows)) + (rng.random() < 0.2)
            if name == "gap" and i == len(rows) // 2:
                continue
            for _ in range(1 + (rng.random() < 0.1)):  # some come twice
                batches[slice_].append((*row, BEGIN + timedelta(minutes=slice_)))
        for rows_ in batches:
            rng.shuffle(rows_)
    late = [("whole", 900, "after the end", False, False, None, None, BEGIN + timedelta(minutes=6))]
    clock = [("", None, None, False, False, None, None, BEGIN + timedelta(hours=2))]
    stream = stream_of(spark, [*batches, late, clock], channel.PIECE, tmp_path)
    events = run_to_end(channel.answer_channel(stream, 300), str(tmp_path / "run"), schema=channel.EVENT)
    got = {}
    for r in events.orderBy("request_id", "n").collect():
        got.setdefault(r.request_id, []).append(r)
    assert set(got) == set(asked)
    whole = {r.t: (r.o, r.e) for r in spark.createDataFrame([(t,) for t in {x for x, _ in asked.values()}], "t string").withColumn("s", pii.spans(F.col("t"))).select("t", pii.redact(F.col("t"), F.col("s")).alias("o"), pii.entities(F.col("s")).alias("e")).collect()}
    for name, events_ in got.items():
        text, ending = asked[name]
        assert [e.n for e in events_] == list(range(len(events_)))
        told = "".join(e.text for e in events_ if e.type == "token")
        last = json.loads(events_[-1].event)
        if name in ("gap", "fails"):
            assert last == {"type": "error", "message": channel.FAILED if name == "fails" else channel.TIMED_OUT}
            assert len(told) > 50 and (whole[text][0].startswith(told) or name == "gap")
            assert "1012345678" not in told
        elif name == "silent":
            assert told == whole[text][0] and last == {"type": "error", "message": channel.TIMED_OUT}
        else:
            assert told == whole[text][0]
            assert last == {"type": "done", "sources": ["Law, Article 1"], "pii_redacted": sorted({*whole[text][1], "IBAN"})}
    lines = [r.line for r in channel.sse(events.filter("request_id = 'short'")).collect()]
    assert all(x.startswith("data: {") and x.endswith("\n\n") for x in lines) and len(lines) == 2


def ticking(changes, upto, repeat):
    """The grouping rule second by second."""
    firing, gone, told, active, last, out = set(), set(), set(), None, None, []
    changes = sorted(changes)
    first = changes[0][0] if changes else upto + 1
    pending = list(changes)
    for now in range(first, upto + 1):
        if active is None:
            if not pending or pending[0][0] > now:
                continue
            active = pending[0][0] + 10
        if now < active or (now - active) % 60:
            continue
        while pending and pending[0][0] <= now:
            _, instance, fires = pending.pop(0)
            if fires:
                firing.add(instance)
                gone.discard(instance)
            elif instance in firing:
                firing.discard(instance)
                gone.add(instance)
        resolved, gone = gone & told, set()
        if firing - told or resolved or (firing and last is not None and now - last >= repeat):
            out.append((now, sorted(firing), sorted(resolved)))
            told, last = set(firing), now
        if not firing:
            active, told, last = None, set(), None
    return out


def made_alerts(seed, hours=9):
    rng, t0 = random.Random(seed), int(BEGIN.timestamp())
    rows = []
    for name, severity in (("a", "critical"), ("b", "warning"), ("c", "warning"), ("a", "warning")):
        for _ in range(rng.randint(3, 40)):
            rows.append((name, severity, rng.choice("xyz"), rng.choice(["firing", "firing", "resolved"]), t0 + rng.randint(0, hours * 3600 if name != "b" else 900)))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_groups_settle_as_when_ticking(seed):
    t0 = int(BEGIN.timestamp())
    for repeat in (120, 3600):
        for name in "abc":
            changes = [(t, i, s == "firing") for n, _, i, s, t in made_alerts(seed, 3) if n == name]
            group = alerting.Group(coming=list(changes))
            assert list(group.settle(t0 + 5 * 3600, repeat)) == ticking(changes, t0 + 5 * 3600, repeat)


def test_notifications_of_a_stream_and_of_a_table(spark, tmp_path):
    schema = "alertname string, severity string, instance string, status string, ts timestamp"
    rows = [(*r[:4], datetime.fromtimestamp(r[4], UTC)) for r in made_alerts(7)]
    span = 9 * 3600 // 6 + 1
    batches = [[r for r in rows if int((r[4] - BEGIN).total_seconds()) // span == k] for k in range(6)]
    assert all(batches)
    end = BEGIN + timedelta(hours=14)
    batches[2].reverse()
    stream = stream_of(spark, [*batches, [("", "", None, "", end)]], schema, tmp_path)
    told = run_to_end(alerting.notifications(stream), str(tmp_path / "run"), schema=alerting.NOTIFICATION)
    plain = []
    for route in ("critical", "default"):
        for name in "abc":
            changes = [(int(t.timestamp()), i, s == "firing") for n, sev, i, s, t in rows if n == name and (sev == "critical") == (route == "critical")]
            plain += [(route, name, at, f, r) for at, f, r in ticking(changes, int(end.timestamp()), 3600 if route == "critical" else 14_400)]
    as_rows = lambda frame: sorted((r.route, r.alertname, r.told_at, r.firing, r.resolved) for r in frame.withColumn("told_at", F.unix_timestamp("told_at")).collect())
    assert as_rows(told) == sorted(plain)
    assert as_rows(alerting.settled(spark.createDataFrame(rows, schema), F.lit(end))) == sorted(plain)
    assert any(r[4] for r in plain) and any(not r[3] for r in plain)


def test_only_the_last_piece_of_an_answer_has_its_sources(spark):
    from quern.plans.flows import _in_pieces

    said = spark.createDataFrame([(4, "answered", "what is said " * 9, ["a", "b"], ["EMAIL"]), (5, "refused", "", [], [])], "query_id long, status string, whole string, sources array<string>, asked_entities array<string>")
    got = sorted(_in_pieces(said).collect(), key=lambda r: (r.request_id, r.seq))
    assert "".join(r.piece for r in got) == "what is said " * 9
    assert [(r.sources, r.entities) for r in got if r.is_last] == [(["a", "b"], ["EMAIL"]), ([], [])]
    assert all(r.sources is None and r.entities is None for r in got if not r.is_last)


def test_a_very_long_answer_is_cut_without_copies_of_it(spark):
    from quern.plans.flows import _in_pieces

    said = spark.createDataFrame([(5, "answered", "ab\ncé\U0001f600 " * 40_000, [], []), (6, "answered", None, [], [])], "query_id long, status string, whole string, sources array<string>, asked_entities array<string>")
    got = _in_pieces(said)
    assert "Generate posexplode(cut" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "whole" not in plan.split("Generate posexplode")[0]
    rows = sorted(got.collect(), key=lambda r: r.seq)
    assert "".join(r.piece for r in rows) == "ab\ncé\U0001f600 " * 40_000 and [r.seq for r in rows] == list(range(len(rows)))
    assert {len(r.piece) for r in rows} == set(range(1, 8)) and [r.is_last for r in rows].count(True) == 1


def test_text_without_digits_or_address_is_not_searched(monkeypatch):
    from quern.streaming import redaction

    assert [e for *_, e in redaction.found_spans("٠١٠١٢٣٤٥٦٧٨ a@b.co")] == ["EG_PHONE", "EMAIL"]
    monkeypatch.setattr(redaction, "_FINDERS", [("EMAIL", None)])
    assert redaction.found_spans("no such thing, as was said") == []
