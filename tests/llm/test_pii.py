import hashlib
import random
import re

import pytest

from quern.llm import common, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out, text = [], text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    fine = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in pattern.finditer(text) if fine[kind](m)]
    return ",".join(out)


def texts():
    rng = random.Random(3)
    bits = ["a@b.c", "x.y@mail.example.com", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0000", "+49 30 1", " ", "\n", "é", "😀", "@", "..", "a@b@c.d", "x@y.z%u@v.w", "0000000000000001.2.3.4", "9" * 40, "-", "+", "word", "12 34", "5"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    return [None, "", "9" * 30_000, "ab" * 50_000 + "@x.y", *made]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digest(pii.personal_data(docs)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text or "")[:200]
        assert set(filter(None, want.split(","))) <= set(filter(None, got[i].spans.split(",")))
        assert got[i].n_email == want.count("email:")


def test_confident_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Note {i}. Call phone: +1 (415) 555-{1000 + i} today") for i in range(20)]
    rows += [(100, "Note. Call phone: 415-555-9999 today"), (101, "Order 1234567 was sent"), (102, "phone: 415 555 9998 x"), (103, "Call phone: 415-555-9999 today"), (None, "phone: 415 555 9997 y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans")
    got = {r.doc_id: r for r in pii.span_digest(pii.personal_data(docs)).collect()}
    assert len(got) == len(rows)
    assert got[100].spans == "phone:18:30" and got[100].n_phone == 0
    assert got[102].spans == "phone:7:19" and got[103].spans == "phone:12:24"
    assert got[101].spans == ""
    assert got[None].spans == "phone:7:19"


def test_identifiers_found_in_a_round_admit_further_patterns(spark):
    """Pattern b has three seeds and many that pattern a finds; one stands only in b."""
    seen = [(f"s{i}", "phone", "a") for i in range(60)] + [(f"f{i}", None, p) for i in range(12) for p in "ab"]
    seen += [(f"t{i}", "phone", "b") for i in range(3)] + [("only", None, "b")]
    frame = spark.createDataFrame([(*s, ["phone"]) for s in seen], "key string, kind string, pattern string, may array<string>")
    got = {r.key: r.kind for r in pii.discover(frame, least_confidence=0.7).collect()}
    assert got == {f"f{i}": "phone" for i in range(12)} | {"only": "phone"}


def plain_discovery(seen, rounds, least_known, least_confidence):
    """The scores of patterns and identifiers, one edge at a time."""
    edges = {}
    for key, kind, pattern, may in seen:
        old = edges.get((pattern, key), (None, set()))
        edges[pattern, key] = (max(filter(None, (old[0], kind)), default=None), old[1] | set(may))
    held = {}
    for pattern, _ in edges:
        held[pattern] = held.get(pattern, 0) + 1
    graph = {e: v for e, v in edges.items() if held[e[0]] >= least_known}
    known = {}
    for (_, key), (kind, _) in graph.items():
        if kind:
            known[key] = max(known.get(key, ""), kind)
    found = {}
    for _ in range(rounds):
        pool = {k: v for k, v in found.items() if k not in known} | {k: (kind, 1.0) for k, kind in known.items()}
        mass = {}
        for pattern, key in graph:
            if key in pool:
                kind, score = pool[key]
                mass[pattern, kind] = mass.get((pattern, kind), 0) + score
        trust = {}
        for (pattern, kind), m in mass.items():
            against = sum(v for (p, _), v in mass.items() if p == pattern) + 1
            against += sum(pii.UNKNOWN if kind in may else 1 for (p, key), (_, may) in graph.items() if p == pattern and key not in pool)
            if m >= least_known and m / against >= least_confidence:
                trust[pattern, kind] = m / against
        doubt = {}
        for (pattern, key), (kind, may) in graph.items():
            for (p, k), t in trust.items():
                if kind is None and p == pattern and k in may:
                    doubt[key, k] = doubt.get((key, k), 1.0) * (1 - t)
        found = {}
        for (key, kind), d in doubt.items():
            if (1 - d, kind) > (found[key][1], found[key][0]) if key in found else True:
                found[key] = (kind, 1 - d)
        found = {k: v for k, v in found.items() if v[1] >= least_confidence}
    return {k: v[0] for k, v in found.items()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_discovery_equals_plain_scoring(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10 if seed % 2 else 1000)
    monkeypatch.setattr(common, "ONE_TASK_ROWS", 10 if seed % 2 else 1000)
    rng = random.Random(seed)
    seen = []
    for _ in range(600):
        pattern = rng.choice("aaabcdefgh")
        kind = {"a": "phone", "b": "phone", "c": "card", "d": "email"}.get(pattern, rng.choice(["phone", "card", "ip"]))
        key = f"{kind}{rng.randint(0, 40)}" if rng.random() < 0.9 else f"x{rng.randint(0, 5)}"
        seen.append((key, kind if rng.random() < 0.75 else None, pattern, [kind] if rng.random() < 0.8 else ["phone", "card"]))
    frame = spark.createDataFrame(seen, "key string, kind string, pattern string, may array<string>")
    for known, confidence in ((4, 0.8), (3, 0.6)):
        got = {r.key: r.kind for r in pii.discover(frame, least_known=known, least_confidence=confidence).collect()}
        assert got == plain_discovery(seen, pii.ROUNDS, known, confidence)


@pytest.mark.parametrize("with_seed", [(0,), (0, 3, 4)])
def test_planted_identifiers_are_found_among_the_driver_documents(spark, with_seed):
    """Unseen forms planted in whole documents of a table, with one seed or three to each: all
    are found, nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    plain = {r.doc_id: r.spans for r in pii.span_digest(pii.personal_data(spark.createDataFrame(docs))).collect()}
    rng, rows, want = random.Random(8), [], {}
    for r in docs:
        i, text, n = r.doc_id, r.text or "", rng.randrange(10**6)
        seeds = [f"Reach us by phone: +1 415 {n:07d} today", f"Send mail to: user{n}@mail.example.org soon", f"Server address = 10.{n % 250}.{n // 250 % 250}.7 up"]
        unseen = [("phone", f"415 {n:07d}", "Reach us by phone: {} today"), ("email", f"user{n} (at) mail [dot] org", "Send mail to: {} soon"), ("ip", f"10[.]{n % 250}[.]{100 + n % 99}[.]7", "Server address = {} up")]
        other = [f"Order number: {n:09d} was sent", f"Build 2024 {n:06d} passed on", f"Part no. {n:08d}"]
        extra = ""
        if i % 8 in with_seed:
            extra = "\n" + seeds[i // 8 % 3]
        elif i % 8 == 1:
            kind, value, frame = unseen[i // 8 % 3]
            extra = "\n" + frame.format(value)
            start = len(text) + len(extra) - len(frame.format(value)) + frame.index("{")
            want[i] = f"{kind}:{start}:{start + len(value)}"
        elif i % 8 == 2:
            extra = "\n" + other[i // 8 % 3]
        rows.append((i, text + extra))
    got = {r.doc_id: r for r in pii.span_digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    base = {r.doc_id: brute(dict(rows)[r.doc_id]) for r in docs}
    added = {i: set(filter(None, r.spans.split(","))) - set(filter(None, base[i].split(","))) for i, r in got.items()}
    right = sum(len(added[i] & {w}) for i, w in want.items())
    print("planted", len(want), "found", right, "added in all", sum(map(len, added.values())), "without planting", sum(plain[i] != brute(t) for i, t in docs))
    assert len(want) > 100 and right == len(want)
    assert sum(map(len, added.values())) == right


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(docs).count() == 0
