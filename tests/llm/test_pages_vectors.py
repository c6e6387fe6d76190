"""WARC round trips, URL rules, nearest neighbours and the line model."""

import hashlib
import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest

from quern.llm import ann, common, line_crf, url_rules, warc
from quern.llm.queries import URL_RULES, op1_additive_ann, op6_line_crf


def test_archives_give_back_what_went_in(spark):
    big = "<p>" + "text " * 200
    rows = [(1, "http://a/", big), (2, "http://b/\nx", big), (3, None, big), (4, "u", "short"), (5, "v", "short"), (6, "w", None), (7, "x", ""), (None, "y", big + "!"), (None, "y", big), (8, "z", "é" * 50), (9, "z", "é" * 50), (1, "again", big)]
    rows += [(100 + i, f"http://s/{i}", f"<html>page {i} " + "common part of all pages " * 20) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest").repartition(3)
    listing, back = warc.archive_pages(spark, pages)
    got = back.collect()
    assert len(got) == len(rows) == sum(r.records for r in listing.collect())
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        refers = first.get(html) if page is not None and html in first and page > first[html] else None
        want.append((str(page), len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", str(refers)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    path = listing.first().path
    system, top = warc._files(path.rpartition("/")[0])
    with system.open_input_stream(f"{top}/{path.rpartition('/')[2]}", compression=None) as f:
        data = f.read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME and int.from_bytes(data[4:8], "little") > 0
    kinds = [r["warc-type"] for r in map(warc.parse_record, warc.read_frames(data))]
    assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"}


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_archives_of_text_ids_a_long_payload_and_few_records(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "ONE_TASK_ROWS", hot_rows)
    long = "".join(f"<p>{i}</p>" for i in range(700_000))
    rows = [("b>c d\n", "u", long), ("a", "v", "x" * 200), ("z", "w", "x" * 200), ("", "t", long), (None, None, "x" * 200)]
    listing, back = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id string, url string, html string"))
    got = {r.page_id: r for r in back.collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {"b>c d\n": ("revisit", ""), "a": ("response", None), "z": ("revisit", "a"), "": ("response", None), None: ("response", None)}
    assert got[""].payload_digest == hashlib.sha256(long.encode()).hexdigest() and got["b>c d\n"].payload_bytes == len(long)
    path = listing.first().path
    assert int.from_bytes(open(path.removeprefix("file:").replace("//", "/"), "rb").read(8)[4:], "little") > 0


def test_the_dictionary_samples_all_of_a_payload_and_copies_once(spark):
    rows = [(i, "u", "a" * 40_000 + f"<footer>{i}" + "the common end of all pages " * 900) for i in range(40)] + [(100 + i, "u", "copied") for i in range(40)]
    slices = warc.sampled_slices(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert len(slices) == 41 and slices.count("copied") == 1 and all(len(t) <= warc.SAMPLE_CHARS for t in slices)
    assert any("common end" in t for t in slices) and any(t.startswith("aaaa") for t in slices)
    assert warc.train_dictionary(spark.createDataFrame(rows[:1], "page_id long, url string, html string")) != b""
    assert warc.train_dictionary(spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")) == b""


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(spark, pages)[1].count() == 0
    assert url_rules.judge_urls(pages, URL_RULES).count() == 0


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:end], rest[end:]
        stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
        host, path = "".join(c.lower() if c.isascii() else c for c in host), tail[:stop]
    best = None
    for verdict, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules_and_mined_ones(spark):
    rng = random.Random(2)
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.COM/en/x", "http://www.example.com/en/", "http://notexample.com/en/", "x://com?a/b", "http://a.net/es/p#q", "http://net/fr/", "http://net", "a://b.org/x?y=1#z", "http://İ.com/", "q" * 5000 + "://com/" + "p" * 5000]
    urls += [f"http://shop{i % 7}.net/{rng.choice(['es', 'fr'])}/casino/{i}" for i in range(60)] + [f"https://news.com/story/{i}" for i in range(60)]
    urls += ["http://other.org/casino/77", "http://other.org/es/casino/5", "http://paper.org/story/4"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS verdict").repartition(3)
    got = {r.page_id: r for r in url_rules.judge_urls(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1] if best else None), u
        if best:
            assert got[i].verdict == best[0]
    n = len(urls)
    assert got[n - 3].verdict == "block" and got[n - 1].verdict == "allow" and got[1].verdict == "allow"


def plain_rules(rows, least_support, least_urls, least_confidence):
    """All token sets, counted one by one; (tokens, label) to confidence, of rules without a part as confident."""
    rows = [(frozenset(t), v) for t, v in rows if v is not None]
    least = max(least_urls, least_support * len(rows))
    every = {frozenset(c) for t, _ in rows for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    found = {}
    for s in every:
        labels = [v for t, v in rows if s <= t]
        for v in set(labels):
            if labels.count(v) >= least and labels.count(v) >= least_confidence * len(labels):
                found[s, v] = labels.count(v) / len(labels)
    return {k: c for k, c in found.items() if not any(o[1] == k[1] and o[0] < k[0] and d >= c for o, d in found.items())}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_and_matches_equal_plain_counting(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        tokens = rng.sample("abcdefg", rng.randint(0, 5))
        tokens += ["c2", "c3"] if "c" in tokens else []
        rows.append((tokens, rng.choice(["allow", "block", "block", None]) if rng.random() < 0.3 else "allow" if "a" in tokens and "b" in tokens else "block"))
    rows += [(["z", "a"], "allow")] * 6 + [([], "block"), (None, "allow")]
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string").repartition(3)
    rules = url_rules.mine_rules(frame, least_support=0.02, least_confidence=0.75)
    want = plain_rules([(t or [], v) for t, v in rows], 0.02, 5, 0.75)
    picked = {(frozenset(pick), r.label): r.confidence for r in rules for pick in itertools.product(*r.sets)}
    assert picked.keys() == want.keys() and all(abs(picked[k] - want[k]) < 1e-12 for k in want)
    asked = spark.createDataFrame([(rng.sample([*"abcdefgz", "c2", "c3", "new"], rng.randint(0, 6)),) for _ in range(200)] + [(None,)], "tokens array<string>")
    for r in url_rules.matched(asked, rules).collect():
        fits = [c for (s, _), c in want.items() if s <= set(r.tokens or ())]
        assert (r.mined_rule is None) == (not fits)
        if fits:
            first = next(x for x in rules if x.text() == r.mined_rule)
            assert first.confidence == max(fits) and r.mined_verdict == first.label
        else:
            assert r.mined_verdict == "allow"


def test_mining_of_a_long_repeated_url_ends(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(words, "block")] * 20 + [(words[:40], "block")] * 20
    rows += [(random.Random(i).sample(words, 3), "allow" if i % 3 else "block") for i in range(400)]
    began = time.perf_counter()
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert time.perf_counter() - began < 60
    got = url_rules.matched(spark.createDataFrame([(words,)], "tokens array<string>"), rules).first()
    assert got.mined_verdict == "block"


def test_items_are_left_out_only_beyond_the_bound():
    assert url_rules.items_read({8: 1000}, 5, 1 << 20) == 8
    assert url_rules.items_read({3: 10_000, 20: 4}, 50, 1 << 20) == 20
    assert url_rules.items_read({60: 20, 40: 20, 3: 400}, 5, 1 << 20) == 16
    assert url_rules.items_read({}, 5, 1 << 20) == 1


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_beyond_the_bound_rules_equal_plain_counting(spark, monkeypatch, block):
    monkeypatch.setattr(url_rules, "SET_BLOCK", block)
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        tokens = [*rng.sample("abcdefgh", rng.randint(0, 7))]
        tokens += ["c2"] if "c" in tokens else []
        hidden = {"a", "g", "h"} <= set(tokens) or {"b", "f"} <= set(tokens)
        rows.append((tokens, "block" if hidden != (rng.random() < 0.05) else rng.choice(["allow", "allow", "block", None])))
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string").repartition(3)
    rules = url_rules.mine_rules(frame, least_support=0.02, least_confidence=0.75, most_sets=8)
    want = plain_rules(rows, 0.02, 5, 0.75)
    picked = {(frozenset(pick), r.label): r.confidence for r in rules for pick in itertools.product(*r.sets)}
    assert max(len(k[0]) for k in want) >= 3
    assert picked.keys() == want.keys() and all(abs(picked[k] - want[k]) < 1e-12 for k in want)


def test_weak_items_of_long_urls_make_rules(spark):
    """Fourteen items, of which two together tell the label and each alone tells next to nothing."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        x, y = rng.random() < 0.5, rng.random() < 0.5
        noise = [f"n{j}" for j in range(12) if rng.random() < (0.7 if j < 6 or x != y else 0.6)]
        rows.append((noise + ["x"] * x + ["y"] * y, "block" if x and y else "allow" if x or y else rng.choice(["allow", "block"])))
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), least_support=0.05)
    assert url_rules.Rule(frozenset([frozenset("x"), frozenset("y")]), "block", 1.0, 0) in [url_rules.Rule(r.sets, r.label, r.confidence, 0) for r in rules]


def test_no_pages_are_judged(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.judge_urls(pages, URL_RULES).count() == 0


def test_few_labelled_urls_teach_nothing(spark):
    frame = spark.createDataFrame([(["a"], "block")] * 4, "tokens array<string>, verdict string")
    assert url_rules.mine_rules(frame) == [] and url_rules.mine_rules(frame.limit(0)) == []
    assert [r.label for r in url_rules.mine_rules(frame.union(frame))] == ["block"]


def test_nearest_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    x[200:500] = x[150]  # a common vector
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [float("inf")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (None, [1.0] * 16), (3, rows[3][1]), (2050, [1.0] * 15), (2100, [1.0] * 17), (2005, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS v", "2 AS rank").repartition(4)
    got = ann.nearest(vectors, lambda v: v % 50 == 0, rerank=60).collect()
    m = np.array([np.float32(r[1]) for r in rows[:1500]], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 1500, 50):
        s = m @ m[q]
        order = [int(i) for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r[2] - s[r[1]]) < 1e-12 for r in mine)
        hit, total = hit + len({r[1] for r in mine} & set(order)), total + 5
        if q in range(200, 500):
            assert [r[1] for r in mine] == order
    assert {r.query_id for r in got} == set(range(0, 1500, 50))
    assert hit / total >= 0.9


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_recall_where_the_rerank_list_is_a_small_share(spark, monkeypatch, broadcast):
    """20,000 vectors of 32 dimensions in loose clusters; 300 are ranked again: 1.5 %."""
    monkeypatch.setattr(ann, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(50, 32))[rng.integers(0, 50, 20_000)] + 0.7 * rng.normal(size=(20_000, 32))).astype(np.float32)
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(vectors, lambda v: v % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    m = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 20_000, 50):
        s = m @ m[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 400 and hit / 2000 >= 0.9


def test_recall_within_a_tight_cluster(spark):
    """Half of the vectors differ by a thousandth only, so the list must grow to hold their neighbours."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=16) + 0.001 * rng.normal(size=(2000, 16)), rng.normal(size=(2000, 16))])
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(4000), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors, lambda v: v % 50 == 0, rerank=20).collect():
        got.setdefault(r.query_id, []).append(r.score)
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = {True: 0, False: 0}
    for q in range(0, 4000, 50):
        s = np.delete(m @ m[q], q)
        hit[q < 2000] += sum(v >= np.sort(s)[-5] - 1e-12 for v in got[q])
    assert hit[True] >= 180 and hit[False] >= 180


def test_recall_of_a_few_queries_in_a_tight_group(spark):
    """One query of a hundred lies in a group longer than the list; the queries tried miss it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 32))
    group = np.setdiff1d(np.arange(700), np.arange(50, 700, 50))[:400]
    x[group] = x[0] + 1e-3 * rng.normal(size=(400, 32))
    found = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), lambda c: c % 50 == 0, rerank=60).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    missed = []
    for q in range(0, 5000, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        mine = sorted(r.score for r in found if r.query_id == q)
        missed += [q] * int((np.array(mine) < np.sort(scores)[-5] - 1e-12).sum())
    assert 0 not in missed and len(missed) <= 5


def test_no_cosine_exceeds_its_bound():
    rng = np.random.default_rng(6)
    x, q = (ann._unit(rng.normal(size=(n, 8))) for n in (2000, 20))
    code = ann._unit(x + 0.2 * rng.normal(size=x.shape))
    error = np.sqrt(1 - (x * code).sum(1) ** 2)
    for vector in np.vstack([q, x[:20]]):
        assert (ann.at_most((code @ vector).astype(np.float32), error.astype(np.float32), 1.0) >= x @ vector).all()


def test_candidates_needed_equals_a_plain_count(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.fit_codebooks(u, 3, 16)
    index = ann.build_index(rows, model)
    y = model.decode(model.encode(u))
    about = u @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    want = []
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -2
        want += [int((about[q] >= about[q][i] - 1e-6).sum()) for i in np.argsort(-s)[:5]]
    for share in (0.5, 0.98, 1.0):
        got, _ = ann.candidates_needed(rows, index, rows.filter("id % 50 = 0"), model, 5, share=share)
        assert abs(got - np.quantile(want, share)) <= 2
    assert ann.candidates_needed(rows.limit(1), index, rows.limit(1), model, 5) == (0, 1)


def test_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind), lambda v: v % 50 == 0).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], kind), lambda v: v % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 1)]


def test_every_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(14)
    sizes = [8] * 400 + [5] * 360 + [3] * 40 + [1] * 3 + [7]
    rows = [(i, rng.normal(size=d).tolist()) for i, d in enumerate(sizes)]
    rng.shuffle(sizes)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(vectors, lambda v: v % 10 == 0, few=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, len(rows), 10):
        v = np.array(rows[q][1])
        cos = sorted(((-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, w in ((i, np.array(w)) for i, w in rows) if i != q and len(w) == len(v)))[:5]
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(cos) + 1))
        hit, total = hit + len({m[1] for m in mine} & {i for _, i in cos}), total + len(cos)
        if len(v) < 5:
            assert np.allclose([m[2] for m in mine], [-c for c, _ in cos])
    assert hit / total > 0.97


def test_parallel_vectors_find_each_other(spark):
    """800 parallel vectors have one code: any five of them are a right answer to one of them."""
    rng = np.random.default_rng(15)
    x = np.concatenate([np.outer(rng.uniform(1, 9, 800), rng.normal(size=12)), rng.normal(size=(900, 12))])
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(1700), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<double>")
    runs = [sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(vectors.repartition(n), lambda v: v % 50 == 0, rerank=40).filter("score > 1 - 1e-12").collect()) for n in (2, 5)]
    assert {q for q, *_ in runs[0]} == set(range(0, 800, 50)) and len(runs[0]) == 16 * 5
    assert [r[:2] for r in runs[0]] == [r[:2] for r in runs[1]]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_driver_vectors(spark, sf):
    d = f"/root/testdata/sf{sf}"
    got = op1_additive_ann(spark, d).collect()
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -2
        best = set(ids[np.argsort(-s)[:5]])
        hit, total = hit + len(best & {r.vec_id for r in got if r.query_id == q}), total + 5
    assert hit / total >= 0.9


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=6), rng.normal(size=(2, 2))
    p, z = np.zeros(6), 0.0
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        w = np.exp(sum(e * b for e, b in zip(emit, y, strict=True)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        z, p = z + w, p + w * np.array(y)
    assert np.allclose(line_crf.marginals(emit, move), p / z)


def plain_likelihood(x, sizes, y, weight, w, move):
    """The weighted log likelihood, one chain and one line at a time."""
    total, at = 0.0, 0
    for n, label, share in zip(sizes, y, weight, strict=True):
        emit = x[at : at + n] @ w
        sums = np.array([0.0, emit[0]])
        held = label * emit.sum() + (n - 1) * move[label, label]
        for e in emit[1:]:
            sums = np.array([np.logaddexp(sums[0] + move[0, b], sums[1] + move[1, b]) + b * e for b in (0, 1)])
        total += share * (held - np.logaddexp(*sums))
        at += n
    return total


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_slopes_of_the_line_model_equal_differences(stretch):
    """Chains shorter and longer than a stretch, one of them of many stretches."""
    rng = np.random.default_rng(3)
    sizes = np.array([5, 1, 64, 7, 200, 3, 64, 6])
    chains = line_crf.Chains.of(sizes, stretch)
    x, y, weight = rng.normal(size=(sizes.sum(), 4)), rng.integers(0, 2, len(sizes)), rng.random(len(sizes))
    w, move = rng.normal(size=4), rng.normal(size=(2, 2))
    value, by_w, by_move = line_crf.slopes(chains, x[chains.order], y, weight, w, move)
    plain = lambda w, move: plain_likelihood(x, sizes, y, weight, w, move)
    assert abs(value - plain(w, move)) < 1e-8
    for i in range(4):
        d = np.eye(4)[i] * 1e-5
        assert abs(by_w[i] - (plain(w + d, move) - plain(w - d, move)) / 2e-5) < 1e-4
    for i in range(4):
        d = np.eye(4)[i].reshape(2, 2) * 1e-5
        assert abs(by_move.flat[i] - (plain(w, move + d) - plain(w, move - d)) / 2e-5) < 1e-4
    ahead, back, total = chains.sums(x[chains.order] @ w, move)
    assert np.allclose(np.logaddexp(*(ahead + back).T), total[chains.chain])


def test_scores_are_length_weighted_marginals(spark):
    """The whole of a very long text is scored, as line by line."""
    docs = spark.createDataFrame([(i, f"good line number {i} of a text.\nand another one." if i % 2 else "## $$ !!\n** %%") for i in range(40)], "doc_id long, text string")
    model = line_crf.train_on(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS label"))
    text = "\n".join(["a good line of a text."] * 3000 + ["## $$ !!"] * 9000)
    features, lengths = line_crf.document_matrix(text)
    emit = ((features - model.mean) / model.scale) @ model.weights
    ahead, back, total = line_crf.Chains.of(np.array([12_000])).sums(emit, model.move)
    p = np.exp(ahead[:, 1] + back[:, 1] - total[0])
    share = np.clip((p * (lengths + 1)).sum() / (lengths + 1).sum(), 1e-6, 1 - 1e-6)
    want = 1 / (1 + np.exp(-np.clip(model.slope * np.log(share / (1 - share)) + model.offset, -40, 40)))
    assert abs(model.score(text) - want) < 1e-6
    tied = line_crf.score_documents(docs.limit(6).union(docs.limit(6)), model).collect()
    assert all(len({r.score for r in tied if r.doc_id == i}) == 1 for i in {r.doc_id for r in tied})
    assert all((r.predicted == 1) == (r.score >= 0.3) == (r.doc_id % 2 == 1) for r in tied)


def test_the_sample_ends_with_its_load(spark, monkeypatch):
    """Long texts are sampled like others; repeated rows teach once."""
    seen = []
    monkeypatch.setattr(line_crf, "fit", lambda texts, labels: seen.append((texts, labels)))
    docs = spark.createDataFrame([(i, "x" * 2_000_000 if i < 3 else "y\n" * 50) for i in range(30)] * 2, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS label")
    line_crf.train_on(docs, labels)
    line_crf.train_on(docs, labels, load=20_000)
    line_crf.train_on(docs, labels, documents=4)
    assert len(seen[0][0]) == 30 and sum(len(t) > 1000 for t in seen[0][0]) == 3
    loads = [len(t) + line_crf.LINE_LOAD * (1 + t.count("\n")) for t in seen[1][0]]
    assert 1 <= len(loads) < 30 and sum(loads[:-1]) < 20_000 and seen[1][0] == seen[0][0][: len(loads)]
    assert len(seen[2][0]) == 4


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    scored = op6_line_crf(spark, d)
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("held-out AUC", auc, "accuracy", np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]))
    assert auc >= 0.8


def test_scores_of_nulls_ties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a b\n" * 3000), (None, "x")], "doc_id long, text string").selectExpr("*", "5 AS score")
    labels = spark.createDataFrame([], "doc_id long, label int")
    out = line_crf.score_documents(docs, line_crf.train_on(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out}) == 1
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (9, None)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in line_crf.score_documents(docs, line_crf.train_on(docs, labels)).collect())
