"""The hidden Markov language model against plain recursions and counts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import hmm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, learn string, symbols int, row long, word string"


def model_of(symbols, states, seed=3):
    rng = np.random.default_rng(seed)
    emits = rng.gamma(1.0, 1.0, (symbols, states))
    moves = rng.gamma(1.0, 1.0, (states, states))
    start = rng.gamma(1.0, 1.0, states)
    return hmm.Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def by_paths(text, model):
    """Probability and expected counts by going through all sequences of states."""
    states = len(model.start)
    start, moves, emits, total = np.zeros_like(model.start), np.zeros_like(model.moves), np.zeros_like(model.emits), 0.0
    for path in itertools.product(range(states), repeat=len(text)):
        p = model.start[path[0]] * math.prod(model.emits[x, s] for x, s in zip(text, path, strict=True)) * math.prod(model.moves[a, b] for a, b in itertools.pairwise(path))
        total += p
        start[path[0]] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
        for x, s in zip(text, path, strict=True):
            emits[x, s] += p
    return start / total, moves / total, emits / total, math.log10(total)


@pytest.mark.parametrize(("stretch", "held"), [(4096, 1 << 20), (3, 1 << 20), (1, 12), (2, 5)])
def test_counts_and_probabilities_are_those_of_all_paths(monkeypatch, stretch, held):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "HELD", held)
    rng, model = random.Random(1), model_of(5, 3)
    texts = [np.array(rng.choices(range(5), k=n), dtype="<u2") for n in (1, 2, 3, 4, 5, 6, 7, 7, 1, 8)]
    plain = [by_paths(t, model) for t in texts]
    assert np.allclose(hmm.log_probabilities(texts, model), [p[3] for p in plain])
    got = hmm.expected_counts(texts, model)
    for i in range(3):
        assert np.allclose(got[i], sum(p[i] for p in plain))
    assert math.isclose(got[3], sum(p[3] for p in plain))


def test_a_very_long_text_is_scored_exactly(monkeypatch):
    model, text = model_of(40, 4), np.random.default_rng(2).integers(0, 40, 30_000).astype("<u2")
    once = hmm.log_probabilities([text[:5]] * 3 + [text], model)[3]
    monkeypatch.setattr(hmm, "STRETCH", 30_000)
    assert math.isclose(once, hmm.log_probabilities([text], model)[0], rel_tol=1e-12)


def test_words_and_classes():
    texts = pa.array([" Foo\x0b\x0cÉa b  x\x1cy ", None, "", " \n", "\x85"])
    words, owner = hmm.words_of(texts)
    plain = [(w.translate(LOWER), i) for i, t in enumerate(texts.to_pylist()) for w in WORD.findall(t or "")]
    assert list(zip(words.to_pylist(), owner.tolist(), strict=True)) == plain
    classes = hmm.word_class(pa.array(["a", "xa", "longerxa", "é", "zé", "b"]))
    assert classes[1] == classes[2] and len({*classes[[0, 1, 3, 5]]}) == 4 and classes[3] == classes[4]


def corpus(n=300, seed=5):
    """Texts of two tongues that never mix, with rare words, nulls and repeats."""
    rng = random.Random(seed)
    tongues = [[f"{t}{i}" for i in range(30)] for t in ("a", "b")]
    texts = [None, "", " \t", "Only É", "A0 " * 9000]
    for i in range(n):
        words = rng.choices(rng.choice(tongues), weights=[30 // (k + 1) + 1 for k in range(30)], k=rng.randint(1, 40))
        texts.append(" ".join(words) + rng.choice(["", f" rare{i}", f" rare{i % 7}", " RARE"]))
    rows = [(i, t, "no", 1, 2, "w") for i, t in enumerate(texts)]
    return rows + rows[10:20] + [(None, texts[9], "no", 1, 2, "w")]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def scored(docs, **kinds):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return hmm.score_texts(docs, learn=~held, **kinds)


def test_base_columns_and_what_is_learned(spark):
    rows = corpus()
    tokens = [[w.translate(LOWER) for w in WORD.findall(t or "")] + [None] for _, t, *_ in rows]
    c = Counter(w for (i, *_), ws in zip(rows, tokens, strict=True) if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    plain = sorted((i or -1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, *_), ws in zip(rows, tokens, strict=True))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    first = scored(docs, broadcast_words=12, own_symbols=8).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in first) == plain
    assert all(r.learned != held_out(r.doc_id) for r in first)
    # which words are broadcast changes nothing
    again = {(r.doc_id, r.n_tokens): r.score for r in scored(docs, broadcast_words=10**6, own_symbols=8).collect()}
    assert all(math.isclose(r.score, again[r.doc_id, r.n_tokens], rel_tol=1e-3) for r in first)
    # the tongues are told apart, so texts not learned from are likelier than word by word
    full = [r for r in scored(docs).collect() if not r.learned and r.n_tokens > 20]
    assert len(full) > 5 and sum(r.score for r in full) > sum(r.base_score for r in full) + 0.15 * sum(r.n_tokens for r in full)


def test_words_and_classes_share_all_probability(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, SCHEMA).select("text")
    counts = hmm.count_words(docs).persist()
    known, least = hmm.build_vocabulary(counts, len(rows), 20, 10)
    assert 10 <= len(known.words) <= 20 and known.symbols == 1 + 10 + hmm.CLASSES and math.isclose(known.shares.sum(), 1)
    words = {r.word: r.n for r in counts.collect()}
    own = set(known.words[: known.own].to_pylist())
    others = [w for w in words if w not in own]
    sums = np.full(hmm.CLASSES, 0.1)
    np.add.at(sums, hmm.word_class(pa.array(others)), [words[w] + 0.1 for w in others])
    assert np.allclose(np.log10(sums), known.class_logs)
    assert least > min(words.values()) and min(words[w] for w in known.words.to_pylist()) >= least


def test_rounds_never_make_the_corpus_less_likely(spark):
    texts = [np.array([*np.random.default_rng(i).integers(1 + 5 * (i % 2), 6 + 5 * (i % 2), 12), 0], dtype="<u2") for i in range(80)]
    model, shares, last = hmm.first_model(np.full(12, 1 / 12), 3), np.full(12, 1 / 12), -math.inf
    rows = spark.createDataFrame([(t.tobytes(),) for t in texts], "symbols binary").repartition(3)
    for _ in range(6):
        now = hmm.log_probabilities(texts, model).sum()
        assert now > last - 0.5  # the priors may cost a little
        last, model = now, hmm.learn_round(rows, model, shares)
    assert last > hmm.log_probabilities(texts, hmm.first_model(shares, 3)).sum() + 50


def test_nothing_to_learn_from_and_nothing_at_all(spark):
    docs = spark.createDataFrame([(1, "some words", "x", 1, 1, "w"), (2, None, "x", 1, 1, "w")], SCHEMA)
    got = {r.doc_id: r for r in hmm.score_texts(docs, learn=F.lit(None).cast("boolean")).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens) == (3, 0, 0) and abs(got[1].base_score) < 1e-9
    assert got[2].n_tokens == 1 and math.isfinite(got[2].score) and got[2].score < 0
    assert hmm.score_texts(spark.createDataFrame([], SCHEMA), learn=F.lit(True)).count() == 0


def test_slices_of_a_batch_have_the_words_of_their_rows():
    texts = [f"A{i} b{i}\tc{i}" for i in range(9)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    for part in hmm._slices(iter([batch]), 20):
        words, owner = hmm.words_of(part["text"])
        want = [w for t in part["text"].to_pylist() for w in t.lower().split()]
        assert words.to_pylist() == want and owner.tolist() == [i for i in range(len(part)) for _ in range(3)]


def test_every_round_goes_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hmm, "GATHERED", 3000)
    rng, n = np.random.default_rng(8), 5000
    texts = [rng.integers(0, 6, rng.integers(1, 6)).astype("<u2") for _ in range(n)]
    learned = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "row long, symbols binary").repartition(2)
    shares = np.full(6, 1 / 6)
    want = hmm.first_model(shares, 2)
    for _ in range(hmm.ROUNDS):
        want = hmm.improved(*hmm.expected_counts(texts, want)[:3], shares)
    got = hmm.train(learned, n, shares, states=2)
    assert all(np.allclose(a, b, rtol=0, atol=1e-6) for a, b in ((got.start, want.start), (got.moves, want.moves), (got.emits, want.emits)))


def test_rare_symbols_in_a_row_do_not_vanish():
    model = hmm.Model(np.array([1 - 1e-12, 1e-12]), np.array([[1 - 1e-9, 1e-9], [1e-9, 1 - 1e-9]]), np.array([[1 - 1e-14, 1e-14], [1e-14, 1 - 1e-14]]))
    text = np.array([0, 1] * 3, dtype="<u2")
    plain = by_paths(text, model)
    got = hmm.expected_counts([text] * 2, model)
    assert all(np.allclose(a, 2 * b) for a, b in zip(got[:3], plain[:3], strict=True))
    assert math.isclose(got[3], 2 * plain[3])
    now, logs = model.start, 0.0
    for x in np.tile(text, 500):
        seen = now * model.emits[x]
        now, logs = seen / seen.sum() @ model.moves, logs + math.log10(seen.sum())
    assert math.isclose(hmm.log_probabilities([np.tile(text, 500)], model)[0], logs, rel_tol=1e-12)
