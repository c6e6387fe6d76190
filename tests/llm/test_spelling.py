"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from quern.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, word string, n int, key string, form int"


def words_of(rows, damage):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(rows, damage=31):
    n = words_of(rows, damage)
    beside = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and near(w, v)] for w in n}
    form = {}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(beside[w]), n.get(form[w])))
    return out


def found(docs, **kinds):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, **kinds).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(seed, letters, n_words, lengths):
    """Words of few letters and their edits, so that bigrams repeat and pairs abound."""
    rng = random.Random(seed)
    bases = ["".join(rng.choices(letters, k=rng.randint(*lengths))) for _ in range(n_words)]
    made = []
    for base in bases:
        made += [base] * rng.choice([1, 2, 30, 400])
        for _ in range(rng.randint(0, 6)):
            at, kind = rng.randint(0, len(base)), rng.choice("idr")
            c = rng.choice(letters)
            made += [base[:at] + (c if kind != "d" else "") + base[at + (kind != "i") :]] * rng.choice([1, 2, 2, 3, 25])
    rng.shuffle(made)
    return [(i, " ".join(made[s : s + 40]), "x", 1, "k", 2) for i, s in enumerate(range(0, len(made), 40))]


@pytest.mark.parametrize(("letters", "lengths", "damage"), [("ab", (7, 12), 31), ("abé", (7, 9), 3), ("abcdefghijklmnopqrstuvwxyzàÿÉ×", (7, 16), 31), ("aab÷", (8, 30), 3)])
def test_all_near_words_are_found(spark, letters, lengths, damage):
    rows = texts(len(letters), letters, 60, lengths)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, damage=damage) == plain(rows, damage)


def test_edges(spark):
    long_run = "Abcdefg" * 20_000
    rows = [
        (1, None, "", 1, "", 1), (2, "", "", 1, "", 1), (3, " \n", "", 1, "", 1), (None, "Colours coloUrs colours", "", 1, "", 1), (None, "Colours coloUrs colours", "", 1, "", 1),
        (4, long_run + " " + long_run, "", 1, "", 1), (5, "x" + long_run + "-" + "x" + long_run, "", 1, "", 1), (6, "sevenll sevenlk " * 2, "", 1, "", 1), (6, "sevenll sevenlk " * 2, "", 1, "", 1),
        (7, "shorts " * 9 + "ÀÉÎÕÜàé àéîõüàé " * 3, "", 1, "", 1),
    ]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaaaab" + "c" * i for i in range(5)]
    rows = [(i, " ".join([w] * 2 * 10**i), "", 1, "", 1) for i, w in enumerate(chain)] + [(99, "zzzzzzzz " * 3, "", 1, "", 1)]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, SCHEMA), damage=10**10)}
    assert got == {r[0]: r for r in plain(rows, 10**10)}
    assert got[chain[0]][2] == chain[-1] and got["zzzzzzzz"][1:3] == (None, "zzzzzzzz")
