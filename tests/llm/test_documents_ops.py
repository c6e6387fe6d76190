"""Mixing, packing, line dedup, quality rules and the n-gram join against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import common, line_dedup, mixing, ngram_join, packing, quality_rules
from quern.llm.common import components
from quern.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, comp long, key string, n int"


def corpus(seed=1):
    """Documents with nulls, blanks, ties, repeated rows, shared lines, copies and a long one."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "A,", "#x", "|", "ABCDEFGHIJ"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(25)]
    texts = [None, "", " \n\t", "one two", "One TWO", "a b c d e", "x" * 50_000, "\n".join(rng.choices(lines, k=400))]
    for _ in range(60):
        texts.append("\n".join(rng.choices(lines, k=rng.randint(1, 6))))
    base = rng.choices(vocabulary, k=80)
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"v{i}"
        texts.append(" ".join(copy))
    rows = [(i, t, "en", rng.choice([None, "a", "b", "c"]), len(t or ""), 1, "k", 2, "z", 3) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[1]] + [(None, texts[30], "en", "a", 1, 1, "k", 2, "z", 3), (None, " ".join([*base[:70], "near"]), "en", "b", 1, 1, "k", 2, "z", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_comes_near_its_targets(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text or ""))
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in rows)
    names = sorted((s for s in by if s is not None)) + [None]
    share, weights = {}, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, free = float(total), set(names)
    while True:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 3 * sum(r["size"] for r in by[s])}
        if not full:
            break
        for s in full:
            share[s] = 3.0 * sum(r["size"] for r in by[s])
            left -= share[s]
        free -= full
    share |= {s: level * weights[s] for s in free}
    for s in names:
        assert by[s][0].target == pytest.approx(share[s])
        assert abs(sum(r.taken for r in by[s]) - share[s]) <= max(r["size"] for r in by[s])
    again = {(r.doc_id, r.text): r.taken for r in mixing.mix_sources(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.text): r.taken for r in rows}
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_prefix_sums_over_ranges(spark):
    rows = [(None if i == 7 else f"s{i * 37 % 101:03d}", float(i % 9)) for i in range(100)]
    frame = spark.createDataFrame(rows, "source string, limit double").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = mixing.prefixed(frame, [F.col("source").asc_nulls_last()], "limit").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    at, total = 0, 0.0
    for r in sorted(got, key=lambda r: (r.source is None, r.source or "")):
        assert (r.before, r.before_limit) == (at, total)
        at, total = at + 1, total + r.limit


@pytest.mark.parametrize("hot_rows", [1, 5, 1000])
def test_line_dedup_equals_brute_force(spark, docs, hot_rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "ONE_TASK_ROWS", hot_rows)

    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({i: i + 32 for i in range(65, 91)})

    holders = {}
    for row in corpus():
        if row[0] is not None:
            for line in (row[1] or "").split("\n"):
                holders.setdefault(key(line), set()).add(row[0])
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        lines = (r.text or "").split("\n")
        gone = [r.doc_id is not None and len(key(x)) >= 10 and len(holders[key(x)]) > 1 and r.doc_id > min(holders[key(x)]) for x in lines]
        assert (r.n_lines, r.n_dropped) == (len(lines), sum(gone))
        assert r.kept_text == "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_of_three_documents_and_clashing_columns(spark):
    rows = [(3, "twice held line\nthrice held line"), (1, "thrice held line"), (2, "Thrice held line \ntwice held line"), (2, "thrice held line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_lines", "8 AS n_dropped", "'x' AS kept_text")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs, min_docs=3).collect())
    assert got == [(1, 1, 0, "thrice held line"), (2, 1, 1, ""), (2, 2, 1, "twice held line"), (3, 2, 1, "twice held line")]


@pytest.mark.parametrize("hot_rows", [1, 4, 1000])
def test_hot_join_is_a_left_join(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "ONE_TASK_ROWS", hot_rows)
    big = spark.createDataFrame([(i, None if i % 11 == 0 else i % 7 % 4, i % 2) for i in range(200)], "id int, a int, b int")
    small = spark.createDataFrame([(a, b, a * 10 + b, 200 if a == 1 else 2) for a in range(3) for b in range(2)], "a int, b int, v int, n int")
    got = sorted(common.hot_join(big, small, ["a", "b"], "n", 450, ["id"]).select("id", F.coalesce("v", F.lit(-1)).alias("v")).collect())
    want = sorted(big.join(small, ["a", "b"], "left").select("id", F.coalesce("v", F.lit(-1)).alias("v")).collect())
    assert got == want


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), math.inf), r[0])
    return sorted(((r[0] is None, r[0] or 0), len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = ngram_join.near_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_ngram_join_counts_every_row_beside_many_copies(spark):
    """Near pairs that share their n-grams with nobody else, 16,000 copies, and an id held twice."""
    rng = random.Random(7)
    rows = [(i, "the same text in every one of these rows") for i in range(16_000)]
    for i in range(16_000, 19_000, 2):
        words = [f"{rng.getrandbits(48):x}" for _ in range(60)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:-1], "end"]))]
    words = [f"{rng.getrandbits(48):x}" for _ in range(24)]
    rows += [(3, " ".join(words)), (20_000, " ".join([*words, "end"]))]
    got = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    comp = {r.doc_id: r.component_id for r in got if r.doc_id > 3}
    lost = [i for i in range(16_000, 19_000, 2) if comp[i] != i or comp[i + 1] != i]
    assert lost == [] and comp[20_000] == 3


def test_ngram_join_of_ten_thousand_documents(spark, monkeypatch):
    """Clusters of near copies at all distances and a passage of many documents, hot keys
    joined as such, against an inverted index that counts every pair."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "ONE_TASK_ROWS", 20)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts = []
    while len(texts) < 10_000:
        base = [word() for _ in range(rng.randint(3, 60))]
        if rng.random() < 0.1:
            base = passage + base[:6]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 10])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rows = list(enumerate(texts[:10_000]))
    sets = [shingles(t) for _, t in rows]
    index, shared = {}, Counter()
    for i, grams in enumerate(sets):
        for g in grams:
            index.setdefault(g, []).append(i)
    for held in index.values():
        shared.update(itertools.combinations(held, 2))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    got = ngram_join.near_components(spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string").repartition(4)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group_key, set()).add(int(r.doc_id))
    want = {}
    for i, _ in rows:
        want.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(r.component_id == min(str(i) for i in groups[r.group_key]) and r.n_shingles == len(sets[int(r.doc_id)]) for r in got)


def test_a_line_of_many_rows_is_few_entries_of_its_range():
    rng = np.random.default_rng(6)
    line = rng.integers(1, 1 << 62, 8, dtype=np.uint64)
    grams = [np.unique(np.concatenate([line, rng.integers(1, 1 << 62, 20, dtype=np.uint64)])) for _ in range(50_000)]
    whole = np.concatenate(grams)
    at, low = ngram_join.sorted_twice(whole, 16)
    load = np.bincount(at, minlength=16)
    assert load.max() < 2 * load.mean()
    # what comes twice is the same as among all of them
    every = np.unique(whole[np.isin(whole, line)])
    pairs = {(a, v) for a, v, n in zip(*(x.tolist() for x in np.unique(np.stack([at, low.astype(np.int64)]), axis=1, return_counts=True)[0]), np.unique(np.stack([at, low.astype(np.int64)]), axis=1, return_counts=True)[1].tolist(), strict=True) if n == 2}
    assert {(int(g % np.uint64(16)), int(g >> np.uint64(32))) for g in every} <= pairs
    assert len(at) == 50_000 * 20 + 2 * 8


def test_runs_of_hashes_are_sent_as_gaps():
    rng = np.random.default_rng(3)
    for run in (rng.integers(0, 1 << 32, 30_000), rng.integers(0, 900, 5000), np.array([(1 << 32) - 1]), np.zeros(2), np.array([0, (1 << 32) - 1])):
        run = np.sort(run).astype("<u4")
        lower, upper = ngram_join.packed(run)
        assert ngram_join.unpacked(lower, upper).tolist() == run.tolist()
        assert len(run) < 5000 or len(lower) + len(upper) < 0.72 * 4 * len(run)


def test_whole_rows_hold_shared_columns_only(spark):
    same = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(same + ["a"])), (1, " ".join(same + ["b"])), (2, " ".join(same + ["a"])), (3, " ".join(f"o{i}" for i in range(70)))]
    frame = ngram_join._texts(spark.createDataFrame(docs, "doc_id long, text string"), "text", "doc_id")
    marks, grams = {int(r.id): r.mark for r in frame.collect()}, list(ngram_join.gram_rows([t for _, t in docs], 5))
    keys = [ngram_join.row_key(g) for g in grams]
    firsts = spark.createDataFrame([(keys[0], marks[0]), (keys[1], marks[1]), (keys[3], marks[3])], "key long, first long")
    none = np.zeros(1 << 15, dtype=np.uint8)
    repeats, ranges = ngram_join.repeated_columns(frame, 5, none, none, 1000)
    rows = ngram_join.whole_rows(frame, firsts, spark.createDataFrame([(keys[0],), (keys[1],)], "key long"), 5, repeats, ranges).collect()
    assert sorted((r.key, r.n) for r in rows) == sorted((k, 57) for k in keys[:2])
    common = set(grams[0].tolist()) & set(grams[1].tolist())
    held = {r.key: set(np.frombuffer(r.grams, dtype=np.uint64).tolist()) for r in rows}
    assert held[keys[1]] >= common and len(held[keys[1]]) == 56


def test_ngram_join_of_no_rows(spark):
    assert ngram_join.near_components(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.key: r.comp for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_packing_is_a_round_trip(spark, docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), keep_ids=True).collect()
    want = sorted(tuple(exact.encode(r[1] or "", add_special_tokens=False).ids) + (2,) for r in corpus())
    pieces = sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32, r.piece) for r in got)
    assert len(pieces) == len(got)
    for r in got:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    once = [r for r in got if r.doc_id is not None and r.doc_id not in (1, 20)]
    built = {}
    for r in sorted(once, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(built.get(r.doc_id, ())), r.doc_id
        built[r.doc_id] = built.get(r.doc_id, ()) + tuple(r.ids)
    assert set(built.values()) <= set(want) and len(built) == len(corpus()) - 6
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(places) <= math.ceil(total / 1024) + 2
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0


def test_ids_are_those_of_the_tokenizer_as_loaded():
    """Texts that spell an added token in whole, in part and in a row, among others."""
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    rng = random.Random(11)
    bits = [*"abc", *(t.content for t in exact.get_added_tokens_decoder().values()), "<|endoftext", "|>", " ", "\n", "word", " 12", "'s", "é", "—", "日本", "😀", "\u0130", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, text
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_packing_of_text_ids_and_a_very_long_text(spark):
    rows = [("a", "word " * 400_000), ("b", None), (None, "x"), ("b", "y y")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id string, text string"), tokenizer_path()).collect()
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == "a")
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 1024 for _, _, n in long[1:])
    assert all(a + n == b for (_, a, n), (_, b, _) in zip(long, long[1:], strict=False))
    assert sorted(r.length for r in got if r.doc_id == "b") == [1, 3] and sum(r.doc_id is None for r in got) == 1


def test_best_two_fit_swaps_the_smallest_for_a_tighter_pair():
    lengths = [60, 25, 21, 18]
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(sorted(lengths[i] for i in b) for b in bins) == [[18, 21, 60], [25]]


def test_quality_rules_equal_brute_force(spark, docs):
    def measure(text):
        text = text or ""
        words, lines = WORD.findall(text), text.split("\n")
        n, cover, seen = len(words), set(), {}
        for i in range(n - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for starts in seen.values():
            if len(starts) > 1:
                cover |= {i + k for i in starts for k in range(8)}
        longest, spans = 0, set()
        for size in range(5, n):
            at = {}
            for i in range(n - size + 1):
                at.setdefault(tuple(words[i : i + size]), []).append(i)
            found = [s for s in at.values() if len(s) > 1]
            if not found:
                break
            longest = size
            spans |= {i + k for s in found for i in s for k in range(size)}
        dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(spans), longest

    rows = quality_rules.quality_rules(docs.selectExpr("*", "7 AS n_words", "8 AS base_failed")).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        n, chars, symbols, dup, repeat, cover, longest = measure(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert (r.covered_words, r.longest_repeat) == (cover, longest)
        failed = n < 20 or 100 * repeat > 30 * n
        assert r.base_failed == failed and (not failed or not r.kept)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_repeats_of_a_very_long_text():
    """300,000 words in which one passage of 700 words comes twice."""
    rng = random.Random(5)
    words = [f"w{rng.getrandbits(40)}" for _ in range(300_000)]
    words[200_000:200_700] = words[1000:1700]
    n, _, _, _, repeat, cover, longest = quality_rules.measure(" ".join(words))
    assert (n, repeat, cover, longest) == (300_000, 1400, 1400, 700)


def test_kept_digest_of_an_empty_document(spark):
    row = line_dedup.dedup_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sha2("kept_text", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()


def test_least_hashed_is_bounded_and_repeatable(spark):
    from quern.llm.common import least_hashed

    rows = spark.range(20_000).selectExpr("id", "id % 3 AS x").repartition(5)
    once = [r.id for r in least_hashed(rows, 100, "id").collect()]
    assert len(set(once)) == 100 and once == [r.id for r in least_hashed(rows.repartition(2), 100, "id").collect()]
    assert least_hashed(rows.limit(7), 100, "id").count() == 7 and least_hashed(rows.limit(0), 5, "id").count() == 0


def test_bits_hold_their_keys(spark):
    from quern.llm.common import gathered_bits, has_bit

    bits = gathered_bits(spark.range(0, 3000, 3), "id")
    keys = np.arange(30_000)
    found = has_bit(bits, keys)
    assert found[0:3000:3].all() and found.sum() < 1000 + 300


def test_ngrams_hashed_many_texts_at_a_time_are_those_of_each(monkeypatch):
    """One long buffer holds many texts: no n-gram reaches over an edge, wherever runs end."""
    rng = random.Random(8)
    texts = [None, "", " \t", "One", "a b c", "a b c d e", "A B C D E F"] + [rng.choice(["", " ", "\n"]) + " ".join(rng.choice(["a", "Bc", "é", "dd\x0be"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    for run in (1, 100, 1 << 16):
        monkeypatch.setattr(ngram_join, "RUN_BYTES", run)
        rows = list(ngram_join.gram_rows(texts, 5))
        assert [len(r) for r in rows] == [len(w) for w in want]
        assert len({g for r in rows for g in r.tolist()}) == len(set().union(*want))
        assert all(set(rows[i].tolist()).isdisjoint(rows[j].tolist()) == want[i].isdisjoint(want[j]) for i in range(0, 207, 5) for j in range(207))
