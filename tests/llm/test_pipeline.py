import itertools
import random

import corpus_pipeline
from quern.llm.common import saved
from quern.llm.quality_rules import quality_rules
from .test_documents_ops import brute_components, shingles


def test_every_stage_keeps_what_it_should(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram join", "source mix", "packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], d), name.replace(" ", "-")))
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    kept = {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    assert {r.doc_id for r in tables[1].collect()} == kept
    assert {r.doc_id for r in tables[2].collect()} == kept
    rows = [(r.doc_id, r.text) for r in tables[2].collect()]
    assert sorted(r.doc_id for r in tables[3].collect()) == sorted({c for _, _, c in brute_components(rows)})
    texts = {r.doc_id: r.text for r in tables[3].collect()}
    mixed = tables[4].collect()
    assert all(texts[r.doc_id] == r.text for r in mixed)
    packed = tables[5].collect()
    assert sum(r.piece == 0 for r in packed) == len(mixed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_nulls_repeats_ties_and_long_texts(spark):
    """Rows that repeat an id in whole and with other texts, null ids, texts and sources, a
    very long text, and columns whose names the stages use."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.getrandbits(30)}" for _ in range(n))
    a, b, c, d = (text(60) for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (1, b), (2, b + " end"), (None, c), (None, c), (None, c + " end"), (3, d + " end"), (None, d), (4, text(60_000)), (5, None), (6, ""), (None, None), (7, "too short"), (8, text(40))]
    rows = [(i, t, None if n % 3 else "en", [None, "s", "t"][n % 3], len(t or "")) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS kept", "2 AS size", "3 AS copies", "4 AS mark", "5 AS n_words").repartition(4)
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], ""), name.replace(" ", "-")))
    assert all(t.columns == list(corpus_pipeline.COLUMNS) for t in tables[1:-1])
    judged = sorted((r.doc_id or 0, r.text) for r in tables[1].collect())
    assert judged == sorted((i or 0, t) for i, t, *_ in rows if t and len(t.split()) >= 20)
    once = tables[3].collect()
    sets = [shingles(r.text) for r in once]
    assert not any(100 * len(x & y) >= 75 * len(x | y) for x, y in itertools.combinations(sets, 2))
    either = lambda t: c if t == c + " end" else t
    assert sorted((r.doc_id or 0, either(r.text)) for r in once) == sorted([(1, a), (1, b), (0, c), (3, d + " end"), (4, rows[10][1]), (8, rows[15][1])])
    mixed, packed = tables[4].collect(), tables[5].collect()
    assert len(mixed) == sum(r.piece == 0 for r in packed)
    assert len({(r.doc_id, r.piece, r.ids_crc32, r.copy) for r in packed}) == len(packed)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, ""), name.replace(" ", "-"))
        assert docs.count() == 0
