"""Runs and paragraphs against plain programs, and the embedder hook."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V
from quern.operators import chunking, embedding


def test_runs_cross_ranges(spark):
    rng = random.Random(2)
    rows = []
    for doc in ("a", "b", None):
        n = 0
        for _ in range(80):
            n += rng.choice([1, 1, 1, 2])
            rows.append((doc, n, rng.random() < 0.7, rng.choice(["x", "x", "x", "y"])))
    rng.shuffle(rows)
    plain, last = [], None
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        follows = last is not None and row[0] == last[0] and row[2] and last[2] and row[3] == last[3] and row[1] == last[1] + 1
        if follows:
            plain[-1].append(row)
        else:
            plain.append([row])
        last = row
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as can be
    try:
        docs = spark.createDataFrame(rows, "doc string, article_number int, is_repealed boolean, text_ar string").repartition(7)
        got = chunking.repealed_runs(docs, ["doc"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    runs = {}
    for r in got:
        runs.setdefault(r.run, []).append((r.doc, r.article_number, r.is_repealed, r.text_ar))
        assert r.run_length == sum(x.run == r.run for x in got)
    assert sorted(map(repr, (sorted(x, key=lambda r: r[1]) for x in runs.values()))) == sorted(map(repr, plain))


def test_paragraphs_begin_at_marked_lines(spark):
    rng = random.Random(4)
    parts = ["(١) one", " ) ٢ ( two", "plain", "", "  ", "text (٣) in it", "(\n٤)", " (٥)x", "(6) no"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(200)] + ["", "(١)", "\n\n"] + ["(١) a\n" * 50_000]

    def plain(text):
        out = []
        for i, line in enumerate(text.split("\n")):
            if i and re.match(r"\s*[)(]\s*[٠-٩]+\s*[)(]", line.strip()):
                out.append([line])
            elif out:
                out[-1].append(line)
            else:
                out = [[line]]
        return ["\n".join(x).strip() for x in out]

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.paragraphs(F.col("t"), T.PARAGRAPH_AR).alias("p")).collect()
    for r in got:
        assert r.p == plain(r.t)


def test_a_model_embeds_batches_of_texts(spark):
    texts = ["one", "", None, "é ٣", "x" * 5000] * 9
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    embed = embedding.embedder(embedding.hash_model(12), batch_size=4)
    for r in frame.select(embed(F.col("t")).alias("v"), V.hash_embedding(F.coalesce("t", F.lit("")), 12).alias("w")).collect():
        assert np.allclose(r.v, r.w)


def test_texts_in_force_are_not_shuffled(spark):
    rng = random.Random(6)
    head = "doc string, article_number int, book string, chapter string, section string, topic string, text_ar string, text_en string, is_repealed boolean, source_page int"
    rows = [("d", i, "b", "c", "s", "t", rng.randbytes(10_000).hex(), "", dead, 1) if not (dead := None if i % 50 == 0 else i % 5 > 2) else ("d", i, "b", "c", "s", "t", f"gone {i // 20}", "x", True, 1) for i in range(200)]

    def sent():
        ex = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(ex.apply(i).totalShuffleWrite() for i in range(ex.size()))

    before = sent()
    got = chunking.build_chunks(spark.createDataFrame(rows, head), ["doc"], F.lit("Law")).select("kind", "article_numbers", "text_ar").collect()
    assert sent() - before < 500_000
    assert sorted(n for r in got for n in r.article_numbers) == list(range(200))
    assert {(r.kind, len(r.article_numbers)) for r in got} == {("whole", 1), ("run", 2)} and {r.text_ar for r in got if r.kind == "whole"} == {r[6] for r in rows if not r[8]}
