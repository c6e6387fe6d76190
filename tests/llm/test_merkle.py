"""Merkle manifests against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain(rows):
    """(doc_id, leaf): leaf, subroot, root and all siblings, of every row in tree order."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [sorted(groups[g], key=lambda x: x[:3]) for g in names]

    def grow(nodes, paths, owners):
        while len(nodes) > 1:
            for i, run_of in enumerate(owners):
                for leaf_no in run_of:
                    start = i // 8 * 8
                    paths[leaf_no].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
            owners = [sum(owners[i : i + 8], []) for i in range(0, len(owners), 8)]
            nodes = [digest(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        return nodes[0]

    paths, subroots, places, at = {}, [], [], 0
    for tree in trees:
        owners = [[at + i] for i in range(len(tree))]
        paths |= {o[0]: [] for o in owners}
        places.append([o[0] for o in owners])
        subroots.append(grow([x[2] for x in tree], paths, owners))
        at += len(tree)
    root = grow(subroots, paths, places)
    return sorted(((x[3] is not None, x[3] or 0, x[2], subroots[t], root, "".join(a + b for a, b in paths[places[t][i]])) for t, tree in enumerate(trees) for i, x in enumerate(tree)))


def found(frame):
    rows = frame.withColumn("proof", merkle.proof_text(F.col("path"))).collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof) for r in rows)


def made(n, langs, seed=0):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, 3, None]), rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([i, None]), rng.choice([None, "", f"Text {i} é"])) for i in range(n)]
    return rows + rows[: n // 10] + rows[:1] * (n // 5)


@pytest.mark.parametrize(("n", "langs", "depth", "top"), [(700, ["en", "de", None, "fr", ""], 1, 2), (600, ["en"], 2, 4096), (300, [f"l{i}" for i in range(90)] + [None], 1, 3), (1, ["x"], 4, 2048)])
def test_tree_is_the_plain_one(spark, n, langs, depth, top):
    rows = made(n, langs)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.merkle_manifest(docs, depth=depth, top=top)
    assert found(got) == plain(rows)
    assert merkle.verified(got).filter("NOT verified").count() == 0


def test_tampered_rows_are_told(spark):
    rows = [(i, "s", "en", 3, f"Abc {i}" if i % 2 else f"abc {i}") for i in range(50)] + [(50, "s", "en", 0, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "path": F.lit(1), "g": F.lit(2), "pos": F.lit(3)})
    got = merkle.verified(merkle.merkle_manifest(docs, now={"text": F.lower("text")}))
    assert {r.doc_id: r.verified for r in got.collect()} == {i: not (i % 2 and i < 50) for i in range(51)}


def test_empty_table_and_long_text(spark):
    assert merkle.verified(merkle.merkle_manifest(spark.createDataFrame([], SCHEMA))).count() == 0
    row = (1, None, None, None, "Ab é\n" * 400_000)
    r = merkle.merkle_manifest(spark.createDataFrame([row], SCHEMA)).collect()[0]
    assert (r.leaf, r.root, r.path) == (leaf(row), leaf(row), [])
