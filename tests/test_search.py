"""Bounded search against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.vector import cosine
from quern.operators import cells, index


def frames(spark, m, asked):
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "point_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, query_vector array<double>")
    return points, queries


def rows(frame):
    return sorted((r.query_id, r["rank"], r.point_id, round(r.score, 9)) for r in frame.collect())


def test_clusters_are_searched_in_part(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    m = centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 32))
    points, queries = frames(spark, m, m[rng.integers(0, 4000, 60)] + 0.05 * rng.normal(size=(60, 32)))
    held = cells.build(points)
    found = cells.knn_bounded(queries, held).cache()
    assert rows(found) == rows(index.knn(queries, points))
    assert cells.share_scored(found, held) < 0.3


@pytest.mark.parametrize("kind", ["noise", "copies", "few"])
def test_same_as_exact_search_where_bounds_help_little(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    m = {"noise": rng.normal(size=(500, 24)), "copies": np.repeat(rng.normal(size=(4, 8)), 200, axis=0) * rng.integers(1, 5, (800, 1)), "few": rng.normal(size=(3, 5))}[kind]
    points, queries = frames(spark, m, np.vstack([m[:3] * 2, -m[:2], rng.normal(size=(5, m.shape[1]))]))
    monkeypatch.setattr(cells, "PART_POINTS", 100)
    got = cells.knn_bounded(queries, cells.build(points, most_pivots=16))
    want = index.knn(queries, points)
    if kind == "copies":  # scores equal but for rounding: compare scores and the number of places
        assert [(r[0], r[1], round(r[3], 6)) for r in rows(got)] == [(r[0], r[1], round(r[3], 6)) for r in rows(want)]
    else:
        assert rows(got) == rows(want)


def test_empty_sides(spark):
    points, queries = frames(spark, np.eye(3), np.eye(3))
    none = points.filter("false")
    assert cells.knn_bounded(queries, cells.build(none)).count() == 0
    assert cells.knn_bounded(queries.filter("false"), cells.build(points)).count() == 0
    assert cells.share_scored(cells.knn_bounded(queries.filter("false"), cells.build(points)).withColumn("scored", F.col("scored")), cells.build(points)) == 0


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_a_bucketed_index_is_not_shuffled(spark, tmp_path):
    m = np.random.default_rng(2).normal(size=(300, 4))
    rows = [(f"p{i}", "d", f"c{i // 2}", "en" if i % 2 else "ar", v.tolist()) for i, v in enumerate(m)]
    points = spark.createDataFrame(rows, "point_id string, doc_id string, chunk_id string, lang string, vector array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held = index.create_bucketed(points, str(tmp_path / "a"), 4)
        asked = points.filter("lang = 'ar'").select("point_id")
        found = index.lookup(held, asked)
        assert exchanges(found) == 1 and found.count() == 150
        other = held.select(*(F.col(c).alias(f"x_{c}") for c in ("point_id", "lang")))
        twins = points.join(other, F.concat(F.col("point_id"), F.lit("")) == F.col("x_point_id"), "left")
        assert exchanges(twins) == 1
        new = index.replace_bucketed(held, points.limit(10).withColumn("lang", F.lit("fr")), points.filter("point_id = 'p0' OR point_id = 'p299'"), str(tmp_path / "b"), 4)
        assert new.count() == 298 and new.filter("lang = 'fr'").count() == 9
        again = index.open_bucketed(spark.newSession(), str(tmp_path / "b"), "point_id string, doc_id string, chunk_id string, lang string, vector array<double>, norm double", 4)
        assert again.count() == 298
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain(queries, points, k, apart=False, same=None):
    """The k nearest by pairs, as an expression scores them."""
    admit = F.lit(True)
    admit = admit & (F.col("query_id") != F.col("point_id")) if apart else admit
    return rows(index.knn(queries, points, k, admit & (F.col(same[0]) == F.col(same[1])) if same else admit))


@pytest.mark.parametrize("small", [False, True])
def test_blocks_find_what_all_pairs_have(spark, small, monkeypatch):
    if small:  # many blocks on both sides, few scores at a time
        for name, value in {"POINT_BLOCK": 256, "QUERY_BLOCK": 7, "HELD_SCORES": 600, "HELD_COMPONENTS": 200}.items():
            monkeypatch.setattr(index, name, value)
    rng = np.random.default_rng(6)
    m = np.vstack([rng.normal(size=(900, 6)), np.repeat(rng.normal(size=(3, 6)), 60, axis=0)])
    points, queries = frames(spark, m, m[::25])
    points, queries = points.withColumn("label", F.col("point_id") % 3), queries.withColumns({"query_id": F.col("query_id") * 25, "asked": F.col("query_id") % 4})
    assert rows(index.knn(queries, points, 5)) == plain(queries, points, 5)
    assert rows(index.knn(queries, points, 5, apart=True)) == plain(queries, points, 5, True)
    assert rows(index.knn(queries, points, 5, same=("asked", "label"), apart=True)) == plain(queries, points, 5, True, ("asked", "label"))
    assert rows(index.knn(queries, points.limit(3), 5)) == plain(queries, points.limit(3), 5)


def test_search_makes_no_pairs_row_by_row(spark):
    points, queries = frames(spark, np.eye(5), np.eye(5))
    said = index.knn(queries, points, 2)._jdf.queryExecution().toString()


def test_vectors_without_direction_and_of_other_lengths_do_not_meet(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 1.0]), (7, [None, 1.0])], "point_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 0.0, 2.0])], "query_id long, query_vector array<double>")
    assert [r[:3] for r in rows(index.knn(queries, points, 8))] == [(1, 1, 1), (1, 2, 6), (4, 1, 4)]


def test_all_cosines_are_those_of_pairs_made_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(index, "PAIR_QUERIES", 7)
    rng = np.random.default_rng(11)
    kind = "array<double>"
    m = [rng.normal(size=6).tolist() for _ in range(600)] + [rng.normal(size=4).tolist() for _ in range(20)] + [None, [float("nan")] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("inf")] + [1.0] * 5]
    points = spark.createDataFrame(list(enumerate(m)), f"point_id long, vector {kind}")
    queries = points.filter("point_id % 25 = 0 OR point_id > 615").selectExpr("point_id AS query_id", "vector AS query_vector")
    want = queries.join(points, F.col("query_id") != F.col("point_id")).select("query_id", "point_id", F.round(cosine(F.col("query_vector"), F.col("vector")), 6).alias("cosine"))
    got = index.all_cosines(queries, points, 6)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    halves = [0.0000005, -0.0000005, 0.1234565, 0.1234575, -0.7654325, -1e-9, 0.3]
    exact = [r[0] for r in spark.createDataFrame([(x,) for x in halves], "x double").select(F.round("x", 6)).collect()]
    assert index._rounded(np.array(halves), 6).tolist() == exact


def test_queries_are_not_copied_for_every_block_or_cell(spark, monkeypatch, tmp_path):
    """Many passes find the same; no plan deals queries out, and a task gives out k at most."""
    for name, value in {"POINT_BLOCK": 256, "HELD_COMPONENTS": 512}.items():
        monkeypatch.setattr(index, name, value)
    m = np.random.default_rng(9).normal(size=(1500, 8))
    points, queries = frames(spark, m, m[:200] + 0.01)
    points, queries = (f.withColumn(c, F.concat(F.lit("p"), c)) for f, c in ((points, "point_id"), (queries, "query_id")))
    found = index.near_pairs(queries, points, 3)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString() and found.count() <= 200 * 3 * index.TASKS * 4
    want = rows(index.knn(queries, points, 3, F.lit(True)))
    assert rows(index.ranked(found, 3)) == want
    by_cells = cells.knn_bounded(queries, cells.build(points), 3)
    assert "FlatMapCoGroups" not in by_cells._jdf.queryExecution().toString() and rows(by_cells) == want
    assert "FlatMapCoGroups" not in index.all_cosines(queries, points, 6)._jdf.queryExecution().toString()
