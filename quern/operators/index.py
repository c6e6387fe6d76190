"""The vector index as Parquet: scans, point lookups, exact search and the life cycle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.vector import cosine, dot, norm

#: Fixed value: hits read before de-duplication.
TOP_K_RAW = 8
#: Buckets of an index by point_id.
BUCKETS = 16
#: Points of a task's block and queries of a pass of the search at most; tasks for each core.
POINT_BLOCK, QUERY_BLOCK, TASKS = 8192, 65536, 4
#: Components of vectors and scores of pairs that a search holds at once; what rounding may
#: make of equal scores.
HELD_COMPONENTS, HELD_SCORES, NEAR_TIE = 1 << 22, 1 << 21, 1e-12
#: Points of a task, queries of a pass and cosines given out at once where every pair's is, at most.
PAIR_POINTS, PAIR_QUERIES, PAIR_SCORES = 4096, 65536, 1 << 20


class IndexMismatch(ValueError):
    """The data does not fit the index it is meant for."""


def create(points: DataFrame, path: str, vector: str = "vector") -> DataFrame:
    """Replace the index at path.  Ids must be unique and vectors of one length.

    Norms are stored, so that search never works them out again, and documents are
    directories, so that a filter on doc_id prunes files.
    """
    shape = points.agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("ids"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if shape.n != shape.ids:
        raise IndexMismatch(f"{shape.n} points have {shape.ids} ids")
    if shape.lo != shape.hi:
        raise IndexMismatch(f"vectors of {shape.lo} to {shape.hi} components")
    points.withColumn("norm", norm(F.col(vector))).write.mode("overwrite").partitionBy("doc_id").parquet(path)
    back = points.sparkSession.read.parquet(path)
    if (held := back.count()) != shape.n:
        raise IndexMismatch(f"{held} of {shape.n} points were written")
    return back


def create_bucketed(points: DataFrame, path: str, buckets: int = BUCKETS, vector: str = "vector") -> DataFrame:
    """The index as a table of buckets by point_id, with norms.

    Lookups, twins, upserts and deletes meet it by that key, so it is read where it lies and
    only the other side moves.  The table's name lasts as long as the session; open_bucketed()
    names the files again in another one.
    """
    rows = points.withColumn("norm", norm(F.col(vector)))
    rows.repartition(buckets, "point_id").write.bucketBy(buckets, "point_id").sortBy("point_id").option("path", path).mode("overwrite").saveAsTable(_table(path))
    return points.sparkSession.table(_table(path))


def open_bucketed(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """An index that create_bucketed() wrote at path, maybe in another session."""
    if not spark.catalog.tableExists(_table(path)):
        spark.sql(f"CREATE TABLE {_table(path)} ({schema}) USING parquet CLUSTERED BY (point_id) SORTED BY (point_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_table(path))


def _table(path: str) -> str:
    return "points_" + hashlib.md5(path.encode()).hexdigest()


def replace_bucketed(old: DataFrame, new: DataFrame, gone: DataFrame | None, path: str, buckets: int = BUCKETS) -> DataFrame:
    """A new bucketed index at another path: old with the points of new, and without those
    whose ids are in gone.  Old points go from bucket to bucket; only new ones are dealt."""
    ids = new.select("point_id") if gone is None else new.select("point_id").union(gone.select("point_id"))
    stay = old.join(ids.distinct(), "point_id", "left_anti").select(old.columns)
    coming = new if "norm" in new.columns else new.withColumn("norm", norm(F.col("vector")))
    coming = coming if gone is None else coming.join(gone.select("point_id").distinct(), "point_id", "left_anti")
    whole = stay.unionByName(coming.select(old.columns).repartition(buckets, "point_id"))
    whole.write.bucketBy(buckets, "point_id").sortBy("point_id").option("path", path).mode("overwrite").saveAsTable(_table(path))
    return old.sparkSession.table(_table(path))


def open_index(spark: SparkSession, path: str | None) -> DataFrame:
    """The index that the settings name; without one there is nothing to search."""
    if not path:
        raise ValueError("index_path is not set")
    return spark.read.parquet(path)


def health(index: DataFrame, release: str) -> DataFrame:
    """One row: the state of a readable index, its number of points and the release that serves it."""
    return index.agg(F.count("*").alias("documents_indexed")).withColumns({"status": F.lit("healthy"), "release": F.lit(release)})


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("point_id").distinct(), "point_id", "left_semi")


def where(index: DataFrame, numbers: list[int] | None = None, **equal) -> DataFrame:
    """Rows whose payload equals every given value and holds any of the numbers."""
    for c, v in equal.items():
        index = index.filter(F.col(c) == v)
    return index if numbers is None else index.filter(F.arrays_overlap("article_numbers", F.array(*map(F.lit, numbers))))


def _vectors(frame: DataFrame, vector: str, norm_of: str | None) -> DataFrame:
    """frame with its vector as __v and norm as __n, without vectors that have no direction:
    null or empty ones, zero, or not finite throughout."""
    out = frame.withColumns({"__v": F.col(vector), "__n": F.col(norm_of) if norm_of else norm(F.col(vector))})
    return out.filter((F.col("__n") > 0) & (F.col("__n") < float("inf")))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order in which vector.dot() sums."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Best:
    """The k best points of each of n queries among those seen so far, ties to the smaller id.
    Scores below a query's floor need not be kept."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores, self.ids, self.floor = k, np.full((n, k), -np.inf), None, floor

    def wanted(self, scores: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the scores that may be among the best of the queries at these
        places.  Scores come from a matrix product, whose last bits depend on where a row lies,
        so what is within NEAR_TIE of the k-th is wanted too."""
        least = self.scores[at, -1] if self.floor is None else np.maximum(self.scores[at, -1], self.floor[at])
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and scores.shape[1] > self.k:
            least[new] = np.partition(scores[new], -self.k, axis=1)[:, -self.k]
        return np.nonzero((scores >= least[:, None] - NEAR_TIE) & (scores > -np.inf))

    def add(self, query: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        """Points with their exact scores, for the queries at these places."""
        if not len(query):
            return
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, dtype=ids.dtype)
        met, row = np.unique(query, return_inverse=True)
        old = self.scores[met].ravel() > -np.inf
        row = np.concatenate([np.repeat(np.arange(len(met)), self.k)[old], row])
        exact, ids = np.concatenate([self.scores[met].ravel()[old], exact]), np.concatenate([self.ids[met].ravel()[old], ids])
        place = np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place, -exact, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], np.arange(len(met)))[row[order]]
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.scores[met[row[order]], rank], self.ids[met[row[order]], rank] = exact[order], ids[order]

    def found(self, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, ids and scores of all that was kept, in parts."""
        row, rank = np.nonzero(self.scores > -np.inf)
        for s in range(0, len(row), step):
            at = row[s : s + step], rank[s : s + step]
            yield at[0], self.ids[at], self.scores[at]


def exact_scores(a: tuple, b: tuple, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of chosen rows of a and b, which are vectors and norms."""
    exact = np.empty(len(row))
    step = max(1, HELD_COMPONENTS // a[0].shape[1])
    for s in range(0, len(row), step):
        r, c = row[s : s + step], col[s : s + step]
        exact[s : s + step] = _dots(b[0][c], a[0][r]) / (b[1][c] * a[1][r])
    return exact


def passes_of(queries: DataFrame, vector: str, most: int = QUERY_BLOCK) -> list[DataFrame]:
    """queries in parts by hash whose vectors have about HELD_COMPONENTS together, at most
    `most` rows each; what a pass sends to all tasks is bounded, whatever the table."""
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    passes = max(1, -(-n // max(1, min(most, HELD_COMPONENTS // max(dim, 1)))))
    part = F.pmod(F.xxhash64("query_id", vector), F.lit(passes))
    return [queries.filter(part == i) if passes > 1 else queries for i in range(passes)]


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def near_pairs(queries: DataFrame, points: DataFrame, k: int = TOP_K_RAW, same: tuple[str, str] | None = None, apart: bool = False, query_vector: str = "query_vector", vector: str = "vector", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, point_id, score: pairs among which are the k nearest points of every row of
    queries, by exact cosine, ties to the smaller id; at most k of each task.

    Queries are sent to all tasks, in passes of bounded size, and each task multiplies them
    with its points as matrices; so points are dealt once a pass and no query is copied to
    disk.  same: columns of queries and points that must be equal; apart: no point whose id is
    the query's.  Vectors of unequal length do not meet.
    """
    held, dim = points.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    rows = max(256, min(POINT_BLOCK, HELD_COMPONENTS // max(dim, 1)))
    context = points.sparkSession.sparkContext
    tasks = max(1, min(-(-held // rows), TASKS * context.defaultParallelism))
    q, p = _vectors(queries, query_vector, None), _vectors(points, vector, "norm" if "norm" in points.columns else None)
    met = lambda side: F.concat_ws("|", F.size("__v").cast("string"), *([F.col(same[side]).cast("string")] if same else []))
    if same:
        q, p = q.filter(F.col(same[0]).isNotNull()), p.filter(F.col(same[1]).isNotNull())
    q = q.select("query_id", "__v", "__n", met(0).alias("__same"))
    p = p.select("point_id", "__v", "__n", met(1).alias("__same")).repartition(tasks, "point_id")
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (points, "point_id"))]

    def searched(part: DataFrame) -> DataFrame:
        asked = part.toArrow().to_pandas()
        groups = {name: (g["query_id"].to_numpy(), np.vstack(g["__v"].to_numpy()), g["__n"].to_numpy(np.float64)) for name, g in asked.groupby("__same", sort=False)}
        sent = context.broadcast(groups)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[str, Best] = {}
            for batch in batches:
                for name, every in batch.groupby("__same", sort=False):
                    if name not in sent.value:
                        continue
                    asks, vectors, norms = sent.value[name]
                    kept = best.setdefault(name, Best(len(asks), k))
                    for at in range(0, len(every), rows):
                        other = every[at : at + rows]
                        ids, b = other["point_id"].to_numpy(), (stacked(other["__v"]), other["__n"].to_numpy(np.float64))
                        unit, order = (b[0] / b[1][:, None]).T, np.argsort(ids, kind="stable")
                        step = max(1, HELD_SCORES // len(ids))
                        for s in range(0, len(asks), step):
                            a = vectors[s : s + step].astype(np.float64), norms[s : s + step]
                            scores = (a[0] / a[1][:, None]) @ unit
                            if apart:
                                lo, hi = (np.searchsorted(ids[order], asks[s : s + step], side) for side in ("left", "right"))
                                for i in np.flatnonzero(hi > lo):
                                    scores[i, order[lo[i] : hi[i]]] = -np.inf
                            row, col = kept.wanted(scores, np.arange(s, s + len(a[1])))
                            kept.add(s + row, ids[col], exact_scores(a, b, row, col))
            for name, kept in best.items():
                for row, ids, scores in kept.found():
                    yield pd.DataFrame({"query_id": sent.value[name][0][row], "point_id": ids, "score": scores})

        return p.mapInPandas(search, f"query_id {kinds[0]}, point_id {kinds[1]}, score double")

    return reduce(DataFrame.unionByName, map(searched, passes_of(q, "__v", query_block)))


def _rounded(scores: np.ndarray, places: int) -> np.ndarray:
    """What Spark's round() makes of the scores; those next to half a step by decimals."""
    step = 10.0**places
    scaled = scores * step
    out = np.round(scaled) / step + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0
    return out


def all_cosines(queries: DataFrame, points: DataFrame, places: int, query_vector: str = "query_vector", vector: str = "vector") -> DataFrame:
    """query_id, point_id, cosine of every query and every point of another id, rounded.

    Queries are sent to all tasks, in passes of bounded size, and multiplied with each task's
    points; of each block a query's cosines leave the task as one array.  Vectors without a
    direction (null or empty ones, zero, or not finite throughout) meet all others one by one,
    and get what vector.cosine() gives; so do vectors of unequal length, whose cosine is null.
    """
    sized = lambda frame, v: frame.withColumn("__n", norm(F.col(v))).withColumn("__fine", F.coalesce((F.col("__n") > 0) & (F.col("__n") < float("inf")), F.lit(False)))
    q = sized(queries.select("query_id", F.col(query_vector).alias("__q")), "__q")
    p = sized(points.select("point_id", F.col(vector).alias("__p")), "__p")
    (n_points, odd_points), odd_queries = p.agg(F.count("*"), F.count_if(~F.col("__fine"))).first(), q.filter("NOT __fine").count()
    tasks = max(1, -(-n_points // max(256, min(PAIR_POINTS, n_points // 64))))
    found = p.filter("__fine AND point_id IS NOT NULL").select("point_id", "__p", "__n").repartition(tasks, "point_id")
    context = points.sparkSession.sparkContext
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (points, "point_id"))]

    def multiplied(part: DataFrame) -> DataFrame:
        asked = part.toArrow().to_pandas()
        sizes = asked["__q"].map(len).to_numpy(dtype=np.int64)
        ways = {d: (np.flatnonzero(sizes == d), np.vstack(asked["__q"].to_numpy()[sizes == d])) for d in np.unique(sizes)}
        sent = context.broadcast((asked["query_id"].to_numpy(), asked["__n"].to_numpy(np.float64), ways))

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asks, norms, ways = sent.value
            for batch in batches:
                ids, sizes, of = batch["point_id"].to_numpy(), batch["__p"].map(len).to_numpy(dtype=np.int64), batch["__n"].to_numpy(np.float64)
                of_size = {d: (np.flatnonzero(sizes == d), stacked(batch["__p"][sizes == d])) for d in np.unique(sizes)}
                step = max(1, PAIR_SCORES // max(1, len(ids)))
                for s in range(0, len(asks) if len(ids) else 0, step):
                    names = asks[s : s + step]
                    scores = np.full((len(names), len(ids)), np.nan)
                    for d in ways.keys() & of_size.keys():
                        lo, hi = np.searchsorted(ways[d][0], (s, s + step))
                        row, (col, b) = ways[d][0][lo:hi], of_size[d]
                        scores[np.ix_(row - s, col)] = ways[d][1][lo:hi].astype(np.float64) @ b.T / (norms[row, None] * of[col])
                    out = []
                    for ask, one in zip(names, scores, strict=True):
                        other = ids != ask
                        out.append((ask, ids[other], _rounded(one[other], places)))
                    yield pd.DataFrame(out, columns=["query_id", "ids", "cosines"])

        return found.mapInPandas(multiply, f"query_id {kinds[0]}, ids array<{kinds[1]}>, cosines array<double>")

    held = reduce(DataFrame.unionByName, map(multiplied, passes_of(q.filter("__fine AND query_id IS NOT NULL").select("query_id", "__q", "__n"), "__q", PAIR_QUERIES)))
    pairs = held.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("point_id"), F.col("cosines").alias("cosine")))).withColumn("cosine", F.nanvl("cosine", F.lit(None).cast("double")))
    apart = F.col("query_id") != F.col("point_id")
    one = lambda a, b: a.join(b, apart).select("query_id", "point_id", F.round(cosine(F.col("__q"), F.col("__p")), places).alias("cosine"))
    parts = [q.select("query_id", "__q", "__fine"), p.select("point_id", "__p", F.col("__fine").alias("__p_fine"))]
    if odd_queries:
        pairs = pairs.unionByName(one(parts[0].filter("NOT __fine"), parts[1]))
    if odd_points:
        pairs = pairs.unionByName(one(parts[0].filter("__fine"), parts[1].filter("NOT __p_fine")))
    return pairs


def ranked(scored: DataFrame, k: int = TOP_K_RAW) -> DataFrame:
    """query_id, rank, point_id, score of each query's k best, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "point_id", "score")


def knn(queries: DataFrame, points: DataFrame, k: int = TOP_K_RAW, admit: Column | None = None, query_vector: str = "query_vector", vector: str = "vector", same: tuple[str, str] | None = None, apart: bool = False) -> DataFrame:
    """query_id, rank, point_id, score: the k nearest by exact cosine, ties to the smaller id.

    Searches by near_pairs(), which says what same and apart are.  admit, over both sides'
    columns, filters pairs before the limit; with any such filter all pairs are made one by
    one, so it is for few queries.
    """
    if admit is None:
        return ranked(near_pairs(queries, points, k, same, apart, query_vector, vector), k)
    q = queries.select(*(c for c in queries.columns if c != query_vector), F.col(query_vector).alias("__q"), norm(F.col(query_vector)).alias("__qn"))
    p = points if "norm" in points.columns else points.withColumn("norm", norm(F.col(vector)))
    if same:
        admit = admit & (F.col(same[0]) == F.col(same[1]))
    if apart:
        admit = admit & (F.col("query_id") != F.col("point_id"))
    pairs = p.join(q, admit)
    return ranked(pairs.select("query_id", "point_id", (dot(F.col(vector), F.col("__q")) / (F.col("norm") * F.col("__qn"))).alias("score")), k)


def knn_arrow(queries: DataFrame, points: DataFrame, k: int = TOP_K_RAW, query_vector: str = "query_vector", vector: str = "vector", block: int = QUERY_BLOCK) -> DataFrame:
    """knn() without a pair filter, in blocks of at most so many queries; no row reaches the driver."""
    return ranked(near_pairs(queries, points, k, query_vector=query_vector, vector=vector, query_block=block), k)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points of new, and those of old that new does not replace."""
    return new.unionByName(old.join(new.select("point_id"), "point_id", "left_anti"))


def stale(old: DataFrame, new: DataFrame, doc_id) -> DataFrame:
    """Points of one document that its new version no longer has."""
    return old.filter(F.col("doc_id") == doc_id).join(new.select("point_id"), "point_id", "left_anti")


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("point_id"), "point_id", "left_anti")


def reindex_document(old: DataFrame, new: DataFrame, doc_id) -> DataFrame:
    """The index after a document's new version came in and its stale points went."""
    return delete(upsert(old, new), stale(old, new, doc_id))


def reindex(spark: SparkSession, path: str, new: DataFrame, docs: list[str], protected: str, vector: str = "vector") -> dict[str, tuple[int, int]]:
    """Re-index documents in place: {doc_id: (points before, after)}.

    New points are written over each document's directory; the protected document and the
    documents not named must come out as they were.
    """
    if protected in docs:
        raise IndexMismatch(f"{protected} is protected")
    index = spark.read.parquet(path)
    dims = lambda d: {r[0] for r in d.select(F.size(vector)).distinct().collect()}
    if (a := dims(index)) and (b := dims(new)) and a != b:
        raise IndexMismatch(f"vectors of {sorted(b)} components for an index of {sorted(a)}")
    count = lambda d: {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    before, coming = count(index), count(new)
    if set(coming) - set(docs):
        raise IndexMismatch(f"points of other documents: {sorted(set(coming) - set(docs))}")
    new.withColumn("norm", norm(F.col(vector))).select(index.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)
    after = count(spark.read.parquet(path))
    if after.get(protected, 0) != before.get(protected, 0):
        raise IndexMismatch(f"{protected} changed from {before.get(protected, 0)} to {after.get(protected, 0)} points")
    if sum(after.values()) != sum(before.values()) + sum(after.get(d, 0) - before.get(d, 0) for d in docs):
        raise IndexMismatch("the index holds points that no document accounts for")
    return {d: (before.get(d, 0), after.get(d, 0)) for d in docs}


def seed(spark: SparkSession, source: str, target: str, recreate: bool = False) -> dict:
    """Copy an index unless the target already holds as many points."""
    from pyspark.errors import AnalysisException

    want = spark.read.parquet(source).count()
    try:
        have = spark.read.parquet(target).count()
    except AnalysisException:
        have = None
    if have == want and not recreate:
        return {"copied": 0, "points": have, "skipped": True}
    spark.read.parquet(source).write.mode("overwrite").partitionBy("doc_id").parquet(target)
    held = spark.read.parquet(target).count()
    if held != want:
        raise IndexMismatch(f"{held} of {want} points were copied")
    return {"copied": held, "points": held, "skipped": False}


def covered_numbers(index: DataFrame) -> DataFrame:
    return index.select(F.explode("article_numbers").alias("article_number")).distinct()
