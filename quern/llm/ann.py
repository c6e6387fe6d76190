"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook.  Codebooks
start as k-means of residuals and are then refitted together by least squares; coding is a
beam search over partial sums.  The squared norm of a coded vector is stored, so a query
scores a code by table look-ups alone.  Codes lie in coarse cells, and a query looks into the
cells nearest to it.  The best codes are ranked again on whole vectors.  How many cells and how
many codes is measured, by where true neighbours of some queries lie among all of them.  Then
every query asks on its own for all codes that, by their own error and by the alignment of
errors with this query, may still be nearer than the k-th found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import least_hashed, saved

#: Vectors the codebooks are fitted on at most (those of least id hash); all rows are coded.
TRAIN_VECTORS = 8000
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 8, 3
#: Candidates a query ranks again on whole vectors, at least.
RERANK = 300
#: Queries (of least id hash) whose true neighbours are sought to see how many candidates it
#: takes, and the share of these neighbours that must be among the candidates.
TRIED, SHARE = 64, 0.98
#: Vectors of one length up to which each query is compared with all of them.
FEW = 300
NEAREST = "query_id long, rank int, vec_id long, score double"
#: Coarse cells of the codes: a quarter of the root of their number, within these bounds; the
#: share of true neighbours that must lie in the cells a query visits; codes of a cell that
#: one task scores.
LEAST_CELLS, MOST_CELLS, CELL_SHARE, CODE_BLOCK = 8, 1024, 0.99, 1 << 18
#: How far errors may be aligned with a query, as a multiple of the most that the later half of
#: its candidates shows; cosines that rounding of codes may hide, and those equal but for rounding.
ALIGNED, ROUNDING, EQUAL = 1.25, 2e-6, 1e-12
#: Bytes of query vectors up to which they are broadcast for the rerank.
BROADCAST_BYTES = 32 << 20


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions, float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search: the `beam` best partial sums go on to the next book.

        Squared error of a longer sum is the old error minus twice the residual's product
        with the word plus the word's norm, so residuals are never rebuilt for losers.
        """
        out = np.empty((len(x), len(self.words)), dtype=np.uint8)
        for start in range(0, len(x), 1024):
            part = x[start : start + 1024].astype(np.float32)
            n, d = part.shape
            residual, error = part[:, None], (part**2).sum(1)[:, None]
            codes = np.zeros((n, 1, 0), dtype=np.uint8)
            for book in self.words:
                grown = error[:, :, None] - 2 * (residual.reshape(-1, d) @ book.T).reshape(n, residual.shape[1], -1) + (book**2).sum(1)
                flat = grown.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                rows = np.arange(n)[:, None]
                parent, word = best // len(book), best % len(book)
                residual = residual[rows, parent] - book[word]
                codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
                error = flat[rows, best]
            out[start : start + 1024] = codes[np.arange(n), error.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.words))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.vstack([centres, np.zeros((k - len(centres), x.shape[1]), dtype=x.dtype)])
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres).astype(x.dtype)
    return centres


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> Codebooks:
    """Residual k-means, then rounds of beam coding and a joint least-squares refit."""
    rng, residual, found = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        book = _kmeans(residual, words, rng)
        found.append(book)
        residual = residual - book[((book**2).sum(1) - 2 * residual @ book.T).argmin(1)]
    model = Codebooks(np.stack(found))
    for _ in range(rounds):
        codes = model.encode(x) + np.arange(books)[None] * words
        size = books * words
        gram = np.zeros((size, size))
        for i in range(books):
            for j in range(i, books):
                block = np.zeros((words, words))
                np.add.at(block, (codes[:, i] % words, codes[:, j] % words), 1)
                gram[i * words : (i + 1) * words, j * words : (j + 1) * words] = block
                gram[j * words : (j + 1) * words, i * words : (i + 1) * words] = block.T
        right = np.zeros((size, x.shape[1]))
        for i in range(books):
            np.add.at(right, codes[:, i], x)
        gram[np.diag_indices(size)] += 0.1
        model = Codebooks(np.linalg.solve(gram, right).reshape(books, words, -1).astype(np.float32))
    return model


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v: vectors of finite components and a norm above zero; all others take no part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norm, scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def build_index(rows: DataFrame, model: Codebooks, centres: np.ndarray | None = None) -> DataFrame:
    """Every usable row coded, many to a row: the cell they lie in, n, ids, codes, the coded
    vectors' squared norms and the sines of their angles to the vectors (errors) as packed
    arrays, so that blocks of codes are a few values."""
    centres = np.zeros((1, model.words.shape[2])) if centres is None else centres

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _unit(_matrix(batch["v"]))
                codes, cell = model.encode(unit), cells_of(unit, centres)[:, 0]
                decoded = model.decode(codes).astype(np.float64)
                norm, ids = (decoded**2).sum(1), batch["id"].to_numpy(dtype="<i8")
                along = (unit * decoded).sum(1) / np.maximum(norm, 1e-12)
                error = np.where(along > 0, np.sqrt(((unit - along[:, None] * decoded) ** 2).sum(1)), 1.0).astype("<f4")
                norm = norm.astype("<f4")
                held = [np.flatnonzero(cell == c) for c in np.unique(cell)]
                yield pd.DataFrame({"cell": np.unique(cell), "n": [len(at) for at in held], **{c: [x[at].tobytes() for at in held] for c, x in (("ids", ids), ("codes", codes), ("norms", norm), ("errors", error))}})

    return rows.mapInPandas(coded, "cell int, n long, ids binary, codes binary, norms binary, errors binary")


def cells_of(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per row all cells, the nearest first."""
    return np.argsort(-(unit @ centres.T), axis=1, kind="stable")


def distinct_vectors(rows: DataFrame, members: int) -> DataFrame:
    """id, v and ids: one row per different vector, with the `members` least ids that have it.

    Only the least ids of a vector leave a task, so one shared by a third of all rows is few
    rows a task; members beyond k + 1 can never be among a query's k nearest.
    """
    mark = (F.xxhash64("v"), F.hash("v"))
    marked = rows.select("id", mark[0].alias("h1"), mark[1].alias("h2"))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    firsts = marked.withColumn("place", place).filter(F.col("place") <= members).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    firsts = firsts.withColumn("first", F.get("ids", F.lit(0)))
    held = rows.withColumns({"g1": mark[0], "g2": mark[1]}).join(firsts, (F.col("id") == F.col("first")) & (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")))
    return held.select("id", "v", "ids")


def _about(table: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Cosines of a query with coded vectors; table: books x words, codes: books x rows."""
    about = table[0][codes[0]]
    for i in range(1, len(codes)):
        about += table[i][codes[i]]
    return about / norm


def _unpacked(codes: pd.Series, norms: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.maximum(np.frombuffer(b"".join(norms), dtype="<f4"), 1e-12))
    return np.ascontiguousarray(np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(norm), -1).T), norm


def at_most(about: np.ndarray, error: np.ndarray, aligned: float) -> np.ndarray:
    """The greatest cosine a vector may have with a query, by the cosine and error of its code.

    A vector is its code's direction times the cosine of its error, plus an error of the stated
    size across it; `aligned` is the greatest cosine of that error with what of the query is
    across the code.  At 1 nothing can exceed this (Cauchy-Schwarz).
    """
    about = np.clip(about + ROUNDING, -1, 1)
    return np.sqrt(np.maximum(1 - error.astype(np.float64) ** 2, 0)) * about + aligned * error * np.sqrt(1 - about**2 + ROUNDING) + ROUNDING


def candidates_needed(rows: DataFrame, index: DataFrame, queries: DataFrame, model: Codebooks, k: int, tried: int = TRIED, share: float = SHARE, centres: np.ndarray | None = None) -> tuple[int, int]:
    """How many of a query's best codes hold `share` of the true k nearest, over all rows, and
    how many of its nearest cells hold CELL_SHARE of them.

    True neighbours of at most `tried` queries come from a scan of the vectors, their places
    from a scan of the codes, codes of equal score counted as before them.  Vectors equal to
    the query's own are left out, as they have its codes.
    """
    asked = _unit(np.array([r.v for r in least_hashed(queries, tried, "id").collect()], dtype=np.float64))

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = asked @ _unit(_matrix(batch["v"])).T
                scores[scores > 1 - 1e-12] = -2
                keep = min(k, len(batch))
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                query, place = np.repeat(np.arange(len(asked)), keep), best.ravel()
                yield pd.DataFrame({"query": query, "score": scores[query, place], "id": batch["id"].to_numpy()[place], "v": [batch["v"].iat[i].tolist() for i in place]})

    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = rows.select("id", "v").mapInPandas(truth, "query int, score double, id long, v array<double>")
    near = found.filter("score > -2").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).collect()
    if not near:
        return 0, 1
    visited = 1
    if centres is not None:
        order = cells_of(asked, centres)
        own = cells_of(_unit(np.array([r.v for r in near], dtype=np.float64)), centres)[:, 0]
        visited = 1 + int(np.ceil(np.quantile([int(np.flatnonzero(order[r["query"]] == c)[0]) for r, c in zip(near, own, strict=True)], CELL_SHARE)))
    codes = model.encode(_unit(np.array([r.v for r in near], dtype=np.float64)))
    norm = np.sqrt(np.maximum((model.decode(codes) ** 2).sum(1), 1e-12))
    at = np.array([r["query"] for r in near])
    tables = (asked.astype(np.float32) @ model.words.transpose(0, 2, 1)).transpose(1, 0, 2)
    least = np.array([_about(tables[q], codes[i : i + 1].T, norm[i : i + 1])[0] for i, q in enumerate(at)]) - 1e-6

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                held, size = _unpacked(batch["codes"], batch["norms"])
                n = np.zeros(len(at), dtype=np.int64)
                for query in np.unique(at):
                    mine = np.flatnonzero(at == query)
                    n[mine] = len(size) - np.searchsorted(np.sort(_about(tables[query], held, size)), least[mine])
                yield pd.DataFrame({"i": np.arange(len(at)), "n": n})

    places = index.select("codes", "norms").mapInPandas(before, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return int(np.ceil(np.quantile([r.n for r in places], share))), visited


def exactly_nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The answer for vectors whose length few share: every length is a small group by itself."""

    def compared(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id", kind="stable")
            ids, unit = held["id"].to_numpy(), _unit(_matrix(held["v"]))
            for query, q in zip(asked["id"], _unit(_matrix(asked["v"])), strict=True):
                scores = (unit * q).sum(1)
                best: dict[int, float] = {}
                for i in np.argsort(-scores, kind="stable"):
                    if ids[i] != query and len(best) < k:
                        best.setdefault(ids[i], scores[i])
                out += [(query, rank, vec_id, score) for rank, (vec_id, score) in enumerate(best.items(), 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    sized = [f.withColumn("d", F.size("v")).groupBy("d") for f in (queries, rows)]
    return sized[0].cogroup(sized[1]).applyInPandas(compared, NEAREST)


def nearest(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK, books: int = BOOKS, few: int = FEW) -> DataFrame:
    """The k nearest rows by cosine found for each row that is_query (a Column) selects.

    Returns query_id, rank, vec_id and score, ties to the smaller id; a query is not its own
    candidate, and with at most `rerank` different vectors the answer is exact.  Of more,
    `rerank` or candidates_needed() are ranked again, whichever is greater; of codes that
    score equally those of smaller id come first.  Then each query ranks all further codes
    that may reach its k-th score (at_most(), over all cells), so no list length is common to
    all queries: members of a tight group, whose codes are alike, are all looked at.  Null, empty, zero and non-finite vectors,
    and null ids, take no part.  Vectors of different lengths are apart: each length is
    searched by itself, by comparison where at most `few` vectors have it and with codebooks
    of its own otherwise.  Rows of one id are each candidates and the id is listed once, with
    its best score; a query id given twice asks with one of its vectors, the greatest.  Equal
    vectors are coded once; queries meet the codes of the cells they visit, large cells in
    parts, and only each part's best go on.  An empty table gives no rows; other columns are not used, whatever
    their names.
    """
    every = usable(vectors, vec_id, embedding)
    every = every.groupBy("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).agg(F.first("v").alias("v"))
    every = saved(every.select("id", "v"), "vectors")
    queries = every.filter(is_query(F.col("id"))).groupBy("id").agg(F.max(F.struct(F.size("v").alias("d"), "v")).alias("q")).select("id", F.col("q.v").alias("v"))
    lengths = every.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    many = [r.d for r in lengths.filter(F.col("n") > few).orderBy("d").collect()]
    common = F.size("v").isin(many) if many else F.lit(False)
    found = [_nearest_of_length(every.filter(F.size("v") == d), queries.filter(F.size("v") == d), d, k, rerank, books) for d in many]
    if lengths.filter(F.col("n") <= few).limit(1).count():
        found.append(exactly_nearest(every.filter(~common), queries.filter(~common), k))
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], NEAREST)


def _nearest_of_length(every: DataFrame, queries: DataFrame, d: int, k: int, rerank: int, books: int) -> DataFrame:
    """nearest() of the vectors of one length d."""
    rows = saved(distinct_vectors(every, k + 1), "distinct")
    sample = least_hashed(rows.select("id", "v"), TRAIN_VECTORS, "id").collect()
    x = _unit(np.array([r.v for r in sample], dtype=np.float64)).astype(np.float32)
    model = fit_codebooks(x, books, min(WORDS, max(2, len(x) // 8)))
    n_codes, n_queries = rows.count(), queries.count()
    cells = min(MOST_CELLS, len(x), max(LEAST_CELLS, int(n_codes**0.5 / 4)))
    centres = _kmeans(x, cells, np.random.default_rng(5)).astype(np.float64)
    queries = saved(queries, "queries")
    index = saved(build_index(rows.select("id", "v"), model, centres), "codes")
    visited = cells
    if n_codes > rerank and n_queries:
        needed, visited = candidates_needed(rows, index, queries, model, k, centres=centres)
        rerank, visited = max(rerank, needed), min(cells, max(visited, -(-2 * k * cells // n_codes)))
    sizes = {r.cell: r.n for r in index.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    parts = np.array([-(-sizes.get(c, 0) // CODE_BLOCK) for c in range(cells)])

    held_by = np.array([sizes.get(c, 0) for c in range(cells)])

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            order = cells_of(_unit(_matrix(batch["v"])), centres)
            before = np.cumsum(held_by[order], axis=1) - held_by[order]
            row, place = np.nonzero((np.arange(cells) < visited) | (before <= k))  # k others at least
            cell = order[row, place]
            times = parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            if len(row):
                yield pd.DataFrame({"id": batch["id"].to_numpy()[row], "v": batch["v"].to_numpy()[row], "cell": cell, "part": part})

    # every code is in one cell and moves once; what is copied is the queries, to the cells they visit
    asked = queries.mapInPandas(visits, "id long, v array<double>, cell int, part int")
    many = F.get(F.array(*(F.lit(int(n)) for n in parts)), F.col("cell"))
    held = index.withColumn("part", F.pmod(F.xxhash64("ids"), many).cast("int"))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "ids": [], "abouts": [], "errors": []}
        if len(left) and len(right):
            ids, error = (np.frombuffer(b"".join(right[c]), dtype=t) for c, t in (("ids", "<i8"), ("errors", "<f4")))
            codes, norm = _unpacked(right["codes"], right["norms"])
            keep = min(rerank + 1, len(ids))
            for query, vector in zip(left["id"], left["v"], strict=True):
                table = model.words @ _unit(np.asarray(vector, dtype=np.float64)[None])[0].astype(np.float32)
                about = _about(table, codes, norm)
                best = np.flatnonzero(about >= np.partition(about, -keep)[-keep])
                if len(best) > keep:
                    best = best[np.lexsort((ids[best], -about[best]))[:keep]]
                for c, x in zip(out, (query, ids[best].tobytes(), about[best].astype("<f4").tobytes(), error[best].tobytes()), strict=True):
                    out[c].append(x)
        return pd.DataFrame(out)

    def first_of_cells(lists: pd.DataFrame) -> pd.DataFrame:
        ids, about, error = (np.frombuffer(b"".join(lists[c]), dtype=t) for c, t in (("ids", "<i8"), ("abouts", "<f4"), ("errors", "<f4")))
        best = np.lexsort((ids, -about))
        # one id of several vectors is listed once, with its best code
        best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:rerank]
        return pd.DataFrame({"query_id": lists["query_id"].iloc[0], "id": ids[best], "about": about[best], "error": error[best], "place": np.arange(len(best))})

    near = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInPandas(scored, "query_id long, ids binary, abouts binary, errors binary")
    near = near.groupBy("query_id").applyInPandas(first_of_cells, "query_id long, id long, about float, error float, place int")
    asking = queries.withColumnsRenamed({"id": "query_id", "v": "q"})
    if n_queries * d * 8 <= BROADCAST_BYTES:
        asking = F.broadcast(asking)
    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_unit(_matrix(a)) * _unit(_matrix(b))).sum(1) if len(a) else [], dtype=float)

    def compared(pairs: DataFrame) -> DataFrame:
        return pairs.join(rows, "id").join(asking, "query_id").withColumn("score", cosine("q", "v")).drop("q", "v")

    def ranked(exact: DataFrame) -> DataFrame:
        listed = exact.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id != vec_id")
        listed = listed.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        listed = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return listed.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    listed = saved(compared(near), "near")
    if n_codes <= rerank or not n_queries:
        return ranked(listed)
    across = F.col("error") * F.sqrt(F.greatest(1 - F.col("about") ** 2, F.lit(ROUNDING)))
    shown = F.greatest(F.lit(0.0), (F.col("score") - F.sqrt(F.greatest(1 - F.col("error") ** 2, F.lit(0.0))) * F.col("about")) / F.greatest(across, F.lit(1e-9)))
    later = F.when((F.col("place") >= rerank // 2) & ~F.array_contains("ids", F.col("query_id")), shown)
    limits = listed.groupBy("query_id").agg(F.least(F.lit(1.0), ALIGNED * F.coalesce(F.max(later), F.lit(1.0))).alias("aligned"), F.collect_list("id").alias("had"))
    kth = ranked(listed).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    limits = limits.join(kth, "query_id", "left").select(F.col("query_id").alias("id"), "aligned", F.coalesce("least", F.lit(-2.0)).alias("least"), "had")
    # nothing is nearer than a vector of the same direction
    limits = saved(limits.filter(F.col("least") < 1 - EQUAL).join(queries, "id"), "limits")

    def everywhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [(c, p) for c in range(cells) for p in range(parts[c])]
        for batch in batches:
            for c, p in at:
                yield batch.assign(cell=c, part=p)

    def reaching(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "more": []}
        if len(left) and len(right):
            ids, error = (np.frombuffer(b"".join(right[c]), dtype=t) for c, t in (("ids", "<i8"), ("errors", "<f4")))
            codes, norm = _unpacked(right["codes"], right["norms"])
            for query, vector, aligned, least in zip(left["id"], left["v"], left["aligned"], left["least"], strict=True):
                table = model.words @ _unit(np.asarray(vector, dtype=np.float64)[None])[0].astype(np.float32)
                found = ids[at_most(_about(table, codes, norm), error, aligned) >= least]
                if len(found):
                    out["query_id"].append(query)
                    out["more"].append(np.unique(found))
        return pd.DataFrame(out)

    asked = limits.drop("had").mapInPandas(everywhere, "id long, aligned double, least double, v array<double>, cell int, part int")
    more = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInPandas(reaching, "query_id long, more array<long>")
    more = more.join(limits.select(F.col("id").alias("query_id"), "had"), "query_id").select("query_id", F.explode(F.array_except("more", "had")).alias("id"))
    return ranked(listed.select("query_id", "ids", "score").union(compared(more).select("query_id", "ids", "score")))
