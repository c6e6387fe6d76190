"""Spelling variants: words one edit apart, found by their rarest positional bigrams.

One edit changes at most two of a word's bigrams.  Bigrams are ordered by how many words hold
them, and each word keeps its three rarest with their positions.  Of a near pair's bigrams
these cannot all be changed, and since both words keep theirs in one order, they share one
that lies equally far from the start (the edit is behind it) or from the end (the edit is
before it).  So what is joined is such a bigram with its position and the side that the edit
leaves alone; where the other side is long, one of its halves is untouched too and is joined
as well.  Every pair that meets is verified by its edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, dropped, hot_join, saved

#: Code points and occurrences a word has at least, and how often more its form has.
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: Bigrams a word is joined by: two may be changed by one edit.
PREFIX = 3
#: Free code points up to which the fixed side alone is the key.
SHORT_SIDE = 3
#: Every so many-th run, by hash, loses a letter.
DAMAGE = 31
#: Code points that words are made of: a-z, A-Z do not remain, and U+00C0 to U+00FF.
_FIRST_HIGH, _LETTERS = 0xC0, 26 + 64
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """word: every run of letters of at least least_length, some with one letter missing."""
    pattern = f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length)


def bigram_order(words: DataFrame) -> np.ndarray:
    """The place of every bigram, rarest first, ties by code points, in a table of all pairs of
    letters.  Its size is that of the alphabet squared, however many words there are."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    counts = sorted((r.n, r.gram) for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect())
    place = np.zeros((_LETTERS, _LETTERS), dtype=np.int32)
    for i, (_, gram) in enumerate(counts):
        x, y = _letters(np.array([ord(c) for c in gram]))
        place[x, y] = i
    return place


def _letters(points: np.ndarray) -> np.ndarray:
    return np.where(points < _FIRST_HIGH, points - ord("a"), points - _FIRST_HIGH + 26)


class _Sides:
    """Hashes of stretches of many words of one length: differences of a running sum."""

    def __init__(self, points: np.ndarray):
        n, self.length = points.shape
        self.sums = np.zeros((n, self.length + 1), dtype=np.uint64)
        for j in range(self.length):
            self.sums[:, j + 1] = self.sums[:, j] * _BASE + points[:, j].astype(np.uint64) + np.uint64(1)
        self.powers = np.ones(self.length + 1, dtype=np.uint64)
        np.multiply.accumulate(np.full(self.length, _BASE, dtype=np.uint64), out=self.powers[1:])

    def between(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        rows = np.arange(len(self.sums))
        start, end = np.broadcast_to(start, len(rows)), np.broadcast_to(end, len(rows))
        return self.sums[rows, end] - self.sums[rows, start] * self.powers[end - start]


def _mixed(*parts) -> np.ndarray:
    out = np.uint64(7)
    for part in parts:
        out = (out ^ np.asarray(part, dtype=np.uint64)) * _MIX
        out = out ^ (out >> np.uint64(29))
    return out


def side_keys(points: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, keys, longer) of words of one length, given by their code points.

    A pair of words meets by keys of the shorter (or equally long) word and of the longer one:
    with longer, a word's free side is measured as that of a word shorter by one.
    """
    length = points.shape[1]
    letters, sides = _letters(points.astype(np.int64)), _Sides(points)
    order = place[letters[:, :-1], letters[:, 1:]].astype(np.int64) * length + np.arange(length - 1)
    rarest = np.sort(np.partition(order, PREFIX - 1, axis=1)[:, :PREFIX], axis=1) % length
    for i in range(PREFIX):
        at = rarest[:, i]
        head, tail = sides.between(0, at + 2), sides.between(at, length)
        for longer in (False, True):
            for behind, whole in ((True, length - 2 - at), (False, at)):
                free = whole - longer
                half = free // 2
                long_side = free > SHORT_SIDE
                for kind in range(3):
                    rows = np.flatnonzero((free >= 0) & (long_side if kind else ~long_side))
                    if not len(rows):
                        continue
                    first, last = half[rows], (free - half)[rows]
                    if kind == 0:
                        fixed, more = (head if behind else tail)[rows], np.uint64(0)
                    elif behind:
                        fixed = sides.between(0, at + 2 + half)[rows] if kind == 1 else head[rows]
                        more = np.uint64(0) if kind == 1 else sides.between(length - (free - half) * long_side, length)[rows]
                    else:
                        fixed = tail[rows] if kind == 1 else sides.between((at - (free - half)) * long_side, length)[rows]
                        more = sides.between(0, half * long_side)[rows] if kind == 1 else np.uint64(0)
                    yield rows, _mixed(fixed, more, free[rows], first, last, kind * 2 + behind, length - longer), longer


def keyed(words: DataFrame, place: np.ndarray) -> DataFrame:
    """key, longer, word and n: the keys by which words of at least four letters meet."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch["word"].to_pylist(), dtype=object)
            lengths = np.array([len(w) for w in values], dtype=np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                points = np.frombuffer("".join(values[mine]).encode("utf-32-le"), dtype="<u4").reshape(len(mine), length)
                for rows, keys, longer in side_keys(points, place):
                    held = batch.take(pa.array(mine[rows]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(rows), longer)), held["word"], held["n"]], names=["key", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(scan, "key long, longer boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every unordered pair of words (word, n) that one edit parts, once."""
    place = bigram_order(words)
    short = keyed(words, place).filter("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = keyed(words, place).select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = (F.col("longer") & (F.length("a") < F.length("b"))) | (~F.col("longer") & (F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    met = short.join(other, (short["key"] == other["key"]) & once & (F.levenshtein("a", "b", 1) == 1))
    return met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def roots(links: DataFrame) -> DataFrame:
    """word and root of links (word, form): forms followed to the last, twice as far each turn."""
    held = saved(links.select("word", F.col("form").alias("root")), "links")
    while True:
        asked = held.groupBy("root").agg(F.count("*").alias("asked"))
        hops = saved(held.select(F.col("word").alias("root"), F.col("root").alias("next")).join(asked, "root"), "hops")
        if not hops.limit(1).count():
            dropped(hops)
            return held
        last, held = held, saved(hot_join(held, hops, ["root"], "asked", held.count(), ["word"]).select("word", F.coalesce("next", "root").alias("root")), "links")
        dropped(last, hops)


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, damage: int = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Words are the different runs of letters, A-Z lower-cased, one in `damage` of a document's
    runs by hash without one letter, that have least_length code points (at least 4) and
    least_count occurrences.  n_near counts the words one edit apart.  A word's form is the
    commonest of these (ties: first in code-point order) if it is `ratio` times as common; root
    follows forms to the last and is the word itself without one.  Null and empty texts have
    no words and null ids count as empty; repeated rows count each; texts and runs are read
    whole.  An empty table gives no rows.  Other columns of docs are not used.
    """
    counted = occurrences(docs, text, doc_id, least_length, damage).groupBy("word").agg(F.count("*").alias("n"))
    words = saved(counted.filter(F.col("n") >= least_count), "words")
    pairs = saved(near_pairs(words), "near")
    both = pairs.select("a", "n_a", "b", "n_b").union(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "near", "near_n")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.first("n").alias("n"))
    better = -F.col("best.less") >= ratio * F.col("n")
    best = saved(best.select("word", "n_near", F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")), "best")
    followed = roots(best.filter("form IS NOT NULL").select("word", "form"))
    out = words.join(best, "word", "left").join(followed, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
