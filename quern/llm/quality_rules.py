"""Quality rules with suffix-array repetition.

Word-level suffix arrays (prefix doubling, in numpy) and their longest-common-prefix values
give every maximal repeated word sequence of a document; the union of their spans and the
longest of them are limited.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Shortest repeat that counts, in words; the largest share of words that repeats may
#: cover; the longest repeat allowed, in words.
LEAST_REPEAT, MOST_COVERED, MOST_LONGEST = 5, 0.3, 200
#: Odd multipliers for window hashes, from a fixed rule.
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(16)], dtype=np.uint64)


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash per window of `size` word numbers."""
    n = len(ids) - size + 1
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size if n > 0 else 0):
        out += mixed[i : i + n] * _MULTIPLIERS[i]
    return out


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which windows occur twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    flags = np.zeros(len(hashes), dtype=bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return flags


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """Positions of 0..n-1 in the union of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def suffix_repeats(ids: np.ndarray, least: int) -> tuple[int, int]:
    """(words covered by repeats of `least` words or more, longest repeat).

    Ranks by the first 1, 2, 4, ... words are kept, four bytes a word each and no more of
    them than the longest repeat has doublings, so that common prefixes of neighbours in the
    suffix array add up from the longest power down.  Each suffix's longest repeat
    is the larger of its two neighbouring values; spans of repeats that are not maximal lie
    within spans of those that are, so the union over suffixes is that of the maximal ones.
    """
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    kind = np.int32 if n < 1 << 31 else np.int64
    levels, width = [rank.astype(kind)], 1
    while width < n and levels[-1].max() < n - 1:
        key = levels[-1].astype(np.int64)
        key *= n + 1
        key[:-width] += levels[-1][width:]
        key[:-width] += 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, dtype=kind)
        rank[order] = np.cumsum(np.diff(key, prepend=key[0]) != 0, dtype=kind)
        levels.append(rank)
        width *= 2
    del rank
    order = np.argsort(levels[-1], kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, dtype=np.int64)
    for power in range(len(levels) - 1, -1, -1):
        size, rank = 1 << power, levels[power]
        for _ in range(2 if power == len(levels) - 1 else 1):
            fits = (a + size <= n) & (b + size <= n)
            same = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            a, b, common = a + size * same, b + size * same, common + size * same
    longest = np.zeros(n, dtype=np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    starts = np.flatnonzero(longest >= least)
    return covered(starts, longest[starts], n), int(common.max(initial=0))


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat."""
    text = text or ""
    words = WORD.findall(text)
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += bool(WORD.search(line))
        else:
            seen.add(line)
    n, repeat_words, cover, longest = len(words), 0, 0, 0
    if n > LEAST_REPEAT:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        short = np.sort(window_hashes(ids, LEAST_REPEAT))
        if (short[1:] == short[:-1]).any():
            if n > WINDOW:
                starts = np.flatnonzero(repeated(window_hashes(ids, WINDOW)))
                repeat_words = covered(starts, np.full(len(starts), WINDOW), n)
            cover, longest = suffix_repeats(ids, LEAST_REPEAT)
    return n, sum(map(len, words)), symbols, dup_lines, repeat_words, cover, longest


def quality_rules(docs: DataFrame, text: str = "text", most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
    longest_repeat, base_failed and kept to every row of docs.

    longest_repeat is 0 where no repeat has LEAST_REPEAT words.  Null and empty text have no
    words and fail the base rule.  Texts are measured whole,
    one at a time, within a scan; nothing is shuffled.  Columns of docs that clash with the
    added names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    docs = docs.drop(*(c for c in [*names, "base_failed", "kept"] if c != text))
    kind = "struct<" + ", ".join(f"{c}: long" for c in names) + ">"

    @F.pandas_udf(kind)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([measure(t) for t in batch], columns=names, dtype="int64")

    out = docs.withColumn("__m", measured(F.col(text))).select(*docs.columns, *(F.col(f"__m.{c}").alias(c) for c in names))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_longest)
    return out.withColumns({"base_failed": failed}).withColumn("kept", ~F.col("base_failed") & good)
