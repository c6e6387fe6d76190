"""Packing token sequences: best-two-fit over pieces of at most `capacity` tokens."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import saved

#: Pieces packed together by one task: enough that its last, part-filled sequence is
#: negligible, few enough for any executor.
BLOCK_PIECES = 40_000
#: Fixed value: the splitting pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these characters two regex engines may know different Unicode tables.
UNSURE = "[^\x00-\u024f\u2010-\u2027\u20ac]"


@cache
def _encoders(path: str):
    """The tokenizer of the file, a faster engine over the same vocabulary and merges, and a
    pattern of the texts that only the former may read."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact = Tokenizer.from_file(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t.content for t in exact.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in exact.get_vocab().items() if token not in special}
    unsure = re.compile("|".join([UNSURE, *map(re.escape, sorted(special - {""}))]))
    return exact, tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), unsure


class Encoder:
    """Ids of whole texts as the tokenizer file defines them.

    Texts of Latin letters and common signs take the faster engine, which gives the same ids
    there; all others, and those that spell one of the vocabulary's added tokens (which then
    is that token), go through the file's own library.
    """

    def __init__(self, path: str):
        self.exact, self.fast, self.unsure = _encoders(path)

    def __call__(self, text: str) -> array:
        if self.unsure.search(text):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids)
        return array("I", self.fast.encode_ordinary(text))


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on demand, the ids.

    A document is the ids of its text (null: none) and then end_id.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for key, value in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(value or "")
                ids.append(end_id)
                data = memoryview(ids.tobytes())
                for i, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    row = (None if pd.isna(key) else key, i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]))
                    rows.append((*row, ids[start : start + length].tolist()) if keep_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]
            out = pd.DataFrame(rows, columns=names)
            if kind in ("bigint", "int"):
                out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(pieces, schema)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, each of at most `capacity`.

    A bin is filled greedily with the largest item that fits.  Then its smallest item is
    replaced by two unpacked items whose sum fits the widened gap more tightly, if there
    are any; among pairs of the best sum the one with the largest member wins.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        stock[n].append(i)
    for x in stock:
        x.reverse()
    # at_most[n]: the largest length in stock that is no more than n, 0 if there is none
    at_most = [0] * (capacity + 1)

    def refresh(n: int) -> None:
        value = n if stock[n] else at_most[n - 1]
        while n <= capacity and (not stock[n] or n == value) and at_most[n] != value:
            at_most[n] = value
            n += 1

    for n in range(1, capacity + 1):
        at_most[n] = n if stock[n] else at_most[n - 1]

    def take(n: int) -> int:
        item = stock[n].pop()
        if not stock[n]:
            refresh(n)
        return item

    bins = []
    for largest in range(capacity, 0, -1):
        while stock[largest]:
            items, gap = [take(largest)], capacity - largest
            while gap and (n := at_most[gap]):
                items.append(take(n))
                gap -= n
            if gap and len(items) > 1:
                least = lengths[items[-1]]
                room, best = gap + least, (least, 0, 0)
                a = at_most[room - 1]
                while a and 2 * a > best[0]:
                    b = at_most[min(a, room - a)]
                    if b == a and len(stock[a]) < 2:
                        b = at_most[a - 1]
                    if b and a + b > best[0]:
                        best = (a + b, a, b)
                        if a + b == room:
                            break
                    a = at_most[a - 1]
                if best[1]:
                    back = items.pop()
                    items += [take(best[1]), take(best[2])]
                    stock[least].append(back)
                    refresh(least)
            bins.append(items)
    return bins


def pack(pieces: DataFrame, capacity: int = 1024, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces (a written table, with doc_id, piece, length).

    Pieces are dealt by a hash of document and piece into blocks of about block_pieces, and
    each block is packed by itself: at most one sequence per block stays part-filled for
    want of items.  Full pieces are sequences as they are.  An empty table gives no rows.
    """
    blocks = -(-max(1, pieces.count()) // block_pieces)
    shown = [f for f in pieces.schema.names if f not in ("sequence_id", "offset", "__block")]

    def packed(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = block["length"].tolist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for n, items in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = n * blocks + key[0], at
                at += lengths[i]
        return block[shown].assign(sequence_id=sequence, offset=offset)

    dealt = pieces.select(*shown, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(blocks)).alias("__block"))
    schema = pieces.select(*shown).schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("__block").applyInPandas(packed, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack.  Null or empty text is the end id alone; rows that share an id
    are documents of their own; other columns of docs are not used; no rows for no rows."""
    return pack(saved(token_pieces(docs, tokenizer_path, text, doc_id, capacity, end_id, keep_ids), "pieces"), capacity)
