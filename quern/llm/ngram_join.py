"""Jaccard join on word n-grams as a blocked sparse matrix product.

Documents are rows and hashed n-grams are columns of a 0/1 matrix A; overlaps are entries
of A times its transpose.  The product is formed block by block and never whole:

1. Rows that are equal are one row (a class).
2. Columns of a single row come first, then the less common before the more common.  Two
   rows that reach the threshold share one of the first few columns of each, so only that
   leading block of every row is dealt out by column, without its single columns.
3. Overlaps within the leading blocks accumulate by pair; a pair goes when its overlap and
   all that may still follow stay below the bound that the two sizes set.
4. What remains is multiplied in whole rows, many rows against one.

A group of near copies would fill a square of the product.  So first passes multiply rows
only against one row of each column's block (its hub), links are contracted to components,
and the exact pass multiplies only rows of different components.  That finds every link
between components, which is all that components depend on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import components, dropped, gathered_bits, has_bit, hot_join, saved

#: Cells in which n-grams are counted, and how many of them travel in one row.
CELLS, CELL_ROW = 1 << 16, 1 << 12
#: N-grams that one task multiplies against one row, and members of a component in one list.
TILE_GRAMS, LIST_ROWS = 200_000, 256
#: Columns up to which a row carries marks of all of them into its lists.
CARRIED = 128
#: N-grams one range sorts, and those a task holds before it sends them; hubs a
#: column has in each turn.
RANGE_GRAMS, FLUSH_GRAMS, HUB_TURNS, MORE_LINKS = 2_000_000, 2_000_000, (1, 16, 64), 1000
#: Bytes of texts that are hashed at a time.
RUN_BYTES = 1 << 16
#: Bits that mark repeated n-grams at most (32 MB).
MOST_BITS = 1 << 28
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes begin, and a 64-bit hash of each: differences of a running
    polynomial sum."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if len(raw) >= len(_powers[0]):
        for i, step in enumerate((_STEP, _BACK)):
            grown = np.full(2 * len(raw) + 1, step, dtype=np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _powers[0][: len(raw)], out=total[1:])
    return start, _mixed((total[end] - total[start]) * _powers[1][start])


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive words."""
    grams = np.full(len(ids) - size + 1, size * _STEP % (1 << 64), dtype=np.uint64)
    for i in range(size):
        grams += ids[i : len(ids) - size + 1 + i] * np.uint64(pow(_STEP, i + 1, 1 << 64))
    return _mixed(_mixed(grams))


def _encoded(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """The texts as bytes, in runs of about RUN_BYTES."""
    run, held = [], 0
    for t in texts:
        run.append((t or "").encode("utf-8", "surrogatepass"))
        held += len(run[-1])
        if held >= RUN_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def gram_rows(texts: Iterable[str | None], words_per_gram: int) -> Iterator[np.ndarray]:
    """Of each text, A-Z lower-cased: sorted distinct 64-bit hashes of its n-grams; one of the
    whole if it is shorter.  Short texts are hashed many at a time."""
    for run in _encoded(texts):
        begin = np.cumsum([0] + [len(t) + 1 for t in run])
        start, ids = _words(np.frombuffer(b" ".join(run).translate(_LOWER), dtype=np.uint8))
        place = np.searchsorted(start, begin).tolist()
        grams = _grams(ids, words_per_gram) if len(ids) >= words_per_gram else ids[:0]
        for i, j in zip(place, place[1:], strict=False):
            n = j - i
            row = np.sort(grams[i : j - words_per_gram + 1] if n >= words_per_gram else _grams(ids[i:j], n) if n else ids[:0])
            again = row[1:] == row[:-1]
            yield row[np.append(True, ~again)] if again.any() else row


def row_key(grams: np.ndarray) -> int:
    """A 64-bit key of the whole row; equal rows have equal keys."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).astype(np.int64))


def cell(grams: np.ndarray) -> np.ndarray:
    return ((grams >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int64)


def least_overlap(n, percent: int):
    """ceil(percent / 100 * n): what a row of n columns must share with any partner."""
    return (n * percent + 99) // 100


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Documents with a mark, by which scans know them again: the hash of id and text."""
    return docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("mark"))


def rows_and_cells(texts: DataFrame, size: int) -> DataFrame:
    """kind 0: id, mark, n and key of every document; kind 1: counts of a run of cells (n: its
    number), of the different rows that the task met."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, met, fresh, held = np.zeros(CELLS, dtype=np.int64), set(), [], 0
        for batch in batches:
            n, keys = [], []
            for grams in gram_rows(batch["text"], size):
                key = row_key(grams) if len(grams) else None
                n.append(len(grams))
                keys.append(key)
                if key is not None and key not in met:
                    met.add(key)
                    fresh.append(grams)
                    held += len(grams)
                    if held > 2 * CELLS:
                        cells += np.bincount(cell(np.concatenate(fresh)), minlength=CELLS)
                        fresh, held = [], 0
            yield pd.DataFrame({"kind": 0, "id": batch["id"], "mark": batch["mark"], "n": n, "key": pd.array(keys, dtype="Int64"), "counts": None})
        if fresh:
            cells += np.bincount(cell(np.concatenate(fresh)), minlength=CELLS)
        if met:
            runs = cells.reshape(-1, CELL_ROW)
            yield pd.DataFrame({"kind": 1, "id": None, "mark": 0, "n": range(len(runs)), "key": pd.array([None] * len(runs), dtype="Int64"), "counts": [r.astype("<i8").tobytes() for r in runs]})

    return texts.mapInPandas(scan, "kind int, id string, mark long, n long, key long, counts binary")


def total_cells(scanned: DataFrame) -> np.ndarray:
    """The cells' counts over all rows.  Their number is fixed, so what reaches the driver is."""

    def add(run: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype="<i8") for c in run["counts"])
        return pd.DataFrame({"run": [int(run["run"].iloc[0])], "counts": [total.tobytes()]})

    runs = scanned.filter("kind = 1").select(F.col("n").alias("run"), "counts").groupBy("run").applyInPandas(add, "run long, counts binary").collect()
    total = np.zeros((CELLS // CELL_ROW, CELL_ROW), dtype=np.int64)
    for r in runs:
        total[r.run] = np.frombuffer(r.counts, dtype="<i8")
    return total.reshape(-1)


def repeat_places(grams: np.ndarray, ranges: int, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each n-gram, and the bit within all n_bits that stands for it; a range owns
    its own stretch of bits."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    at = (grams % np.uint64(ranges)).astype(np.int64)
    return at, at * (n_bits // ranges) + (low.astype(np.uint64) * np.uint64(_STEP) >> np.uint64(24)).astype(np.int64) % (n_bits // ranges)


def sorted_twice(grams: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and upper half of the hashes, in order, each at most twice: that is as good as
    all of them for finding what comes more than once."""
    both = np.sort((grams % np.uint64(ranges)) << np.uint64(32) | grams >> np.uint64(32))
    keep = np.ones(len(both), dtype=bool)
    keep[2:] = both[2:] != both[:-2]
    both = both[keep]
    return (both >> np.uint64(32)).astype(np.int64), both.astype("<u4")


def packed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending 32-bit values as the lower halves of their gaps, and the upper halves deflated:
    the more values lie in a run, the fewer bits a gap has."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    upper = (gaps >> np.uint32(16)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    deflate = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return gaps.astype("<u2").tobytes(), deflate.compress(upper) + deflate.flush()


def unpacked(lower: bytes, upper: bytes) -> np.ndarray:
    high = np.frombuffer(zlib.decompress(upper), dtype=np.uint8).reshape(2, -1).T.copy().view("<u2")[:, 0]
    return np.cumsum(np.frombuffer(lower, dtype="<u2") | high.astype("<u4") << np.uint32(16), dtype="<u4")


def first_of_rows(rows: DataFrame) -> DataFrame:
    """key, first and least (the least mark and id of the documents that have the row) and
    held (how many have it)."""
    return saved(rows.groupBy("key").agg(F.min("mark").alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("held")), "firsts")


def copy_marks(rows: DataFrame, firsts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the documents that repeat another's row, and bits of the firsts among these.

    A row's first document may share a bit with copies by chance; all that do are in the
    second set, so what hits the first set and not the second is a copy for certain.
    """
    repeated = firsts.filter("held > 1").select("key", "first", "held")
    total = repeated.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    copies = gathered_bits(saved(hot_join(rows.select("mark", "key"), repeated, ["key"], "held", total, ["mark"]).filter("mark != first").select("mark"), "copies"), "mark")

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[has_bit(copies, batch["mark"].to_numpy(dtype=np.int64))]

    return copies, gathered_bits(saved(firsts.select(F.col("first").alias("mark")).mapInPandas(hits, "mark long"), "hits"), "mark")


def surely_copies(copies: np.ndarray, firsts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return has_bit(copies, marks) & ~has_bit(firsts, marks)


def repeated_columns(texts: DataFrame, size: int, copies: np.ndarray, firsts: np.ndarray, n_grams: int) -> tuple[np.ndarray, int]:
    """Bits of the n-grams that two different rows hold, and the number of ranges.

    Tasks send the upper half of every hash, in sorted runs by range; a range finds what
    comes twice.  A task sends none more than twice in FLUSH_GRAMS hashes, so an n-gram that a
    third of all rows hold is a few entries of its range.  A bit set by chance, or a copy that is sent too, only makes an n-gram look
    more common than it is.  What copy_marks() makes certain to be copies is left out, so
    every row is sent at least once.
    """
    ranges = n_bits = 1 << 4
    while ranges * RANGE_GRAMS < n_grams:
        ranges *= 2
    while n_bits < min(max(4 * n_grams, 1 << 18, 8 * ranges), MOST_BITS):
        n_bits *= 2

    def runs(parts: list[np.ndarray]) -> pd.DataFrame:
        at, low = sorted_twice(np.concatenate(parts), ranges)
        edges = np.flatnonzero(np.diff(at, prepend=-1))
        ends = np.append(edges[1:], len(at))
        held = [packed(low[i:j]) for i, j in zip(edges, ends, strict=True)]
        return pd.DataFrame({"range": at[edges], "lower": [x for x, _ in held], "upper": [x for _, x in held]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for grams in gram_rows(batch["text"][~surely_copies(copies, firsts, batch["mark"].to_numpy(dtype=np.int64))], size):
                if not len(grams):
                    continue
                parts.append(grams)
                held += len(grams)
                if held > FLUSH_GRAMS:
                    yield runs(parts)
                    parts, held = [], 0
        if held:
            yield runs(parts)

    def twice(group: pd.DataFrame) -> pd.DataFrame:
        low = np.sort(np.concatenate([unpacked(*x) for x in zip(group["lower"], group["upper"], strict=True)]))
        again = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.uint64)
        share = n_bits // ranges
        bits = np.zeros(share, dtype=bool)
        bits[(again * np.uint64(_STEP) >> np.uint64(24)).astype(np.int64) % share] = True
        return pd.DataFrame({"range": [int(group["range"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    found = texts.select("mark", "text").mapInPandas(scan, "range long, lower binary, upper binary").groupBy("range").applyInPandas(twice, "range long, bits binary")
    out = np.zeros((ranges, n_bits // ranges // 8), dtype=np.uint8)
    for r in found.toLocalIterator():
        out[r.range] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1), ranges


def shared_columns(grams: np.ndarray, repeats: np.ndarray, ranges: int) -> np.ndarray:
    """Those of the columns that the bits of repeated_columns() do not show to be of one row."""
    _, at = repeat_places(grams, ranges, 8 * len(repeats))
    return grams[(repeats[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]


def leading_block(texts: DataFrame, size: int, percent: int, cells: np.ndarray, repeats: np.ndarray, ranges: int, copies: np.ndarray, firsts: np.ndarray) -> DataFrame:
    """col, key and n of every row's leading columns, without those that no other row has.

    Columns of one row come first, then the less common before the more common.  What
    copy_marks() makes certain to be copies is left out, so every row is met at least once.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = set()
        for batch in batches:
            cols, keys, sizes = [], [], []
            for grams in gram_rows(batch["text"][~surely_copies(copies, firsts, batch["mark"].to_numpy(dtype=np.int64))], size):
                n, key = len(grams), row_key(grams) if len(grams) else None
                if key is None or key in met:
                    continue
                met.add(key)
                shared = shared_columns(grams, repeats, ranges)
                take = len(shared) - least_overlap(n, percent) + 1
                if take <= 0:
                    continue
                first = shared[np.argsort(cells[cell(shared)], kind="stable")[:take]].view(np.int64)
                cols.append(first)
                keys.append(np.full(len(first), key, dtype=np.int64))
                sizes.append(np.full(len(first), n, dtype=np.int64))
            if cols:
                yield pd.DataFrame({"col": np.concatenate(cols), "key": np.concatenate(keys), "n": np.concatenate(sizes)})

    return texts.select("mark", "text").mapInPandas(scan, "col long, key long, n long")


def may_reach(percent: int, n: Column | None = None, m: Column | None = None, shared: Column | None = None) -> Column:
    """Condition on a pair's sizes n, m and its overlap `shared` within the leading blocks.

    Whatever the leading blocks do not share lies behind the block that ends first, so at
    most as much follows as the longer tail, and no more than the smaller row holds.
    """
    n, m, shared = (F.col(c) if v is None else v for c, v in (("n", n), ("m", m), ("shared", shared)))
    need = F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - 1e-9)
    tail = F.greatest(F.ceil(n * percent / 100.0 - 1e-9), F.ceil(m * percent / 100.0 - 1e-9)) - 1
    close = (100 * n >= percent * m) & (100 * m >= percent * n)
    return close & (shared + F.least(tail, n, m) >= need)


def whole_rows(texts: DataFrame, firsts: DataFrame, keys: DataFrame, size: int, repeats: np.ndarray, ranges: int) -> DataFrame:
    """key, n and all columns of the rows named in keys, of one document each, without columns
    that no other row has: no overlap counts these, and n does.

    Which documents and rows these are goes to the scan as bits of fixed size, so other texts
    are not shuffled; the join drops what shares bits by chance.
    """
    firsts = saved(firsts.join(keys, "key").select("key", "first"), "reps")
    bits, named = gathered_bits(firsts, "first"), gathered_bits(firsts, "key")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = set()
        for batch in batches:
            out = {"row": [], "n": [], "grams": []}
            batch = batch[has_bit(bits, batch["mark"].to_numpy(dtype=np.int64))]
            for grams in gram_rows(batch["text"], size):
                key = row_key(grams) if len(grams) else None
                if key is not None and key not in met and has_bit(named, np.array([key]))[0]:
                    met.add(key)
                    for c, v in zip(out, (key, len(grams), shared_columns(grams, repeats, ranges).tobytes()), strict=True):
                        out[c].append(v)
            if out["row"]:
                yield pd.DataFrame(out)

    # equal keys have equal columns, so rows are one by key before they meet the keys and move once
    rows = texts.select("mark", "text").mapInPandas(scan, "row long, n long, grams binary")
    rows = rows.groupBy(F.col("row").alias("key")).agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    return saved(rows.join(firsts.select("key"), "key", "left_semi"), "rows")


def multiply(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, m: size of b) that reach the threshold in whole rows.

    A task multiplies one row a against a tile of its partners; how many tiles a has follows
    the columns its partners have.
    """
    load = pairs.groupBy("a").agg((F.floor(F.sum("m") / TILE_GRAMS) + 1).alias("tiles"), F.count("*").alias("held"))
    tiled = hot_join(pairs, load, ["a"], "held", pairs.count(), ["b"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("tiles")).alias("tile"))
    load = load.select("a", "tiles")
    members = tiled.join(rows.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("grams").alias("many")), "b")
    hubs = load.withColumnsRenamed({"a": "hub", "tiles": "of"}).join(rows.select(F.col("key").alias("hub"), "n", F.col("grams").alias("one")), "hub")
    hubs = hubs.select("hub", "n", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("place"))

    def product(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": []}
        if len(one) and len(many):
            left, n = np.frombuffer(one["one"].iloc[0], dtype=np.uint64), int(one["n"].iloc[0])
            for b, m, data in zip(many["b"], many["m"], many["many"], strict=True):
                right = np.frombuffer(data, dtype=np.uint64)
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                common = int((left[at] == right).sum()) if len(left) else 0
                if 100 * common >= percent * (n + m - common):
                    out["a"].append(one["hub"].iloc[0])
                    out["b"].append(b)
        return pd.DataFrame(out, dtype="int64")

    return hubs.groupBy("hub", "place").cogroup(members.groupBy("a", "tile")).applyInPandas(product, "a long, b long")


def mixed_columns(block: DataFrame, component: DataFrame | None) -> DataFrame:
    """The block with every row's component (its key until it has one), the component's
    members and the column's width, in columns that hold rows of two components or more."""
    if component is None:
        held = block.withColumns({"comp": F.col("key"), "members": F.lit(1).cast("long")})
    else:
        sizes = component.groupBy("comp").agg(F.count("*").alias("members"))
        sized = hot_join(component, sizes, ["comp"], "members", component.count(), ["key"])
        held = block.join(sized, "key", "left").withColumns({"comp": F.coalesce("comp", "key"), "members": F.coalesce("members", F.lit(1).cast("long"))})
        held = saved(held, "held")
    mixed = held.groupBy("col").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("width")).filter("lo < hi").select("col", "width")
    out = saved(hot_join(held, mixed, ["col"], "width", held.count(), ["key"]).filter("width IS NOT NULL").select("col", "key", "n", "comp", "members", "width"), "mixed")
    if component is not None:
        dropped(held)
    return out


def hub_pairs(held: DataFrame, turn: int, hubs: int, percent: int) -> DataFrame:
    """Every row with up to `hubs` hubs of other components that it may link to.

    A column's hubs are its rows of least hash, drawn anew each turn; a row takes those it
    shares most columns with.  Rows of wide columns draw by their hash alone whether they stand
    for hub, so that a few more than `hubs` of them are gathered.
    """
    lot = F.shiftrightunsigned(F.xxhash64("key", F.lit(turn)), 1)
    stands = F.when(lot < F.lit(2.0**63) * F.least(F.lit(1.0), (2 * hubs + 16) / F.col("width")), F.struct(lot.alias("lot"), F.col("key").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp")))
    gathered = F.slice(F.array_sort(F.collect_list(stands)), 1, hubs) if hubs > 1 else F.array_compact(F.array(F.min(stands)))
    drawn = held.groupBy("col").agg(F.transform(gathered, lambda x: x.dropFields("lot")).alias("h"), F.first("width").alias("drawn"))
    against = hot_join(held, drawn, ["col"], "drawn", held.count(), ["key"]).select("key", "n", "comp", F.inline("h")).filter("comp != hub_comp")
    against = against.groupBy("hub", "key").agg(F.count("*").alias("shared"), F.first("hub_n").alias("n"), F.first("n").alias("m")).filter(may_reach(percent))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "hub"))
    return against.withColumn("place", place).filter(F.col("place") <= hubs).select(F.col("hub").alias("a"), F.col("key").alias("b"), "m")


def cross_pairs(held: DataFrame, percent: int) -> DataFrame:
    """All pairs of rows of different components that may link by their leading blocks.

    held: see mixed_columns().  A column's rows come as lists of about LIST_ROWS: lists of
    one large component each, which never meet their own kind, and lists that small
    components share.  Rows of up to CARRIED columns carry 32-bit marks of all of them, so
    that a pair of such rows is judged where it meets first and goes no further if it falls
    below the bound; pairs with longer rows accumulate their overlap column by column.
    """
    mark = F.hash("col")
    carried = held.groupBy("key").agg(F.count("*").alias("r"), F.collect_set(mark).alias("marks"))
    carried = carried.select("key", F.when(F.col("r") <= CARRIED, F.col("marks")).alias("marks"), (F.col("r") - F.size("marks")).alias("slack"))
    held = held.join(carried, "key")
    large = F.col("members") > LIST_ROWS
    lot = F.when(large, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.floor(F.col("width") / LIST_ROWS) + 1))
    part = F.when(large, F.pmod(F.xxhash64("key"), F.floor(F.col("members") / LIST_ROWS) + 1)).otherwise(0)
    lists = held.groupBy("col", large.alias("large"), lot.alias("lot"), part.alias("part")).agg(F.collect_list(F.struct("key", "n", "comp", "marks", "slack")).alias("rows"))
    lists = lists.withColumn("at", F.struct("large", "lot", "part"))
    other = lists.select("col", F.col("at").alias("at2"), F.col("rows").alias("rows2"))
    met = lists.join(other, "col").filter((F.col("at") <= F.col("at2")) & ~(F.col("large") & F.col("at2.large") & (F.col("lot") == F.col("at2.lot"))))
    apart = F.col("at") != F.col("at2")
    fits = lambda x, y: (x["comp"] != y["comp"]) & (apart | (x["key"] < y["key"])) & (100 * x["n"] >= percent * y["n"]) & (100 * y["n"] >= percent * x["n"])

    def couple(x: Column, y: Column) -> Column:
        both = F.array_intersect(x["marks"], y["marks"])
        return F.struct(x["key"].alias("a"), x["n"].alias("n"), y["key"].alias("b"), y["n"].alias("m"), both.alias("both"), (x["slack"] + y["slack"]).alias("slack"))

    def counts(c: Column) -> Column:
        here = (F.array_min(c["both"]) == mark) & may_reach(percent, c["n"], c["m"], F.size(c["both"]) + c["slack"])
        return c["both"].isNull() | here

    couples = F.flatten(F.transform("rows", lambda x: F.filter(F.transform(F.filter("rows2", lambda y: fits(x, y)), lambda y: couple(x, y)), counts)))
    pairs = met.select(F.explode(couples).alias("p")).select("p.a", "p.b", "p.n", "p.m", F.when(F.col("p.both").isNull(), 1).otherwise(F.size("p.both") + F.col("p.slack")).alias("part"))
    flip = F.col("a") > F.col("b")
    pairs = pairs.select(*(F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("n", "m"), ("m", "n"))), "part")
    pairs = pairs.groupBy("a", "b").agg(F.sum("part").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    return pairs.filter(may_reach(percent)).select("a", "b", "m")


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_per_gram: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key and group_key of every row of docs.

    Two documents link when 100 times their common n-grams reach percent times those of
    either; component_id is the least id reachable by links, the document's own included.
    row_key stands for the set of n-grams and group_key for the component, whatever the ids;
    mark is the hash of id and text.  Null, empty and blank texts have no n-grams, null keys
    and stand alone; texts of fewer words than an n-gram are one n-gram.  Rows that share an
    id are rows of their own: they get the component of their text, and the component's least
    id may be theirs.  Null ids take part as links but name no component, so alone they get
    null.  Ids are of any ordered type.  No rows for no rows; other columns of docs are not
    used.  N-grams and rows are compared by 64-bit hashes.
    """
    texts = _texts(docs, text, doc_id)
    scanned = saved(rows_and_cells(texts, words_per_gram), "rows")
    every = scanned.filter("kind = 0").select(F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "mark", "n", "key")
    rows = every.filter("key IS NOT NULL")
    firsts = first_of_rows(rows)
    copies, known = copy_marks(rows, firsts)
    n_grams, n_rows = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    repeats, ranges = repeated_columns(texts, words_per_gram, copies, known, n_grams)
    lead = leading_block(texts, words_per_gram, percent, total_cells(scanned), repeats, ranges, copies, known)
    held = saved(lead.distinct(), "block")
    last, held = held, mixed_columns(held, None)
    dropped(last)
    whole = whole_rows(texts, firsts, held.select("key").distinct(), words_per_gram, repeats, ranges)
    parts, component, turn = [], None, 0
    while True:
        if component is not None:
            last, held = held, mixed_columns(held.select("col", "key", "n"), component)
            dropped(last)
        pairs = saved(hub_pairs(held, turn, HUB_TURNS[min(turn, len(HUB_TURNS) - 1)], percent), "pairs")
        found = saved(multiply(pairs, whole, percent), "links")
        parts.append(found)
        component = components(reduce(DataFrame.union, parts))
        dropped(pairs)
        turn += 1
        if turn >= len(HUB_TURNS) and found.count() < MORE_LINKS:
            break
    last, held = held, mixed_columns(held.select("col", "key", "n"), component)
    rest = saved(cross_pairs(held, percent), "pairs")
    parts.append(saved(multiply(rest, whole, percent), "links"))
    component = components(reduce(DataFrame.union, parts))
    dropped(last, held, rest, whole, *parts)
    grouped = firsts.select("key", "least", "held").join(component, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    named = grouped.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("rows"))
    grouped = saved(hot_join(grouped, named, ["comp"], "rows", firsts.count(), ["key"]).select("key", "comp", "held", "component_id"), "groups")
    out = hot_join(every, grouped, ["key"], "held", n_rows, ["mark"])
    component_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = saved(out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("key").alias("row_key"), F.col("comp").alias("group_key"), "mark"), "components")
    dropped(scanned, firsts, grouped, component)
    return out
