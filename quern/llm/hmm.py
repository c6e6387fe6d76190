"""A hidden Markov language model over whole corpora.

Words are counted over all training documents.  Common words are symbols of their own and all
others fall into classes by their last two bytes, within which they keep their share of the
counts; so the tables of the model have a fixed size, while every word's probability follows
its own count.  Each round of Baum-Welch sends expected counts from all partitions to be
summed; a scaled forward recursion then gives the exact probability of each text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import saved

#: Hidden states; words that are symbols of their own at most; classes of all others.
STATES, OWN_SYMBOLS, CLASSES = 8, 1 << 15, 1 << 12
#: Words whose counts are broadcast at most, the commonest; others meet theirs by a join.
BROADCAST_WORDS = 1 << 18
#: Rounds of Baum-Welch, each on all training documents.
ROUNDS = 10
#: Added to counts of words; weight of the symbols' overall shares in each state.
ADDED, PRIOR = 0.1, 20.0
#: Symbols of a stretch that is run through at once, of the stretches held together, and of
#: the texts from which stretches of like length are taken.
STRETCH, HELD, GATHERED = 4096, 1 << 20, 1 << 22
#: Steps after which weights are rescaled, few enough that none vanishes between.
RESCALED = 8
#: Bytes of text that are encoded together.
SLICE = 1 << 22
#: Expected counts travel as whole multiples of this, so that sums do not depend on order.
GRAIN = 1 / (1 << 16)
END = 0


@dataclass
class Model:
    start: np.ndarray  # states
    moves: np.ndarray  # states x states
    emits: np.ndarray  # symbols x states


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs outside the six white-space characters, A-Z lower-cased) of the texts,
    and the place of each word's text; null texts have none."""
    # Arrow splits a slice of an array wrongly, as if it began where the whole array does.
    text = text.take(pa.array(np.arange(len(text))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text.cast(pa.large_string())))
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), owner.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows whose texts have about `most` bytes together."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = [*(np.flatnonzero(np.diff(size // most)) + 1), len(batch)]
        for start, end in zip([0, *ends], ends, strict=False):
            if end > start:
                yield batch.slice(start, end - start)


def word_class(words: pa.Array) -> np.ndarray:
    """A class of CLASSES by the last two bytes of each word."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if len(words) else np.zeros(0, dtype=np.uint8)
    last = data[offsets[1:] - 1].astype(np.uint32)
    before = np.where(np.diff(offsets) > 1, data[np.maximum(offsets[1:] - 2, 0)], 0).astype(np.uint32)
    return ((before * np.uint32(256) + last) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """word and n over all rows of texts; every batch sends a word once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch["text"])[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

    return texts.select("text").mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_common(counts: DataFrame, most: int) -> int:
    """A count that at most `most` words reach: the lower edge of a sixteenth of a doubling."""
    step = F.floor(F.log2("n") * 16)
    held = 0
    least = None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        held += r.words
        if held > most:
            break
        least = r.least
    return least if least is not None else 1 << 62


@dataclass
class Vocabulary:
    """Common words with their counts, the first OWN_SYMBOLS of which are symbols; for each
    class the logarithm of what the counts of its words sum to; totals."""

    words: pa.Array
    counts: np.ndarray
    own: int
    class_logs: np.ndarray
    shares: np.ndarray  # of the symbols
    tokens: int
    log_total: float
    end_count: int

    @property
    def symbols(self) -> int:
        return 1 + self.own + CLASSES


def build_vocabulary(counts: DataFrame, n_docs: int, broadcast_words: int = BROADCAST_WORDS, own_symbols: int = OWN_SYMBOLS) -> tuple[Vocabulary, int]:
    """The vocabulary of counted words, and the count from which words are broadcast."""
    least = least_common(counts, broadcast_words)
    common = counts.filter(F.col("n") >= least).toArrow()
    common = common.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    words = common["word"].combine_chunks().cast(pa.large_string()) if len(common) else pa.array([], pa.large_string())
    n = common["n"].to_numpy().astype(np.int64)
    own = min(own_symbols, len(n))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            at = word_class(batch["word"])
            np.add.at(total, at, batch["n"].to_numpy())
            kinds += np.bincount(at, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(kinds)], names=["class", "n", "words"])

    total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.filter(F.col("n") < least).select("word", "n").mapInArrow(by_class, "class long, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        total[r["class"]], kinds[r["class"]] = r.n, r.words
    if own < len(n):
        at = word_class(words.slice(own))
        total += np.bincount(at, weights=n[own:], minlength=CLASSES)
        kinds += np.bincount(at, minlength=CLASSES)
    summed, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, different = summed + n_docs, different + (n_docs > 0)
    held = total + ADDED * (kinds + 1)
    shares = np.concatenate([[n_docs + ADDED], n[:own] + ADDED, held])
    return Vocabulary(words, n, own, np.log10(held), shares / shares.sum(), tokens, math.log10(tokens + ADDED * (different + 1)), n_docs), least


def encode(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """row, doc_id, learn, n_tokens, n_known, base, within, symbols and rare of every document.

    symbols are the text's, with the end.  base sums the logarithms of the counts of words
    whose counts are known here, and within what classes give to their words; rare has the
    other words with how often the text has them, whose counts both sums still lack.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], docs.schema["learn"], *T.StructType.fromDDL("n_tokens long, n_known long, base double, within double, symbols binary, rare array<struct<word:string,n:long>>")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = sent.value, TaskContext.get().partitionId() << 33
        logs = np.log10(v.counts + ADDED)
        end_log = math.log10(v.end_count + ADDED)
        for batch in _slices(batches, SLICE):
            docs_here = len(batch)
            words, owner = words_of(batch["text"])
            coded = words.dictionary_encode()
            kinds, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = pc.fill_null(pc.index_in(kinds, v.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            classes = word_class(kinds)
            own = (place >= 0) & (place < v.own)
            symbol = np.where(own, place + 1, 1 + v.own + classes)
            log = np.where(place >= 0, logs[place] if len(logs) else 0.0, 0.0)
            within = np.where(own, 0.0, log - v.class_logs[classes])
            n_words = np.bincount(owner, minlength=docs_here)
            ends = np.cumsum(n_words + 1)
            symbols = np.full(len(at) + docs_here, END, dtype="<u2")
            symbols[np.arange(len(at)) + owner] = symbol[at]
            starts = np.concatenate([[0], ends[:-1]])
            raw = pa.py_buffer(symbols.tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), docs_here, [None, pa.py_buffer(np.concatenate([2 * starts, 2 * ends[-1:]]).astype(np.int64).tobytes()), raw]).cast(pa.binary())
            missing = np.flatnonzero(place[at] < 0)
            pairs, often = np.unique(owner[missing] * (len(kinds) + 1) + at[missing], return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(pairs // (len(kinds) + 1), minlength=docs_here))])
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([kinds.take(pa.array(pairs % (len(kinds) + 1))).cast(pa.string()), pa.array(often)], names=["word", "n"]))
            sums = [np.bincount(owner, weights=x[at], minlength=docs_here).astype(float) for x in ((place >= 0).astype(float), log, within)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + docs_here)), batch["doc_id"], batch["learn"], pa.array(n_words + 1), pa.array(sums[0].astype(np.int64) + (v.end_count > 0)), pa.array(sums[1] + end_log), pa.array(sums[2]), packed, rare],
                names=schema.names,
            )
            row += docs_here

    return docs.select("doc_id", "learn", "text").mapInArrow(scan, schema)


def rare_sums(encoded: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """row, rare_log and rare_known: what the words that are not broadcast add to a document.

    None of them has more than a BROADCAST_WORDS-th of all training tokens, and a document
    sends each once, so no word has many of the rows; what repeats far more in documents that
    are not learned from is for the engine's skewed joins.
    """
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("often"))
    met = rare.join(counts.filter(F.col("n") < least), "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))
    return met.groupBy("row").agg(F.sum(log * F.col("often")).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("often")).otherwise(0)).alias("rare_known"))


class _Stretches:
    """Texts cut into stretches, longest first, laid out by step."""

    def __init__(self, texts: list[np.ndarray]):
        cuts = [(i, s) for i, t in enumerate(texts) for s in range(0, len(t), STRETCH)]
        size = np.array([min(STRETCH, len(texts[i]) - s) for i, s in cuts])
        order = np.argsort(-size, kind="stable")
        self.size, self.owner = size[order], np.array([cuts[j][0] for j in order])
        self.first = np.array([cuts[j][1] == 0 for j in order])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.chains: dict[int, list[int]] = {}
        for j, (i, _) in enumerate(cuts):
            if len(texts[i]) > STRETCH:
                self.chains.setdefault(i, []).append(int(place[j]))
        self.steps = int(self.size[0]) if len(cuts) else 0
        #: how many stretches reach each step, and where the step's symbols begin
        self.active = np.searchsorted(-self.size, -np.arange(self.steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        self.symbols = np.empty(self.offset[-1], dtype=np.int64)
        for j, n in zip(order, self.size, strict=True):
            i, s = cuts[j]
            self.symbols[self.offset[:n] + place[j]] = texts[i][s : s + n]

    def at(self, t: int) -> slice:
        return slice(self.offset[t], self.offset[t + 1])


def _ahead(part: _Stretches, model: Model, chosen: np.ndarray) -> np.ndarray:
    """For each chosen stretch (in order) the matrix that takes the states' weights before its
    first symbol to those before the symbol after its last, up to a factor."""
    states = len(model.start)
    scaled = model.emits / model.emits.mean(1)[:, None]
    moved = np.tile(np.eye(states), (len(chosen), 1, 1))
    for t in range(part.steps):
        n = int(np.searchsorted(chosen, part.active[t]))
        if not n:
            break
        seen = moved[:n] * scaled[part.symbols[part.offset[t] + chosen[:n]]][:, None, :]
        if t % RESCALED == RESCALED - 1:
            seen /= seen.sum((1, 2), keepdims=True)
        moved[:n] = (seen.reshape(-1, states) @ model.moves).reshape(n, states, states)
    return moved / moved.sum((1, 2), keepdims=True)


def _borders(part: _Stretches, model: Model) -> tuple[np.ndarray, dict]:
    """What comes in to each stretch, and the weights that follow stretches within long texts."""
    states = len(model.start)
    enter, after = np.tile(model.start, (len(part.size), 1)), {}
    if part.chains:
        chosen = np.array(sorted(j for chain in part.chains.values() for j in chain))
        moved = dict(zip(chosen.tolist(), _ahead(part, model, chosen), strict=True))
        for chain in part.chains.values():
            for j, k in zip(chain, chain[1:], strict=False):
                step = enter[j] @ moved[j]
                enter[k] = step / step.sum()
            behind = np.ones(states)
            for j, k in zip(chain[-2::-1], chain[:0:-1], strict=True):
                behind = moved[k] @ behind
                behind /= behind.sum()
                after[j] = behind
    return enter, after


def _forward(part: _Stretches, model: Model) -> np.ndarray:
    """Natural logarithm of each stretch's probability given what is before it."""
    level = model.emits.mean(1)
    scaled, ones = model.emits / level[:, None], np.ones(len(model.start))
    owner = np.concatenate([np.arange(n) for n in part.active]) if part.steps else np.zeros(0, dtype=np.int64)
    logs = np.bincount(owner, weights=np.log(level)[part.symbols], minlength=len(part.size))
    now, seen = _borders(part, model)[0], np.empty((len(part.size), len(model.start)))
    for t in range(part.steps):
        n = part.active[t]
        rows = np.take(scaled, part.symbols[part.at(t)], axis=0, out=seen[:n], mode="clip")
        rows *= now[:n]
        if t % RESCALED == RESCALED - 1 or t + 1 == part.steps or part.active[t + 1] < n:
            total = rows @ ones
            logs[:n] += np.log(total)
            rows /= total[:, None]
        np.matmul(rows, model.moves, out=now[:n])
    return logs


def log_probabilities(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the probability of each sequence of symbols."""
    out = np.zeros(len(texts))
    for chosen in _blocks(texts):
        part = _Stretches([texts[i] for i in chosen])
        found = _forward(part, model)
        out[chosen] = np.bincount(part.owner, weights=found, minlength=len(chosen)) / math.log(10)
    return out


def _blocks(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of texts of like length that have HELD symbols together, or of one text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    at, held = 0, np.cumsum(sizes[order])
    while at < len(order):
        upto = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + HELD, side="right")))
        yield order[at:upto]
        at = upto


def expected_counts(texts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions over the texts, and their log10 probability.

    Emissions are divided by each symbol's mean over the states, so weights stay near 1 and
    are rescaled only every RESCALED steps; going back by the same factors leaves the products
    of both directions' weights summing to 1, so no step is normed by itself.
    """
    start, total = np.zeros_like(model.start), 0.0
    met, emits = np.zeros_like(model.moves), np.zeros_like(model.emits)
    states, back, ones = len(model.start), np.ascontiguousarray(model.moves.T), np.ones(len(model.start))
    level = model.emits.mean(1)
    scaled, level = model.emits / level[:, None], np.log(level)
    moves = np.zeros_like(model.moves)
    for chosen in _blocks(texts):
        part = _Stretches([texts[i] for i in chosen])
        now, after = _borders(part, model)
        held, seen, factors = np.empty((len(part.symbols), states)), np.empty((len(part.size), states)), {}
        total += level[part.symbols].sum()
        for t in range(part.steps):
            n, here = part.active[t], part.at(t)
            rows = np.take(scaled, part.symbols[here], axis=0, out=held[here], mode="clip")
            rows *= now[:n]
            if t % RESCALED == RESCALED - 1:
                factors[t] = rows @ ones
                rows /= factors[t][:, None]
                total += np.log(factors[t]).sum()
            np.matmul(rows, model.moves, out=now[:n])
        behind = np.ones((len(part.size), states))
        for j, weights in after.items():
            behind[j] = model.moves @ weights
            last = held[part.offset[part.size[j] - 1] + j]
            pair = last[:, None] * model.moves * weights
            moves += pair / pair.sum()
        for t in range(part.steps - 1, -1, -1):
            n, here = part.active[t], part.at(t)
            rows, ended = held[here], 0 if t + 1 == part.steps else part.active[t + 1]
            if ended < n:
                total += np.log(rows[ended:] @ ones).sum()
                behind[ended:n] /= (rows[ended:] * behind[ended:n]).sum(1, keepdims=True)
            if t:
                ahead = np.take(scaled, part.symbols[here], axis=0, out=seen[:n], mode="clip")
                ahead *= behind[:n]
                if t in factors:
                    ahead /= factors[t][:, None]
                met += held[part.at(t - 1)][:n].T @ ahead
                rows *= behind[:n]
                np.matmul(ahead, back, out=behind[:n])
            else:
                rows *= behind[:n]
                start += rows[part.first[:n]].sum(0)
        for k in range(states):
            emits[:, k] += np.bincount(part.symbols, weights=held[:, k], minlength=len(emits))
    return start, moves + model.moves * met, emits, total / math.log(10)


def first_model(shares: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """States that differ by chance: what tells them apart is learned."""
    rng = np.random.default_rng(seed)
    emits = shares[:, None] * rng.gamma(2.0, 0.5, (len(shares), states))
    moves = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def improved(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Model:
    start, moves = start + ADDED, moves + ADDED
    emits = emits + PRIOR * shares[:, None]
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def learn_round(sequences: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One round of Baum-Welch over the rows' symbols.

    A task sends its expected counts once, a row for each start, move and symbol it met; they
    are summed as whole numbers and only their sums, of fixed size, reach the driver.
    """
    states, spark = len(model.start), sequences.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(states)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, None
        used = sent.value

        def add():
            nonlocal total
            found = expected_counts(held, used)[:3]
            total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))

        for batch in batches:
            for data in batch["symbols"]:
                held.append(np.frombuffer(data.as_buffer(), dtype="<u2"))
                size += len(held[-1])
                if size >= GATHERED:
                    add()
                    held, size = [], 0
        if held:
            add()
        if total is not None:
            table = np.rint(np.vstack([total[0][None], total[1], total[2]]) / GRAIN).astype(np.int64)
            met = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(table[met, k]) for k in range(states))], names=["place", *names])

    found = sequences.select("symbols").mapInArrow(scan, "place long, " + ", ".join(f"{c} long" for c in names))
    sums = found.groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    table = np.zeros((1 + states + len(shares), states))
    table[sums["place"].to_numpy()] = np.column_stack([sums[c].to_numpy() for c in names]) * GRAIN
    sent.unpersist()
    return improved(table[0], table[1 : 1 + states], table[1 + states :], shares)


def train(learned: DataFrame, n_docs: int, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: every round goes over all rows."""
    model = first_model(shares, states)
    for _ in range(rounds if n_docs else 0):
        model = learn_round(learned, model, shares)
    return model


def text_log(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded without symbols and rare, with the log10 probability of the symbols as chain."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in encoded.schema if f.name not in ("symbols", "rare")]
    schema = T.StructType([*kept, T.StructField("chain", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch["symbols"]]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(log_probabilities(texts, sent.value))], names=schema.names)

    return encoded.select(*(f.name for f in kept), "symbols").mapInArrow(scan, schema)


def score_texts(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", states: int = STATES, broadcast_words: int = BROADCAST_WORDS, own_symbols: int = OWN_SYMBOLS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows for which `learn` is true (null: false) are learned from.  Tokens are the words and
    one end.  n_known counts tokens that the learned rows have; base_score is the text's log10
    probability by single tokens and score that by the model, which spreads over all words and
    one unknown word a class.  Null and empty texts are an end alone; very long ones are scored
    whole, in stretches; repeated rows count each; nothing learned leaves one symbol a class.
    An empty table gives no rows.  Other columns of docs are not used.
    """
    every = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learned = every.filter("learn")
    counts = saved(count_words(learned), "words")
    n_docs = learned.count()
    known, least = build_vocabulary(counts, n_docs, broadcast_words, own_symbols)
    encoded = saved(encode(every, known), "symbols")
    model = train(encoded.filter("learn").select("row", "symbols"), n_docs, known.shares, states, rounds)
    out = text_log(encoded, model).join(rare_sums(encoded, counts, least), "row", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id", F.col("learn").alias("learned"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * F.lit(known.log_total)).alias("base_score"), (F.col("chain") + F.col("within") + rare).alias("score"),
    )
