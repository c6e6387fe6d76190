"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's potential reads its own features and those of the
lines around it; neighbouring labels have potentials of their own.  Forward-backward gives
each line's probability of being good, and their mean by line length, through a logistic
step fitted on the same labelled documents, is the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, least_hashed, saved

#: The sample the model is fitted on: documents at most, and the load (characters, and
#: LINE_LOAD for each line) with which it ends, the document that passes it included.
TRAIN_DOCUMENTS, TRAIN_LOAD, LINE_LOAD = 4000, 32_000_000, 64
#: Lines of one stretch.  Chains are whole documents; their stretches advance side by side.
STRETCH = 64
STEPS, RATE, WEIGHT_DECAY = 250, 0.05, 1e-3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[#*$%&|<>=^~\\{}\[\]]")
_DIGIT = re.compile(r"[0-9]")
N_FEATURES = 13


def line_features(lines: list[str]) -> np.ndarray:
    """Features of each line by itself, in small comparable ranges."""
    out, seen = np.zeros((len(lines), N_FEATURES)), set()
    for i, line in enumerate(lines):
        words = _WORD.findall(line)
        chars, n = len(line), len(words)
        if not n:
            out[i, 0] = 1
            continue
        letters = sum(map(str.isalpha, line)) or 1
        uppers = sum(map(str.isupper, line))
        marks, long = len(_MARK.findall(line)), sum(len(w) for w in words)
        out[i, 1:] = (
            math.log1p(n) / 5, n < 4, long / n / 10, letters / chars, uppers / letters, marks / n, line.count("!") / n,
            len(_DIGIT.findall(line)) / chars, len(set(words)) / n, line in seen, line.rstrip()[-1] in ".?!:;", math.log1p(max(map(len, words))) / 5,
        )
        seen.add(line)
    return out


def with_neighbours(own: np.ndarray, document: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it, and the document's log length."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.hstack([own, before, after, np.broadcast_to(document, (len(own), len(document)))])


def document_matrix(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines; one empty line for an empty text."""
    lines = text.split("\n")
    lengths = np.array([len(x) for x in lines], dtype=float)
    size = np.array([math.log1p(lengths.sum()) / 10, math.log1p(len(lines)) / 5, 1.0])
    return with_neighbours(line_features(lines), size), lengths


def marginals(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability that each line is good.

    emit: log potential of good over bad per line; move[a, b]: of label b after a.  Messages
    are kept as log odds, so the pass is two scalars a line whatever the document's length.
    """
    (bb, bg), (gb, gg) = move.tolist()

    def log_sum(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    n, values = len(emit), emit.tolist()
    ahead, back = [0.0] * n, [0.0] * n
    odds = 0.0
    for i in range(n):
        if i:
            odds = log_sum(odds + gg, bg) - log_sum(odds + gb, bb)
        odds += values[i]
        ahead[i] = odds
    odds = 0.0
    for i in range(n - 2, -1, -1):
        odds += values[i + 1]
        odds = log_sum(odds + gg, gb) - log_sum(odds + bg, bb)
        back[i] = odds
    total = np.clip(np.array(ahead) + np.array(back), -40, 40)
    return 1 / (1 + np.exp(-total))


@dataclass
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    slope: float
    offset: float

    def aggregate(self, features: np.ndarray, lengths: np.ndarray) -> float:
        """Log odds of the mean marginal, weighted by line length."""
        p = marginals(((features - self.mean) / self.scale) @ self.weights, self.move)
        weight = lengths + 1
        share = float(np.clip((p * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6))
        return math.log(share / (1 - share))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-np.clip(self.slope * self.aggregate(*document_matrix(text or "")) + self.offset, -40, 40)))


@dataclass
class Chains:
    """Chains of lines cut into stretches, laid out so that all stretches advance together.

    Lines are ordered by place in their stretch, and by stretch, the longest first, within a
    place.  What enters a stretch is worked out from the 2 x 2 transfers of the stretches
    before it, so the sums are those of whole chains.
    """

    order: np.ndarray  # line of each slot
    chain: np.ndarray  # chain of each slot
    before: np.ndarray  # slot of the line before in the chain, -1 for a chain's first
    alive: np.ndarray  # stretches that have a line at each place
    edge: np.ndarray  # first slot of each place, and the number of slots
    last: np.ndarray  # last slot of each stretch
    ends: np.ndarray  # last stretch of each chain
    joined: np.ndarray  # stretches of the chains that have several
    turns: list[tuple[np.ndarray, np.ndarray]]  # among these by place in the chain: (stretches, those before them)

    @classmethod
    def of(cls, sizes: np.ndarray, stretch: int = STRETCH) -> Chains:
        cuts = -(-sizes // stretch)
        chain = np.repeat(np.arange(len(sizes)), cuts)
        turn = np.arange(len(chain)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        n = np.minimum(stretch, sizes[chain] - turn * stretch)
        start = (np.cumsum(sizes) - sizes)[chain] + turn * stretch
        rank = np.argsort(-n, kind="stable")
        place = np.argsort(rank, kind="stable")
        alive = np.array([int((n > t).sum()) for t in range(int(n.max()))])
        order = np.concatenate([start[rank[:k]] + t for t, k in enumerate(alive)])
        slot = np.argsort(order, kind="stable")
        first = np.zeros(len(order), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        before = np.where(first[order], -1, slot[np.maximum(order - 1, 0)])
        joined = np.sort(place[cuts[chain] > 1])
        at = lambda k, back: np.searchsorted(joined, place[np.flatnonzero((turn == k) & (cuts[chain] > 1)) - back])
        turns = [(at(k, 0), at(k, 1) if k else at(k, 0)) for k in range(int(cuts.max()))] if len(joined) else []
        return cls(order, np.concatenate([chain[rank[:k]] for k in alive]), before, alive, np.concatenate([[0], np.cumsum(alive)]), slot[(start + n - 1)[rank]], place[np.cumsum(cuts) - 1], joined, turns)

    def sums(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ahead, back, total): log sums over the labels of the lines up to each slot, and
        of those after it, by its label; and over all labels of each chain.

        emit: log potential of good over bad by slot; move[a, b]: of label b after a.
        """
        ahead, back = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
        ahead[: self.alive[0], 1] = emit[: self.alive[0]]
        if len(self.joined):
            heads = ahead[self.joined]
            begin = self.turns[0][0]
            transfer = heads[:, None, :] + move
            transfer[begin] -= move
            mine = np.searchsorted(self.joined, self.alive)
            for t in range(1, len(self.alive)):
                k = mine[t]
                transfer[:k] = np.logaddexp(transfer[:k, :, :1] + move[0], transfer[:k, :, 1:] + move[1])
                transfer[:k, :, 1] += emit[self.edge[t] + self.joined[:k], None]
            end, after = transfer[:, 0].copy(), np.zeros_like(heads)
            for here, prior in self.turns[1:]:
                heads[here] += np.logaddexp(end[prior, :1] + move[0], end[prior, 1:] + move[1])
                end[here] = np.logaddexp(end[prior, :1] + transfer[here, 0], end[prior, 1:] + transfer[here, 1])
            for here, prior in self.turns[:0:-1]:
                after[prior] = np.logaddexp(transfer[here, :, 0] + after[here, :1], transfer[here, :, 1] + after[here, 1:])
            ahead[self.joined], back[self.last[self.joined]] = heads, after
        for t in range(1, len(self.alive)):
            k, at = self.alive[t], self.edge[t]
            p = ahead[self.edge[t - 1] : self.edge[t - 1] + k]
            ahead[at : at + k] = np.logaddexp(p[:, :1] + move[0], p[:, 1:] + move[1])
            ahead[at : at + k, 1] += emit[at : at + k]
        for t in range(len(self.alive) - 2, -1, -1):
            k, at = self.alive[t + 1], self.edge[t + 1]
            g = back[at : at + k].copy()
            g[:, 1] += emit[at : at + k]
            back[self.edge[t] : self.edge[t] + k] = np.logaddexp(move[:, 0] + g[:, :1], move[:, 1] + g[:, 1:])
        end = ahead[self.last[self.ends]]
        return ahead, back, np.logaddexp(end[:, 0], end[:, 1])


def slopes(chains: Chains, x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over chains of weight times the log likelihood of all lines having the chain's label
    (weight and y by chain, x by slot), and its slopes by w and by move."""
    emit = x @ w
    ahead, back, total = chains.sums(emit, move)
    of = chains.chain
    good = np.exp(ahead[:, 1] + back[:, 1] - total[of])
    slope_w = ((y[of] - good) * weight[of]) @ x
    linked = np.flatnonzero(chains.before >= 0)
    prior, c = chains.before[linked], of[linked]
    slope_t = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            joint = np.exp(ahead[prior, a] + move[a, b] + b * emit[linked] + back[linked, b] - total[c])
            slope_t[a, b] = (((y[c] == a) & (a == b)) * weight[c]).sum() - (joint * weight[c]).sum()
    held = np.bincount(of, weights=emit, minlength=len(y)) * y + np.bincount(c, weights=move[y[c], y[c]], minlength=len(y))
    return float(((held - total) * weight).sum()), slope_w, slope_t


def fit(texts: list[str], labels: list[int]) -> LineModel:
    """Maximise the conditional likelihood of the lines' labels, each line having its document's.

    Documents weigh alike whatever their number of lines, and a document is one chain.
    """
    width = 3 * N_FEATURES + 3
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return LineModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, math.log(share / (1 - share)))
    built, label = [document_matrix(t) for t in texts], np.array(labels)
    sizes = np.array([len(b[1]) for b in built])
    chains = Chains.of(sizes)
    rows = np.vstack([b[0] for b in built])
    mean, scale = rows.mean(0), rows.std(0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    scale[-1] = 1.0
    x = ((rows - mean) / scale).astype(np.float32)[chains.order]
    del rows
    share = len(built) / 2 / np.maximum(1, np.bincount(label, minlength=2))
    weight = share[label] ** 0.5 / sizes / len(built)
    w, move = np.zeros(width), np.zeros((2, 2))
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)
    for step in range(1, STEPS + 1):
        _, slope_w, slope_t = slopes(chains, x, label, weight, w, move)
        slope_w = slope_w - WEIGHT_DECAY * w
        slope_t = slope_t - 0.1 * move
        for value, slope, f1, f2 in ((w, slope_w, m1, m2), (move, slope_t, t1, t2)):
            f1 *= 0.9
            f1 += 0.1 * slope
            f2 *= 0.99
            f2 += 0.01 * slope**2
            value += RATE * (f1 / (1 - 0.9**step)) / (np.sqrt(f2 / (1 - 0.99**step)) + 1e-8)
    model = LineModel(mean, scale, w, move, 1.0, 0.0)
    z, y = np.array([model.aggregate(f, size) for f, size in built]), label
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((y - p) * z).sum() - 0.01 * a, (y - p).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return LineModel(mean, scale, w, move, max(a, 1e-3), b)


def train_on(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "label", documents: int = TRAIN_DOCUMENTS, load: int = TRAIN_LOAD) -> LineModel:
    """Fit on whole texts of at most `documents` labelled ids, those of the least id hash.

    labels has an id and a 0/1 label a row.  The ids of the sample are few and broadcast, so
    no text is shuffled but the sample's.  By hash of id and text the sample goes on until
    its load passes `load`, so that is what the driver holds, and one text.  Null texts count
    as empty; ids with both labels teach both; rows equal in id, label and text teach once;
    without labels or with one kind of them every document gets the same score.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).distinct()
    chosen = least_hashed(chosen, documents, "__id", "y")
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select("__id", "y", F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("__id", "t")).groupBy("h", "__id", "y").agg(F.first("t").alias("t"))
    rows = saved(rows, "labelled")
    line_feeds = F.length("t") - F.length(F.replace("t", F.lit("\n")))
    ordered = rows.select("h", "__id", "y", (F.length("t") + LINE_LOAD * (1 + line_feeds)).alias("load")).orderBy("h", "__id", "y").limit(documents).collect()
    before = np.cumsum([0] + [r.load for r in ordered])[: len(ordered)]
    taken = [r for r, sum_before in zip(ordered, before, strict=True) if sum_before < load]
    found = rows.filter(F.col("h") <= taken[-1].h).select("h", "__id", "y", "t").orderBy("h", "__id", "y").limit(len(taken)).collect() if taken else []
    dropped(rows)
    return fit([r.t for r in found], [r.y for r in found])


def score_documents(docs: DataFrame, model: LineModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from the threshold on) to every row.

    Null text is scored as an empty one.  Columns that clash are replaced.
    """
    docs = docs.drop(*(c for c in ("score", "predicted") if c != text))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype=float)

    out = docs.withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
