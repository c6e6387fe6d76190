"""URL filters: explicit host and path rules, then association rules mined by FP-growth."""

from __future__ import annotations

import itertools
import logging
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, dropped, saved

#: Share and number of labelled URLs a rule must hold in, and how often it must be right.
LEAST_SUPPORT, LEAST_URLS, LEAST_CONFIDENCE = 0.005, 5, 0.9
#: Frequent sets that FP-growth may give at most.  Where the labelled URLs may give more,
#: only sets that can be rules are counted, level by level, so many of them in one job.
MOST_SETS, SET_BLOCK = 1 << 20, 1 << 15
#: Cells of the table of rows by items that a counting task holds at a time.
HELD_CELLS = 1 << 22


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null urls and urls without :// have neither."""
    whole = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; rules are (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path, names in the query.

    Numbers are one token; single labels and words keep which part they come from.
    """
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\?([^#]*)", 1)
    named = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    words = F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "0"), "[^\\p{L}\\p{N}]+", -1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(named("h:", F.split(host, "\\.")), named("p:", words), named("q:", keys)))


@dataclass(frozen=True)
class Rule:
    """A URL that has a token of each of the sets gets the label."""

    sets: frozenset[frozenset[str]]
    label: str
    confidence: float
    support: float

    def text(self) -> str:
        return " ".join(sorted("|".join(sorted(s)) for s in self.sets))


def frequent_items(labelled: DataFrame, tokens: str, label: str, least: int) -> list[tuple[frozenset[str], dict[str, int]]]:
    """(tokens, rows by label) of the items found in at least `least` rows.

    Tokens that always occur together are one item: they have one count and one sum of
    hashes of their rows.  The items are at most the tokens of all rows over `least`.
    """
    rows = labelled.select(F.xxhash64(tokens).alias("h"), F.hash(tokens).alias("g"), F.col(label).alias("label"), F.explode(tokens).alias("token"))
    by_label = rows.groupBy("token", "label").agg(F.count("*").alias("n"), F.sum(F.shiftright("h", 20)).alias("h"), F.sum(F.col("g").cast("long")).alias("g"))
    one = by_label.groupBy("token").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"))
    found: dict[tuple, list] = defaultdict(list)
    for r in one.filter(F.col("n") >= least).collect():
        found[r.n, r.h, r.g, tuple(sorted(r.by.items()))].append(r.token)
    return sorted(((frozenset(names), dict(key[3])) for key, names in found.items()), key=lambda x: sorted(x[0]))


def pruned(rules: list[Rule]) -> list[Rule]:
    """The rules none of whose parts is a rule for the same label as confident; best first."""
    kept: list[Rule] = []
    index: dict[frozenset, list[int]] = defaultdict(list)
    for rule in sorted(rules, key=lambda r: (len(r.sets), -r.confidence, r.text())):
        met = Counter(i for s in rule.sets for i in index[s])
        if not any(n == len(kept[i].sets) and kept[i].label == rule.label and kept[i].confidence >= rule.confidence for i, n in met.items()):
            for s in rule.sets:
                index[s].append(len(kept))
            kept.append(rule)
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, r.text()))


def items_read(sizes: dict[int, int], least: int, most_sets: int) -> int:
    """How many items of a row FP-growth could read: the most of any row, unless rows of `sizes`
    (items: rows) could then have more than most_sets sets in `least` rows each."""
    upto = longest = max([1, *sizes])
    while upto > 1 and sum(n << min(k, upto) for k, n in sizes.items()) > most_sets * least:
        upto -= 1
    if upto < longest:
        logging.getLogger(__name__).warning("sets of up to %d items are counted level by level", longest)
    return upto


def grown(alive: dict[tuple[int, ...], dict[str, int]]) -> Iterator[tuple[int, ...]]:
    """Sets of one item more, all of whose parts of one item less are alive."""
    tails = defaultdict(list)
    for s in sorted(alive):
        tails[s[:-1]].append(s[-1])
    for head, lasts in tails.items():
        for x, y in itertools.combinations(lasts, 2):
            new = (*head, x, y)
            if all(new[:i] + new[i + 1 :] in alive for i in range(len(new) - 2)):
                yield new


def counted(patterns: DataFrame, sets: list[tuple[int, ...]], n_items: int, labels: list[str]) -> dict[tuple[int, ...], dict[str, int]]:
    """Rows by label of each of the sets.  patterns: items, label and n (how many rows are so)."""
    number = {c: i for i, c in enumerate(labels)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((len(sets), len(labels)), dtype=np.int64), max(1, HELD_CELLS // max(n_items, 1))
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.iloc[start : start + rows]
                held, weight = np.zeros((n_items, len(part)), dtype=bool), np.zeros((len(part), len(labels)), dtype=np.int64)
                sizes = part["items"].map(len).to_numpy()
                held[np.concatenate(part["items"].to_numpy()).astype(np.int64), np.repeat(np.arange(len(part)), sizes)] = True
                weight[np.arange(len(part)), part["label"].map(number).to_numpy()] = part["n"].to_numpy()
                head, met = None, None
                for i, s in enumerate(sets):
                    if s[:-1] != head:
                        head, met = s[:-1], held[list(s[:-1])].all(0)
                    at = np.flatnonzero(met & held[s[-1]])
                    if len(at):
                        total[i] += weight[at].sum(0)
        row, col = np.nonzero(total)
        yield pd.DataFrame({"i": row, "label": col, "n": total[row, col]})

    out: dict[tuple[int, ...], dict[str, int]] = defaultdict(dict)
    for r in patterns.mapInPandas(count, "i long, label long, n long").groupBy("i", "label").agg(F.sum("n").alias("n")).collect():
        out[sets[r.i]][labels[r.label]] = r.n
    return out


def rules_by_level(whole: DataFrame, singles: list[dict[str, int]], n: int, least: int, least_confidence: float) -> Iterator[tuple[tuple[int, ...], str, float, float]]:
    """(items, label, confidence, support) of every rule of two items or more that pruned() may keep.

    A set in the same rows as a part of it is as confident as that part, and a set whose rows
    have one label is as confident as any that holds it.  So only sets with no such part are
    counted; all parts of these are such sets too.  Sets are counted over all rows and all
    their items, SET_BLOCK of them in one job; the sets of one level stay on the driver.
    """
    labels = sorted({c for by in singles for c in by})
    patterns = saved(whole.filter(F.size("items") > 1).groupBy("items", "label").agg(F.count("*").alias("n")), "patterns")
    alive = {(i,): by for i, by in enumerate(singles) if max(by.values()) >= least}
    while alive:
        sets, larger = grown(alive), {}
        while block := list(itertools.islice(sets, SET_BLOCK)):
            for s, by in counted(patterns, block, len(singles), labels).items():
                total = sum(by.values())
                if max(by.values()) < least or any(sum(alive[s[:i] + s[i + 1 :]].values()) == total for i in range(len(s))):
                    continue
                yield from ((s, c, k / total, k / n) for c, k in by.items() if k >= least and k >= least_confidence * total)
                if len(by) > 1:
                    larger[s] = by
        alive = larger
    dropped(patterns)


def mine_rules(labelled: DataFrame, tokens: str = "tokens", label: str = "verdict", least_support: float = LEAST_SUPPORT, least_urls: int = LEAST_URLS, least_confidence: float = LEAST_CONFIDENCE, most_sets: int = MOST_SETS) -> list[Rule]:
    """Rules of the labelled rows, best first: the more confident, then the more common.

    A rule holds in at least least_urls rows and a share of least_support of all, and a part
    of it that is as confident for its label takes its place.  So an item whose rows all have
    one label is a rule by itself and part of no other; it is left out of the rows that
    FP-growth reads, the label being one more item of these.  All items of a
    row are read.  Where rows could give more than most_sets frequent sets (a row of k items
    adds to 2 ** k sets at most, and each set needs as many rows as a rule), FP-growth does not
    run, and rules_by_level() counts only those sets that can be rules, which gives the same.
    Rows without a label teach nothing; repeated rows count each; urls may be
    of any length; no rows give no rules.
    """
    mark = "label="
    rows = saved(labelled.filter(F.col(label).isNotNull()).select(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))).alias("tokens"), F.col(label).alias("label")), "labelled")
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    least = max(least_urls, math.ceil(least_support * n))
    if n < least:
        return []
    items = frequent_items(rows, "tokens", "label", least)
    rules = [Rule(frozenset([names]), next(iter(by)), 1.0, sum(by.values()) / n) for names, by in items if len(by) == 1]
    mixed = [(names, by) for names, by in items if len(by) > 1]
    if mixed:
        tells = [sum((by.get(k, 0) - sum(by.values()) * t / n) ** 2 / t for k, t in totals.items()) / sum(by.values()) for _, by in mixed]
        order = sorted(range(len(mixed)), key=lambda i: (-tells[i], i))
        place = {token: at for at, i in enumerate(order) for token in mixed[i][0]}

        @F.pandas_udf("array<int>")
        def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([sorted({place[t] for t in row if t in place}) for row in batch], dtype=object)

        whole = saved(rows.select(told("tokens").alias("items"), "label"), "items")
        sizes = {r.k: r.n for r in whole.groupBy(F.size("items").alias("k")).agg(F.count("*").alias("n")).collect()}
        upto = items_read(sizes, least, most_sets)
        if upto < max(sizes, default=0):
            singles = [mixed[i][1] for i in order]
            rules += [Rule(frozenset([mixed[i][0]]), c, k / sum(by.values()), k / n) for i in order for by in [mixed[i][1]] for c, k in by.items() if k >= least and k >= least_confidence * sum(by.values())]
            rules += [Rule(frozenset(mixed[order[i]][0] for i in s), c, confidence, support) for s, c, confidence, support in rules_by_level(whole, singles, n, least, least_confidence)]
        else:
            named = F.transform("items", lambda x: x.cast("string"))
            read = whole.select(F.concat(named, F.array(F.concat(F.lit(mark), "label"))).alias("items"))
            model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=least_confidence).fit(read)
            for r in model.associationRules.filter(F.col("consequent")[0].startswith(mark)).collect():
                sets = frozenset(mixed[order[int(i)]][0] for i in r.antecedent)
                rules.append(Rule(sets, r.consequent[0][len(mark) :], r.confidence, r.support))
        dropped(whole)
    dropped(rows)
    return pruned(rules)


def matched(frame: DataFrame, rules: list[Rule], tokens: str = "tokens", default: str = "allow") -> DataFrame:
    """Add mined_verdict and mined_rule: the best rule all of whose sets a row has a token of.

    The inverted index maps a token to its item and an item to the rules that need it; a rule
    matches once each of its items has been met.
    """
    numbers = {s: i for i, s in enumerate(sorted({s for r in rules for s in r.sets}, key=sorted))}
    item_of = {t: i for s, i in numbers.items() for t in s}
    index, need = defaultdict(list), [len(r.sets) for r in rules]
    for i, rule in enumerate(rules):
        for s in rule.sets:
            index[numbers[s]].append(i)
    index = dict(index)
    verdicts, texts = [r.label for r in rules], [r.text() for r in rules]

    @F.pandas_udf("struct<mined_verdict: string, mined_rule: string>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch:
                met = Counter(i for item in {item_of[t] for t in (() if row is None else row) if t in item_of} for i in index[item])
                first = min((i for i, n in met.items() if n == need[i]), default=None)
                out.append((default, None) if first is None else (verdicts[first], texts[first]))
            yield pd.DataFrame(out, columns=["mined_verdict", "mined_rule"])

    return frame.withColumn("__b", best(F.col(tokens))).select(*frame.columns, "__b.mined_verdict", "__b.mined_rule")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule, verdict, mined_verdict and mined_rule to every row of pages.

    A fitting explicit rule decides; the urls so decided are the labels from which token
    combinations are mined, and those decide the others; what no rule of either sort fits
    gets `default`.  Null and malformed urls have empty host and path and no tokens.  Repeated
    rows are judged alike.  Columns of pages that clash with the added names are replaced.
    """
    added = ("host", "path", "rule", "verdict", "mined_verdict", "mined_rule")
    pages = pages.drop(*(c for c in added if c != url))
    host, path = host_and_path(F.col(url))
    frame = pages.withColumns({"host": host, "path": path, "__tokens": url_tokens(F.col(url))})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    frame = frame.withColumns({"rule": rule, "verdict": verdict})
    mined = mine_rules(frame.select(F.col("__tokens").alias("tokens"), "verdict"))
    out = matched(frame, mined, "__tokens", default)
    return out.withColumn("verdict", F.coalesce("verdict", "mined_verdict")).drop("__tokens")
