"""Personal data: fixed patterns, then bootstrapped contextual extraction.

What the fixed patterns find are the seeds.  The words around seeds induce lexical patterns;
patterns and the identifiers seen in them form a graph whose two sides score each other in
turns; identifiers that no fixed pattern knows are taken where confident patterns hold them.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, hot_join, saved

#: The four kinds in their order, and their patterns.  A match can only begin
#: where the last one ended (\\G) or where no character of its first class stands before;
#: elsewhere it would fail again.  With possessive groups a text is then read once.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be an identifier: digits in groups, and addresses that spell their @ or dots.
OTHER = (
    r"[0-9](?<![0-9A-Za-z][0-9])(?:(?:\[\.\]|[().\x20/-]{0,2})[0-9])++"
    r"|[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?)[A-Za-z0-9-]++)*+"
)
OTHER_DIGITS = 7
#: Rounds of scoring; different known identifiers a pattern needs; the confidence from which
#: a pattern counts and an identifier is taken; characters on either side within which the
#: words of a pattern lie whole.
ROUNDS, LEAST_KNOWN, LEAST_CONFIDENCE, CONTEXT = 3, 4, 0.8, 60
#: What an unknown identifier that may be of a kind weighs against a pattern of that kind: less
#: than 1 / LEAST_CONFIDENCE - 1, so that a pattern counts where half of what it holds is known.
UNKNOWN = 0.2
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _found(text: Column, pattern: str, possible: Column) -> Column:
    return F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _spans(text: Column, pattern: str, found: Column, kind: str | None) -> Column:
    """Matches with their places: a match starts where all gaps and matches before it end."""
    gaps = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        value = F.get(found, i)
        end = start + F.length(value)
        one = F.struct(F.lit(kind).cast("string").alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    placed = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, step)["out"]
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False)))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & F.coalesce(F.call_function("luhn_check", _digits(value)), F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _valid_value(kind: str):
    return lambda value: _valid(kind, value)


def _valid_span(kind: str):
    return lambda span: _valid(kind, span["value"])


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def _forms(value: Column) -> Column:
    """The kinds whose loose form a value has; no pattern can make it one of another kind."""
    digits = F.length(_digits(value))
    address = value.rlike(r"at[\])]")
    parts = F.filter(F.split(value, "[^0-9]+"), lambda p: p != "")
    dotted = value.rlike(r"^[0-9]+(?:\[\.\]|[.\x20-])[0-9]") & (F.size(parts) == 4) & F.forall(parts, lambda p: F.length(p) <= 3)
    fits = {"email": address, "ip": ~address & dotted, "card": ~address & digits.between(12, 19), "phone": ~address & digits.between(OTHER_DIGITS, 15)}
    return F.array_compact(F.array(*(F.when(fits[k], F.lit(k)) for k in KINDS)))


def _with_context(text: Column, span: Column) -> Column:
    """A span with its key, the kinds it may be of and the lexical patterns around it: two
    words before, one before and one after, the word before with its mark.  Words that do
    not lie whole within CONTEXT characters make no pattern."""
    from_start, to_end = span["start"] <= CONTEXT, span["end"] + CONTEXT >= F.length(text)
    left = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))))
    left = F.when(from_start, F.concat(F.lit(" "), left)).otherwise(left)
    right = F.lower(F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
    right = F.when(to_end, F.concat(right, F.lit(" "))).otherwise(right)
    two, one = F.regexp_extract(left, r"\s([^\s]+\s+[^\s]+)\s*$", 1), F.regexp_extract(left, r"\s([^\s]+)\s*$", 1)
    after = F.regexp_extract(right, r"^\s*([^\s]+)\s", 1)
    made = F.array(
        F.when(two != "", F.concat(F.lit("<<"), F.regexp_replace(two, r"\s+", " "))),
        F.when((one != "") & (after != ""), F.concat(F.lit("<>"), one, F.lit(" _ "), after)),
        F.when(one.rlike("[:=#]$"), F.concat(F.lit("<"), one)),
    )
    key = F.lower(F.regexp_replace(span["value"], r"[\s().+/\[\]-]+", ""))
    may = F.when(span["kind"].isNull(), _forms(span["value"])).otherwise(F.array(span["kind"]))
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), key.alias("key"), may.alias("may"), F.array_compact(made).alias("patterns"))


def scanned(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """__id, __mark, base (valid spans by kind and start) and seen (all spans in context)."""
    t = F.col("__t")
    frame = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__mark"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    frame = frame.withColumn("__digit", t.rlike("[0-9]"))
    possible = {"email": F.contains(t, F.lit("@")), "ip": F.col("__digit") & t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": F.col("__digit"), "phone": F.contains(t, F.lit("+"))}
    frame = frame.withColumns({f"m_{k}": _found(t, PATTERNS[k], possible[k]) for k in KINDS} | {"m_other": _found(t, OTHER, F.col("__digit") | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)")))})
    # matches that fail are known by themselves; places are worked out only where one holds
    holds = {k: F.exists(f"m_{k}", _valid_value(k)) for k in KINDS}
    long = F.exists("m_other", lambda v: (F.length(_digits(v)) >= OTHER_DIGITS) | v.contains("at"))
    none = F.array().cast(_SPAN)
    frame = frame.withColumns({f"s_{k}": F.when(holds[k], F.filter(_spans(t, PATTERNS[k], F.col(f"m_{k}"), k), _valid_span(k))).otherwise(none) for k in KINDS} | {"s_other": F.when(long, _spans(t, OTHER, F.col("m_other"), None)).otherwise(none)})
    frame = frame.withColumn("base", F.concat(*(f"s_{k}" for k in KINDS)))
    free = F.filter("s_other", lambda o: ((F.length(_digits(o["value"])) >= OTHER_DIGITS) | o["value"].contains("at")) & ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    frame = frame.withColumn("free", free)
    seen = F.when(F.size("base") + F.size("free") > 0, F.transform(F.concat("base", "free"), lambda s: _with_context(t, s)))
    return frame.select("__id", "__mark", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"), seen.alias("seen"))


def discover(seen: DataFrame, rounds: int = ROUNDS, least_known: int = LEAST_KNOWN, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """key and kind of the identifiers taken beyond the seeds.

    seen: key, kind (null: unknown), pattern and may (the kinds a key may be of) of every
    occurrence.  A pattern's confidence in a kind is the score of its known identifiers of
    the kind over that of all its known ones, the number of unknown ones that cannot be of
    the kind, UNKNOWN of those that can, and one.  An identifier's score for a kind it may be
    of is one less the chance that all its counted patterns are wrong, and it is taken for
    its best kind.  Both sides count different identifiers, so copies weigh nothing.
    What a round finds counts in the next one's patterns, whatever seeds these began with.
    Unknown occurrences of seeds are judged like others.  Patterns and identifiers with many
    edges are joined as hot keys.
    """
    edges = saved(seen.groupBy("pattern", "key").agg(F.max("kind").alias("kind"), F.array_distinct(F.flatten(F.collect_set("may"))).alias("may")), "edges")
    n = edges.count()
    # no score is above 1, so a pattern of fewer identifiers never has the mass
    totals = edges.groupBy("pattern").agg(F.count("*").alias("held")).filter(F.col("held") >= least_known)
    graph = saved(hot_join(edges, totals, ["pattern"], "held", n, ["key"]).filter("held IS NOT NULL"), "graph")
    degrees = graph.groupBy("key").agg(F.count("*").alias("met"))
    known = graph.filter("kind IS NOT NULL").groupBy("key").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("score"))
    unseen = graph.filter("kind IS NULL").select("pattern", "key", "may")
    found = None
    for _ in range(rounds):
        pool = known if found is None else known.unionByName(found.join(known.select("key"), "key", "left_anti"))
        scores = pool.join(degrees, "key")
        scored = hot_join(graph.select("pattern", "key", "held", "may"), scores, ["key"], "met", n, ["pattern"])
        unknown = F.col("score").isNull()
        sums = [F.sum("score").alias("all"), F.count(F.when(unknown, 1)).alias("unknown")]
        sums += [F.struct(F.lit(k).alias("kind"), F.sum(F.when(F.col("kind") == k, F.col("score"))).alias("mass"), F.count(F.when(unknown & F.array_contains("may", k), 1)).alias("fit")).alias(f"of_{k}") for k in KINDS]
        by_kind = scored.groupBy("pattern", "held").agg(*sums).select("pattern", "held", "all", "unknown", F.explode(F.array(*(f"of_{k}" for k in KINDS))).alias("of"))
        trust = F.col("of.mass") / (F.col("all") + F.col("unknown") - (1 - UNKNOWN) * F.col("of.fit") + 1)
        strong = by_kind.select("pattern", "held", "of.kind", "of.mass", trust.alias("trust")).filter((F.col("mass") >= least_known) & (F.col("trust") >= least_confidence))
        votes = hot_join(unseen, strong.select("pattern", "kind", "trust", "held"), ["pattern"], "held", n, ["key"]).filter("trust IS NOT NULL AND array_contains(may, kind)")
        votes = votes.groupBy("key", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        best = votes.groupBy("key").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        last, found = found, saved(best.filter(F.col("score") >= least_confidence), "found")
        dropped(*([last] if last else []))
    dropped(edges, graph)
    return found.select("key", "kind")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, base and spans, arrays of (kind, start, end), by kind then start.

    base holds what the fixed patterns find, leftmost first, failing matches dropped; spans
    holds them and what the confident patterns add: candidates of a kind's loose form (digits
    in groups, addresses that spell their signs) that overlap no base span.  Offsets are code points of the whole
    text, the end exclusive.  Null and empty texts have none.  Rows that share id and text
    get the same spans; other rows are told apart by both.  Null ids are kept.
    """
    rows = saved(scanned(docs, text, doc_id), "scanned")
    occurrences = saved(rows.filter("seen IS NOT NULL").select("__id", "__mark", F.explode("seen").alias("s")).select("__id", "__mark", "s.*"), "seen")
    taken = discover(occurrences.select("key", "kind", "may", F.explode("patterns").alias("pattern")))
    unknown = occurrences.filter("kind IS NULL").select("__id", "__mark", "key", "start", "end")
    taken = saved(unknown.groupBy("key").agg(F.count("*").alias("held")).join(taken, "key"), "taken")
    total = taken.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    extra = hot_join(unknown, taken, ["key"], "held", total, ["__id", "__mark", "start"]).filter("kind IS NOT NULL").groupBy("__id", "__mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    joined = rows.select("__id", "__mark", "base").join(extra.withColumnsRenamed({"__id": "i", "__mark": "m"}), F.col("__id").eqNullSafe(F.col("i")) & (F.col("__mark") == F.col("m")), "left")
    place = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    ordered = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(F.try_element_at(place, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("__id").alias("doc_id"), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(ordered).alias("spans"))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans as text."""
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
