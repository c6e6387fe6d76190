"""Spans of personal data by priority, and their redaction, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import luhn, western_digits

#: Entities in order of priority and their patterns.
PATTERNS = {
    "EMAIL": r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "IBAN": r"(?iU)\bEG\d{2}(?:[ ]?\d){25}\b",
    "CREDIT_CARD": r"(?U)(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "EG_NATIONAL_ID": r"(?U)(?<!\d)[23]\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{7}(?!\d)",
    "EG_PHONE": r"(?U)(?<!\d)(?:(?:\+|00)20[ -]?)?0?1[0125](?:[ -]?\d){8}(?!\d)",
}
_SPANS = "array<struct<entity:string,start:int,end:int>>"


def _matches(norm: Column, entity: str) -> Column:
    """(entity, start, end, text) of all matches: gaps between matches give the places."""
    pattern = PATTERNS[entity]
    found, gaps = F.regexp_extract_all(norm, F.lit(pattern), F.lit(0)), F.split(norm, pattern, -1)
    kind = "array<struct<entity:string,start:int,end:int,text:string>>"

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        text = F.get(found, i)
        one = F.struct(F.lit(entity).alias("entity"), start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))
        return F.struct((start + F.length(text)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    seed = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    placed = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), seed, step)["out"]
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast(kind))


def spans(text: Column) -> Column:
    """Spans sorted by start.  An entity of higher priority keeps its characters; a match
    that touches a kept one is dropped whole; failed check digits leave characters free."""
    norm = western_digits(F.coalesce(text, F.lit("")), persian=True)
    possible = {"EMAIL": F.contains(norm, F.lit("@"))}
    every = []
    for entity in PATTERNS:
        found = _matches(norm, entity)
        if entity == "CREDIT_CARD":
            found = F.filter(found, lambda m: luhn(F.regexp_replace(m["text"], r"(?U)\D", "")))
        found = F.transform(found, lambda m: F.struct(m["entity"], m["start"], m["end"]))
        every.append(F.when(possible.get(entity, norm.rlike(r"(?U)\d")), found).otherwise(F.array().cast(_SPANS)))

    def keep(kept: Column, m: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(m)))

    kept = F.aggregate(F.concat(*every), F.array().cast(_SPANS), keep)
    by_start = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"))))
    return F.transform(by_start, lambda s: F.struct(s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end")))


def redact(text: Column, found: Column) -> Column:
    """The original text with [ENTITY] in place of each span (see spans())."""
    seed = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), s["entity"], F.lit("]")).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, seed, step, done))


def entities(found: Column) -> Column:
    """Sorted distinct entity types."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: s["entity"])))
