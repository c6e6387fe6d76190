"""Validation of supplementary documents: every violation, and the first in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import PRIMARY_DOC, strip

#: What marks a template, the form of an id, and the limits of texts.
PLACEHOLDER = r"(?iU)<[^<>]{0,120}>|\bTODO\b|\bTBD\b|\.\.\.$|…$"
DOC_ID = "^[a-z0-9][a-z0-9_]{2,63}$"
LEAST_CHARS, MOST_CHARS = 20, 6000
DOC_FIELDS = ("articles", "citation_prefix", "doc_id", "source", "title")
ARTICLE_FIELDS = ("article_number", "book", "chapter", "is_repealed", "section", "source_page", "text_ar", "text_en", "topic")


def _messages(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(said)) for bad, said in rules]))


def violations(docs: DataFrame, reserved: str = PRIMARY_DOC) -> DataFrame:
    """(doc_id, article_at, rule, message) of every broken rule; article_at null: the document.

    docs: doc_id, title, citation_prefix, source, articles (array of structs); absent fields
    are null.  Rules are numbered in the order in which a fail-fast check would meet them.
    """
    doc = _messages(
        [(F.col(c).isNull(), f"missing field {c}") for c in DOC_FIELDS]
        + [
            (~F.col("doc_id").rlike(DOC_ID), "doc_id is not a slug"),
            (F.col("doc_id") == reserved, "doc_id is reserved"),
            (strip(F.col("source")).rlike(PLACEHOLDER) | (strip(F.col("source")) == ""), "source is empty or a placeholder"),
            (strip(F.col("citation_prefix")) == "", "citation_prefix is empty"),
            (F.size("articles") == 0, "articles is empty"),
        ]
    )
    whole = docs.select("doc_id", F.posexplode(doc).alias("rule", "message"), F.lit(None).cast("int").alias("article_at"))
    each = docs.filter(F.col("articles").isNotNull()).select("doc_id", F.transform("articles", lambda a: a["article_number"]).alias("__all"), F.posexplode("articles").alias("article_at", "a"))
    a = F.col("a")
    earlier = F.array_contains(F.slice("__all", F.lit(1), F.col("article_at")), a["article_number"])
    holds = lambda c: strip(a[c]).rlike(PLACEHOLDER)
    article = _messages(
        [(a[c].isNull(), f"missing field {c}") for c in ARTICLE_FIELDS]
        + [
            (a["article_number"] < 1, "article_number is not positive"),
            (earlier, "repeated article_number"),
            (strip(a["text_ar"]) == "", "empty text_ar"),
            (holds("text_ar"), "text_ar is a placeholder"),
            (holds("text_en"), "text_en is a placeholder"),
            (F.length(strip(a["text_ar"])) < LEAST_CHARS, "text_ar is too short"),
            (F.length(a["text_ar"]) > MOST_CHARS, "text_ar is too long"),
            (F.length(a["text_en"]) > MOST_CHARS, "text_en is too long"),
        ]
    )
    parts = each.select("doc_id", "article_at", F.posexplode(article).alias("rule", "message"))
    return whole.unionByName(parts)


def first_violation(found: DataFrame) -> DataFrame:
    """The one a fail-fast check reports: document rules first, then article by article."""
    order = F.struct(F.coalesce("article_at", F.lit(-1)), F.col("rule"))
    return found.groupBy("doc_id").agg(F.min_by("article_at", order).alias("article_at"), F.min_by("message", order).alias("message"))
