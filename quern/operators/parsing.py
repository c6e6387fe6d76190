"""Positioned words to lines, lines to articles, articles checked and merged.

Order is data here: every stream carries line_no.  Windows are partitioned by `by` (a
document or language), so many documents parse side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Rows closer than this share a line; the band in which a page may split.
ROW_TOLERANCE, BAND = 3.0, (0.15, 0.85)
MOST_CHARS = 6000


def split_positions(words: DataFrame, width: str = "width", by: tuple[str, ...] = ("page",), resolution: float = 1.0) -> DataFrame:
    """Per page the middle of the widest empty run of x bins within the band.

    The first of equally wide runs wins; a page without an empty bin splits in its middle.
    words: x0, x1 and the page's width on every row.
    """
    lo = F.greatest(F.lit(0), F.floor(F.col("x0") / resolution))
    hi = F.least(F.floor(F.col(width) / resolution), F.floor(F.col("x1") / resolution))
    used = words.withColumns({"__lo": lo, "__hi": hi}).groupBy(*by).agg(F.max(width).alias("__w"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("__lo") <= F.col("__hi"), F.sequence("__lo", "__hi")).otherwise(F.array().cast("array<bigint>"))))).alias("__used"))
    bins = F.filter(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__w") / resolution)), lambda i: (i * resolution >= BAND[0] * F.col("__w")) & (i * resolution <= BAND[1] * F.col("__w")))
    free = used.select(*by, "__w", F.explode_outer(F.array_except(bins, "__used")).alias("bin"))
    run = F.col("bin") - F.row_number().over(Window.partitionBy(*by).orderBy("bin"))
    runs = free.withColumn("run", run).groupBy(*by, "run").agg(F.min("bin").alias("first"), F.count("bin").alias("len"), F.max("__w").alias("w"))
    best = runs.groupBy(*by).agg(F.max_by(F.struct("first", "len"), F.struct("len", -F.col("first"))).alias("b"), F.max("w").alias("w"))
    middle = F.when(F.coalesce(F.col("b.len"), F.lit(0)) > 0, (F.col("b.first") + F.col("b.len") / 2) * resolution).otherwise(F.col("w") / 2)
    return best.select(*by, middle.alias("split_x"))


def cluster_rows(sorted_words: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """Row number of each word of an array sorted by top.  A word joins the open row while it
    is within tolerance of the row's first word."""
    seed = F.struct(F.lit(-1).alias("row"), F.lit(0.0).cast("double").alias("anchor"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, w: Column) -> Column:
        new = (acc["row"] < 0) | (F.abs(w["top"] - acc["anchor"]) > tolerance)
        row = acc["row"] + new.cast("int")
        return F.struct(row.alias("row"), F.when(new, w["top"]).otherwise(acc["anchor"]).alias("anchor"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    return F.aggregate(sorted_words, seed, step)["rows"]


def page_lines(words: DataFrame, width: str = "width", by: tuple[str, ...] = ("page",)) -> DataFrame:
    """Two line streams (lang en, ar) of pages with two columns: by, lang, line_no, text.

    words: page, text, x0, x1, top, glyphs, width and a position `pos`.  The left column
    reads by rising x0, the right one by falling x0 with words in logical order.
    """
    split = split_positions(words, width, by)
    sided = words.join(split, list(by)).withColumn("lang", F.when(F.col("x0") < F.col("split_x"), "en").otherwise("ar"))
    word = F.struct("top", "pos", "x0", "text", "glyphs")
    pages = sided.groupBy(*by, "lang").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    rows = pages.select(*by, "lang", F.explode(F.arrays_zip(F.col("ws"), cluster_rows(F.col("ws")).alias("row"))).alias("z")).select(*by, "lang", F.col("z.row").alias("row"), "z.ws.*")
    reading = F.when(F.col("lang") == "en", F.col("x0")).otherwise(-F.col("x0"))
    said = F.when(F.col("lang") == "ar", T.logical_word(F.col("text"), F.col("glyphs"))).otherwise(F.col("text"))
    lines = rows.groupBy(*by, "lang", "row").agg(F.array_sort(F.collect_list(F.struct(reading.alias("x"), F.col("pos"), said.alias("t")))).alias("o"))
    lines = lines.withColumn("text", T.strip(F.array_join(F.transform("o", lambda w: w["t"]), " "))).filter("text <> ''")
    number = F.row_number().over(Window.partitionBy("lang", *by[:-1]).orderBy(by[-1], "row"))
    return lines.select(*by, "lang", number.cast("long").alias("line_no"), "text")


def carry_levels(lines: DataFrame, levels: dict[str, Column], by: list[str], order: str = "line_no") -> DataFrame:
    """Add one column per level: the last such heading at or before the line.

    levels run from the highest down and hold the heading's text or null.  A heading resets
    all levels below it, so a level is read within the stretch since the last higher one.
    """
    out, higher = lines, None
    for name, value in levels.items():
        out = out.withColumn(f"__{name}", value)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for name in levels:
        keys = list(by)
        if higher is not None:
            out = out.withColumn(f"__s_{name}", F.sum(higher.cast("int")).over(upto))
            keys.append(f"__s_{name}")
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(name, F.coalesce(F.last(f"__{name}", ignorenulls=True).over(w), F.lit("")))
        own = F.col(f"__{name}").isNotNull()
        higher = own if higher is None else higher | own
    return out.drop(*(f"__{n}" for n in levels), *(f"__s_{n}" for n in levels))


def segment(lines: DataFrame, boundary: Column, by: list[str], order: str = "line_no") -> DataFrame:
    """Add segment: how many boundary lines stand at or before the line."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(boundary.cast("int")).over(upto))


def first_stream(lines: DataFrame, by: list[str], topics: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, notices) of the primary-language stream (by, page, line_no, text).

    An article header opens a segment; headings and lines that are repeal notices close it.
    Headers before the first heading are front matter.  A number seen twice keeps its last
    segment and has duplicate true.  notices: lo, hi, text and headings of every range, in a
    line of its own or in an article's body.  topics: article_number, topic to override.
    """
    t = F.col("text")
    number = T.to_int(F.regexp_extract(t, T.ARTICLE_AR, 1))
    notice = t.rlike(T.REPEAL_RANGE) & t.rlike(T.REPEAL_WORD)
    article = ~notice & t.rlike(T.ARTICLE_AR)
    level, taken = {}, notice | article
    for name in T.HEADINGS:
        level[name] = F.when(~taken & T.is_heading(t, name), t)
        taken = taken | T.is_heading(t, name)
    heads = lines.withColumns({"__notice": notice, "__article": article, "__head": taken & ~notice & ~article, "__number": F.when(article, number)})
    upto = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.withColumn("__started", F.max(F.col("__head").cast("int")).over(upto) == 1)
    heads = heads.filter(~F.col("__article") | F.col("__started"))
    heads = segment(heads, F.col("__notice") | F.col("__article") | F.col("__head"), by)
    within = Window.partitionBy(*by, "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.withColumn("__open", F.first("__article").over(within))
    level["topic"] = F.when(~taken & ~F.col("__open") & T.is_topic(t), t)
    heads = carry_levels(heads, level, by)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("__article") & F.col("__open"), F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    first = lambda c: F.min_by(c, "line_no").alias(c)
    opened = heads.filter("__open").groupBy(*by, "segment").agg(F.max("__number").alias("article_number"), T.strip(body).alias("text"), first("page"), first("part"), first("book"), first("chapter"), first("section"), first("topic"))
    opened = opened.withColumn("book", T.book_field(F.col("part"), F.col("book"))).drop("part")
    if topics is not None:
        opened = opened.join(topics.withColumnRenamed("topic", "__topic"), "article_number", "left").withColumn("topic", F.coalesce("__topic", "topic")).drop("__topic")
    latest = Window.partitionBy(*by, "article_number")
    ranked = opened.withColumns({"__last": F.max("segment").over(latest), "duplicate": F.count("*").over(latest) > 1})
    articles = ranked.filter("segment = __last").drop("__last", "segment")
    spoken = heads.filter("__notice").select(*by, "text", "page", T.book_field(F.col("part"), F.col("book")).alias("book"), "chapter", "section", "topic", "line_no")
    inside = opened.filter(F.col("text").rlike(T.REPEAL_RANGE) & F.col("text").rlike(T.REPEAL_WORD)).select(*by, "text", "page", "book", "chapter", "section", "topic", F.lit(None).cast("long").alias("line_no"))
    ends = [T.to_int(F.regexp_extract("text", T.REPEAL_RANGE, i)) for i in (1, 2)]
    notices = spoken.unionByName(inside).withColumns({"lo": ends[0], "hi": ends[1]})
    return articles, notices


def bis_headers(lines: DataFrame) -> DataFrame:
    """Article headers that carry the mark of an inserted article."""
    return lines.filter(F.col("text").rlike(T.ARTICLE_AR) & F.col("text").contains(T.BIS))


def second_stream(lines: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Articles of the second-language stream: by, article_number, text, duplicate.

    Strict headers open a segment.  Loose ones do so only for a number that `known` (by,
    article_number, page) puts on the same page and that no header before has opened; the
    rest of a loose header begins the text.
    """
    t = F.col("text")
    strict = F.regexp_extract(t, T.ARTICLE_EN, 1).try_cast("int")
    loose = F.regexp_extract(t, T.ARTICLE_EN_LOOSE, 1).try_cast("int")
    tagged = lines.withColumns({"__strict": strict, "__loose": F.when(strict.isNull(), loose)})
    pages = known.select(*by, F.col("article_number").alias("__loose"), F.col("page").alias("__page"))
    tagged = tagged.join(pages, [*by, "__loose"], "left")
    possible = F.coalesce("__strict", F.when(F.col("__page") == F.col("page"), F.col("__loose")))
    tagged = tagged.withColumn("__n", possible)
    before = Window.partitionBy(*by, "__n").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("__strict").isNotNull() | (F.col("__n").isNotNull() & (F.coalesce(F.count("*").over(before), F.lit(0)) == 0))
    tagged = segment(tagged.withColumn("__opens", opens), F.col("__opens"), by).filter("segment > 0")
    rest = F.when(F.col("__opens"), F.nullif(T.strip(F.regexp_extract(t, T.ARTICLE_EN_LOOSE, 2)), F.lit(""))).otherwise(t)
    tagged = tagged.withColumn("__line", F.when(F.col("__opens") & F.col("__strict").isNotNull(), None).otherwise(rest))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__line").isNotNull(), F.struct("line_no", "__line")))), lambda x: x["__line"]), "\n")
    opened = tagged.groupBy(*by, "segment").agg(F.max(F.when(F.col("__opens"), F.col("__n"))).alias("article_number"), T.strip(body).alias("text"))
    latest = Window.partitionBy(*by, "article_number")
    ranked = opened.withColumns({"__last": F.max("segment").over(latest), "duplicate": F.count("*").over(latest) > 1})
    return ranked.filter("segment = __last").select(*by, "article_number", "text", "duplicate")


def fill_repealed(articles: DataFrame, notices: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Add a placeholder with the notice's text for every number in a range that is absent;
    the first notice wins, a parsed article is never replaced."""
    place = notices.select(*by, F.explode(F.sequence("lo", "hi")).alias("article_number"), *columns, "line_no")
    place = place.groupBy(*by, "article_number").agg(*(F.min_by(c, F.coalesce("line_no", F.lit(2**62))).alias(c) for c in columns))
    absent = place.join(articles.select(*by, "article_number"), [*by, "article_number"], "left_anti")
    return articles.select(*by, "article_number", *columns).unionByName(absent)


def merge_languages(first: DataFrame, second: DataFrame, by: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): numbers of both streams become records, of one stream an error."""
    a = first.withColumnsRenamed({"text": "text_ar", "page": "source_page"}).withColumn("__a", F.lit(True))
    b = second.select(*by, "article_number", F.col("text").alias("text_en"), F.lit(True).alias("__b"))
    both = a.join(b, [*by, "article_number"], "full_outer")
    n = F.col("article_number")
    repealed = T.is_repeal_notice(n, F.col("text_ar"), F.col("text_en"))
    records = both.filter("__a AND __b").select(*by, "article_number", "book", "chapter", "section", "topic", "text_ar", "text_en", repealed.alias("is_repealed"), "source_page", F.concat(F.lit(f"{prefix}, Article "), n.cast("string")).alias("citation"), F.array().cast("array<string>").alias("flags"))
    kind = F.when(F.col("__a").isNull(), "missing-arabic").otherwise("missing-english")
    errors = both.filter("__a IS NULL OR __b IS NULL").select(*by, "article_number", kind.alias("error"))
    return records, errors


def patch_articles(records: DataFrame, patches: DataFrame, by: list[str], prefix: str, patched: tuple[str, ...] = ("text_ar", "text_en", "is_repealed")) -> DataFrame:
    """Overlay per-number patches (null: not patched); new numbers take headings of n - 1,
    else n + 1.  Patched records carry the flag manually_patched."""
    p = patches.select(*by, "article_number", *(F.col(c).alias(f"__{c}") for c in patched), F.lit(True).alias("__p"))
    flag = F.when(F.col("__p"), F.concat("flags", F.array(F.lit("manually_patched")))).otherwise(F.col("flags"))
    old = records.join(p, [*by, "article_number"], "left").withColumns({c: F.coalesce(f"__{c}", c) for c in patched} | {"flags": flag}).select(records.columns)
    new = p.join(records.select(*by, "article_number"), [*by, "article_number"], "left_anti")
    places = ("book", "chapter", "section", "topic", "source_page")
    for side, step in (("b", 1), ("a", -1)):
        near = records.select(*by, (F.col("article_number") + step).alias("article_number"), *(F.col(c).alias(f"__{side}_{c}") for c in places))
        new = new.join(near, [*by, "article_number"], "left")
    empty = {"is_repealed": F.lit(False), "source_page": F.lit(0)}
    filled = {c: F.coalesce(f"__b_{c}", f"__a_{c}", empty.get(c, F.lit(""))) for c in places} | {c: F.coalesce(f"__{c}", empty.get(c, F.lit(""))) for c in patched}
    filled |= {"citation": F.concat(F.lit(f"{prefix}, Article "), F.col("article_number").cast("string")), "flags": F.array(F.lit("manually_patched"))}
    return old.unionByName(new.withColumns(filled).select(records.columns))


def open_errors(errors: DataFrame, patches: DataFrame, by: list[str]) -> DataFrame:
    """Merge errors with blocking false where a patch supplied the number."""
    p = patches.select(*by, "article_number").distinct().withColumn("__p", F.lit(True))
    return errors.join(p, [*by, "article_number"], "left").withColumn("blocking", F.col("__p").isNull()).drop("__p")


def check_corpus(records: DataFrame, last: int, known_gaps: list[int] = ()) -> DataFrame:
    """(severity, check, article_number, detail) of everything wrong with a corpus 1..last."""
    gaps = F.array(*map(F.lit, known_gaps)).cast("array<int>")
    want = records.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("article_number"))
    missing = want.join(records.select("article_number"), "article_number", "left_anti")
    known = F.array_contains(gaps, F.col("article_number"))
    found = [missing.select(F.when(known, "warning").otherwise("error").alias("severity"), F.when(known, "known gap").otherwise("gap").alias("check"), "article_number", F.lit("").alias("detail"))]
    outside = records.filter((F.col("article_number") < 1) | (F.col("article_number") > last))
    found.append(outside.select(F.lit("error").alias("severity"), F.lit("outside range").alias("check"), "article_number", F.lit("").alias("detail")))
    for c in ("text_ar", "text_en"):
        found.append(records.filter(T.strip(F.col(c)) == "").select(F.lit("error").alias("severity"), F.lit(f"empty {c}").alias("check"), "article_number", F.lit("").alias("detail")))
    found.append(records.filter(F.length("text_ar") > MOST_CHARS).select(F.lit("warning").alias("severity"), F.lit("long text_ar").alias("check"), "article_number", F.length("text_ar").cast("string").alias("detail")))
    repeated = records.groupBy("article_number").count().filter("count > 1")
    found.append(repeated.select(F.lit("error").alias("severity"), F.lit("repeated number").alias("check"), "article_number", F.col("count").cast("string").alias("detail")))
    ranges = records.agg(F.count_if(F.col("text_ar").rlike(T.REPEAL_RANGE) & F.col("text_ar").rlike(T.REPEAL_WORD)).alias("n")).filter("n = 0")
    found.append(ranges.select(F.lit("error").alias("severity"), F.lit("no repeal range").alias("check"), F.lit(None).cast("int").alias("article_number"), F.lit("").alias("detail")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def ligature_check(records: DataFrame, text: str, broken: list[str], correct: list[str]) -> DataFrame:
    """One row: how many texts hold a broken word form, how many a correct one, and passed."""
    words = F.split(F.col(text), r"(?U)\s+")
    hit = lambda forms: F.count_if(F.arrays_overlap(words, F.array(*map(F.lit, forms))))
    return records.agg(hit(broken).alias("broken"), hit(correct).alias("correct")).withColumn("passed", (F.col("broken") == 0) & (F.col("correct") > 0))
