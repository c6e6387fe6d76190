from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking, documents, parsing


def lines(spark, rows):
    return spark.createDataFrame([("d", i, p, t) for i, (p, t) in enumerate(rows)], "doc string, line_no long, page int, text string")


def test_page_columns_and_word_order(spark):
    words = [
        # page 1, 100 wide: English left of the gap, Arabic right of it
        (1, 0, "Hello", 5.0, 20.0, 10.0, None), (1, 1, "world", 22.0, 30.0, 11.0, None), (1, 2, "below", 5.0, 20.0, 30.0, None),
        (1, 3, "ةدام", 80.0, 95.0, 10.0, ["ة", "د", "ا", "م"]), (1, 4, "الإ", 60.0, 75.0, 12.0, ["لا", "إ"]), (1, 5, "١٢", 55.0, 58.0, 10.5, ["١", "٢"]),
        (2, 0, "alone", 1.0, 2.0, 5.0, []),
    ]
    df = spark.createDataFrame([(*w, 100.0) for w in words], "page int, pos int, text string, x0 double, x1 double, top double, glyphs array<string>, width double")
    split = {r.page: r.split_x for r in parsing.split_positions(df).collect()}
    assert split[1] == 31 + 24 / 2 and split[2] == 15 + 71 / 2
    got = [(r.lang, r.line_no, r.text) for r in parsing.page_lines(df).orderBy("lang", "line_no").collect()]
    assert got == [("ar", 1, "مادة إلا ١٢"), ("en", 1, "Hello world"), ("en", 2, "below"), ("en", 3, "alone")]


def test_rows_cluster_by_their_first_word(spark):
    df = spark.createDataFrame([([{"top": x} for x in (1.0, 3.5, 4.0, 6.5, 7.1, 20.0)],)], "ws array<struct<top: double>>")
    assert df.select(parsing.cluster_rows(F.col("ws")).alias("r")).first().r == [0, 0, 0, 1, 1, 2]


STREAM = [
    (1, "مادة ١"), (1, "front matter"), (1, "القسم الأول"), (1, "الكتاب الأول"), (1, "١ - topic one"), (1, "مادة ١"), (1, "first text"), (1, "second line"),
    (2, "الباب الثاني"), (2, "مادة (٢)"), (2, "body of two"), (2, "ألغيت المواد من ٤ إلى ٦ بالقانون"), (3, "stray"), (3, "مادة ٧"), (3, "old seven"), (4, "مادة ٧"), (4, "new seven"),
]


def test_first_stream_segments_headings_and_notices(spark):
    articles, notices = parsing.first_stream(lines(spark, STREAM), ["doc"])
    got = {r.article_number: r for r in articles.collect()}
    assert set(got) == {1, 2, 7}
    assert got[1].text == "first text\nsecond line" and got[1].book == "القسم الأول - الكتاب الأول" and got[1].topic == "١ - topic one"
    assert got[2].chapter == "الباب الثاني" and got[2].topic == "" and got[2].text == "body of two"
    assert got[7].text == "new seven" and got[7].duplicate and got[7].page == 4
    assert [(r.lo, r.hi) for r in notices.collect()] == [(4, 6)]


def test_two_languages_merge_fill_and_patch(spark):
    articles, notices = parsing.first_stream(lines(spark, STREAM), ["doc"])
    english = lines(spark, [(1, "Article 1"), (1, "text one"), (1, "see Article 2 there"), (2, "rticle 2 begins here"), (2, "and goes on"), (3, "Article 2 not a header"), (4, "Article 9"), (4, "only english")])
    second = parsing.second_stream(english, articles.select("doc", "article_number", "page"), ["doc"])
    texts = {r.article_number: r.text for r in second.collect()}
    assert texts == {1: "text one\nsee Article 2 there", 2: "begins here\nand goes on\nArticle 2 not a header", 9: "only english"}
    filled = parsing.fill_repealed(articles, notices, ["doc"], ["text", "page", "book", "chapter", "section", "topic"])
    assert sorted(r.article_number for r in filled.collect()) == [1, 2, 4, 5, 6, 7]
    both = parsing.fill_repealed(second.withColumn("page", F.lit(0)), notices, ["doc"], ["text"])
    records, errors = parsing.merge_languages(filled, both, ["doc"], "Law")
    got = {r.article_number: r for r in records.collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[5].is_repealed and not got[1].is_repealed and got[5].text_en == got[5].text_ar
    assert {(r.article_number, r.error) for r in errors.collect()} == {(7, "missing-english"), (9, "missing-arabic")}
    patches = spark.createDataFrame([("d", 2, None, "patched", None), ("d", 7, "ar", "en", None)], "doc string, article_number int, text_ar string, text_en string, is_repealed boolean")
    done = {r.article_number: r for r in parsing.patch_articles(records, patches, ["doc"], "Law").collect()}
    assert done[2].text_en == "patched" and done[2].text_ar == "body of two" and done[2].flags == ["manually_patched"]
    assert done[7].text_ar == "ar" and done[7].chapter == done[6].chapter and done[1].flags == []
    open_ = {r.article_number: r.blocking for r in parsing.open_errors(errors, patches, ["doc"]).collect()}
    assert open_ == {7: False, 9: True}
    found = {(r.severity, r.check, r.article_number) for r in parsing.check_corpus(records, 7, [7]).collect()}
    assert found == {("error", "gap", 3), ("warning", "known gap", 7)}


def article(n, ar, en="", repealed=False):
    return ("d", n, "b", "c", "s", "t", ar, en, repealed, 1)


def test_chunks_of_the_fixture(spark):
    long_ar = "(١) " + "x" * 400 + "\n(٢) " + "y" * 400
    rows = [article(n, f"text {n}", "e") for n in (1, 2, 3)] + [article(n, "gone", "gone", True) for n in (4, 5, 6, 7)] + [article(9, "gone", "gone", True)]
    rows += [article(10, long_ar, "(1) a\n(2) b"), article(11, long_ar, "whole"), article(12, "short", " ")]
    df = spark.createDataFrame(rows, "doc string, article_number int, book string, chapter string, section string, topic string, text_ar string, text_en string, is_repealed boolean, source_page int")
    chunks = chunking.build_chunks(df, ["doc"], F.lit("Law"))
    got = {r.chunk_id: r for r in chunks.collect()}
    assert set(got) == {"1", "2", "3", "4-7-repealed", "9", "10-p1", "10-p2", "11-p1", "11-p2", "11-en-whole", "12"}
    assert got["4-7-repealed"].article_numbers == [4, 5, 6, 7] and got["4-7-repealed"].citation == "Law, Articles 4-7"
    assert (got["10-p2"].text_en, got["11-p1"].text_en, got["11-en-whole"].text_ar) == ("(2) b", "", "")
    assert chunking.coverage(df, chunks, ["doc"]).count() == 0
    points = chunking.points(chunks, F.lit("other"))
    assert points.count() == 11 - 1 + 11 - 3 and points.select("point_id").distinct().count() == points.count()
    assert chunking.build_chunks(df, ["doc"], F.lit("Law"), dedupe_repealed=False).count() == 14


def test_point_ids_are_version_5_uuids(spark):
    import uuid

    space = uuid.UUID(T.ID_NAMESPACE)
    df = spark.createDataFrame([("1-p2", "ar", T.PRIMARY_DOC), ("7", "en", "قانون")], "c string, l string, d string")
    got = [r[0] for r in df.select(T.point_id(F.col("c"), F.col("l"), F.col("d"))).collect()]
    assert got == [str(uuid.uuid5(space, "1-p2-ar")), str(uuid.uuid5(space, "قانون:7-en"))]


def test_document_rules(spark):
    good = dict(article_number=1, book="b", chapter="c", section="s", topic="t", text_ar="ن" * 30, text_en="", is_repealed=False, source_page=1)
    kinds = "article_number: int, book: string, chapter: string, section: string, topic: string, text_ar: string, text_en: string, is_repealed: boolean, source_page: int"

    def doc(doc_id="law_1", source="gazette", prefix="Law", articles=None):
        return (doc_id, "title", prefix, source, [good] if articles is None else articles)

    cases = [doc("fine_law"), doc("Bad"), doc(T.PRIMARY_DOC), doc("src", source="<url>"), doc("pre", prefix=" "), doc("none", articles=[]), doc("dup", articles=[good, good]), doc("neg", articles=[good | {"article_number": 0}]), doc("gap", articles=[good | {"topic": None}]), doc("stub", articles=[good | {"text_ar": " short "}]), doc("todo", articles=[good | {"text_en": "todo"}]), doc("long", articles=[good | {"text_ar": "x" * 6001}])]
    df = spark.createDataFrame(cases, f"doc_id string, title string, citation_prefix string, source string, articles array<struct<{kinds}>>")
    first = {r.doc_id: r.message for r in documents.first_violation(documents.violations(df)).collect()}
    assert "fine_law" not in first and len(first) == len(cases) - 1
    assert first["dup"] == "repeated article_number" and first["gap"] == "missing field topic" and first["todo"] == "text_en is a placeholder" and first["stub"] == "text_ar is too short"


def test_text_functions(spark):
    df = spark.createDataFrame([("Article 54, المادة: ١٤٧ and Articles 9-12 article#3",)], "q string")
    assert df.select(T.article_references(F.col("q")).alias("n")).first().n == [54, 147, 3]
    one = df.select(
        T.to_int(F.lit("١a٢")).alias("i"), T.to_int(F.lit("a")).alias("j"), T.is_refusal(F.lit(None).cast("string")).alias("r"), T.is_topic(F.lit("١ - عقد")).alias("t"), T.is_heading(F.lit("الباب " + "x" * 60), "chapter").alias("h"),
        T.context(F.lit("L, Articles 4-6"), F.lit("gone"), F.lit(True), F.array(*map(F.lit, (4, 5, 6))), F.lit("Is Article 5 or Article 9 in force?")).alias("c"), T.without_thinking(F.lit("<think>a\nb</think>\n x ")).alias("w"),
        T.is_repeal_notice(F.lit(57), F.lit("ألغيت المواد من ٥٤ إلى ٨٠")).alias("n1"), T.is_repeal_notice(F.lit(81), F.lit("Articles 54-80 were repealed")).alias("n2"), T.fixed(F.lit(None), 2).alias("f"), T.percent(F.lit(0.125)).alias("p"), T.event_json(F.lit("token"), text=F.lit("é")).alias("e"),
    ).first()
    assert (one.i, one.j, one.r, one.t, one.h, one.w, one.n1, one.n2, one.f) == (12, None, False, True, False, "x", True, False, "n/a")
    assert one.c == "[L, Articles 4-6] (REPEALED -- no longer in force)\ngone\nNote: Article 5 is within this range, so Article 5 is REPEALED."
    assert one.p == "12.5%" and one.e == '{"type":"token","text":"é"}'


def test_decimals_round_as_the_exact_value_of_the_double(spark):
    values = [8.665, 2.675, 0.125, 0.375, 1234567.5, -0.004, 0.285, 1e15 + 0.5, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select("v", T.fixed(F.col("v"), 2, " s").alias("f"), T.percent(F.col("v"), 1).alias("p")).collect()
    assert [(r.f, r.p) for r in got] == [(f"{r.v:.2f} s", f"{r.v * 100:.1f}%") for r in got]
    odd = spark.range(1).select(T.fixed(F.lit(float("nan")), 2).alias("n"), T.fixed(F.lit(float("inf")), 0).alias("i")).first()
    assert (odd.n, odd.i) == ("NaN", "Infinity")
