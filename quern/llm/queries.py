"""The queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, hmm, line_crf, line_dedup, merkle, mixing, ngram_join, packing, pii, quality_rules, spelling, url_rules, warc
from quern.llm.common import ascii_lower

#: Host and path rules of the URL query: (verdict, host/path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Every fifth of the documents' checksums is held out of training.
FOLDS = 5
#: Every tenth of the checksums is held out of the language model.
LM_FOLDS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.personal_data(table(spark, sf_dir, "documents")))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    model = line_crf.train_on(docs, usable.select("doc_id", F.col("quality").alias("label")))
    scored = line_crf.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    proved = merkle.verified(merkle.merkle_manifest(table(spark, sf_dir, "documents"), now={"text": tampered}))
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % LM_FOLDS == 0, F.lit(False))
    scored = hmm.score_texts(table(spark, sf_dir, "documents"), learn=~held)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_rare_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: The word class of the contracts, as DuckDB's regular expressions write it.
_NO_SPACE = "[^\\x20\\x09-\\x0D]+"
_EDGE = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"
#: CRC-32 (unsigned) of UTF-8 text in DuckDB: bytes of the text, and the table of the
#: reversed polynomial, made by its rule.
_CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"


def _crc32(text: str, lookup: str = "crc.t") -> str:
    """crc32 of a text, where crc is a row of _CRC_TABLE."""
    bytes_of = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c >> 8, {lookup}[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


#: What a leaf hashes, in its order.
_LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _leaf_sql(text: str) -> str:
    values = (text if c == "text" else f"{c}::VARCHAR" for c in _LEAF_FIELDS)
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}))::VARCHAR || ':' || {v} END" for v in values) + ")"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
hashed AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(f"translate(text, {_AZ})")} ELSE {_leaf_sql("text")} END AS leaf_now
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, (count(*) OVER (PARTITION BY lang))::BIGINT AS n FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, pos // 8),
subroots AS (SELECT lang, level, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, h, (count(*) OVER ())::BIGINT AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM tops WHERE n > 1 GROUP BY pos // 8),
every AS (
  SELECT s.pos AS tree, n.level, n.pos, n.h FROM nodes n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang WHERE n.n > 1
  UNION ALL SELECT s.pos, s.level + t.level, t.pos, t.h FROM tops t CROSS JOIN subroots s WHERE t.n > 1),
rows_in AS (
  SELECT p.*, s.pos AS tree, s.pos AS top_pos, s.level AS height, s.h AS subroot FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT r.lang, r.pos AS leaf_pos, e.level,
         coalesce(string_agg(e.h, '' ORDER BY e.pos) FILTER (e.pos < a.at), '') AS l, coalesce(string_agg(e.h, '' ORDER BY e.pos) FILTER (e.pos > a.at), '') AS r
  FROM rows_in r
  JOIN (SELECT DISTINCT tree, level FROM every) v ON v.tree = r.tree,
  LATERAL (SELECT CASE WHEN v.level < r.height THEN r.pos // (8 ** v.level)::BIGINT ELSE r.top_pos // (8 ** (v.level - r.height))::BIGINT END AS at) a
  JOIN every e ON e.tree = r.tree AND e.level = v.level AND e.pos // 8 = a.at // 8
  GROUP BY r.lang, r.pos, e.level),
proof AS (
  SELECT lang, leaf_pos, string_agg(l || r, '' ORDER BY level) AS joined, list(struct_pack(l := l, r := r) ORDER BY level) AS path FROM steps GROUP BY lang, leaf_pos),
walk AS (
  SELECT r.lang, r.pos, 1 AS i, r.leaf_now AS h FROM rows_in r
  UNION ALL
  SELECT w.lang, w.pos, w.i + 1, sha256(p.path[w.i].l || w.h || p.path[w.i].r)
  FROM walk w JOIN proof p ON p.lang IS NOT DISTINCT FROM w.lang AND p.leaf_pos = w.pos WHERE w.i <= len(p.path)),
ended AS (SELECT lang, pos, arg_max(h, i) AS folded_root FROM walk GROUP BY lang, pos)
SELECT r.doc_id, r.leaf, r.subroot, t.h AS root, sha256(coalesce(p.joined, '')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM rows_in r JOIN ended e ON e.lang IS NOT DISTINCT FROM r.lang AND e.pos = r.pos
LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM r.lang AND p.leaf_pos = r.pos
CROSS JOIN (SELECT h FROM tops WHERE n = 1) t""",
        "op2_source_mix": f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_NO_SPACE}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS key
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
ratio AS (SELECT *, 3.0::DOUBLE * source_size AS lim, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS i FROM named),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM named)::DOUBLE - coalesce(sum(lim) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ratio),
settled AS (SELECT arg_min(level, lim / weight) AS level FROM levels WHERE lim >= level * weight),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.lim >= l.level * l.weight THEN s.level * l.weight ELSE l.lim END AS target
  FROM levels l CROSS JOIN settled s),
base AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM targets),
summed AS (
  SELECT s.source, s.key, sum(s.size)::BIGINT AS tokens, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.key) AS upto
  FROM sized s GROUP BY s.source, s.key),
cuts AS (
  SELECT b.source, b.source_size, b.target, b.repeats,
         (SELECT min(struct_pack(key := m.key, tokens := m.tokens, upto := m.upto)) FROM summed m
          WHERE m.source IS NOT DISTINCT FROM b.source AND m.upto > b.target - b.repeats * b.source_size) AS stop
  FROM base b)
SELECT d.doc_id, d.size, c.source_size, c.target,
       CASE WHEN d.size = 0 THEN 0 ELSE d.size * (c.repeats + CASE WHEN d.key < coalesce(
         c.stop.key + CASE WHEN c.stop.upto - (c.target - c.repeats * c.source_size) < (c.target - c.repeats * c.source_size) - (c.stop.upto - c.stop.tokens) THEN 1 ELSE 0 END, 0)
         THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM sized d JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source""",
        "op4_line_dedup": f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut),
keyed AS (
  SELECT *, translate(regexp_replace(line, '{_EDGE}', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, coalesce(k.doc_id <> s.keeper, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(CASE WHEN gone THEN 1 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
        "op7_ngram_product": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NO_SPACE}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g
  FROM worded WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.n""",
        "op8_warc_dictionary": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
        "op13_rare_bigrams": f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc),
damaged AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.part = y.part AND x.i = y.i AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION SELECT x.word, y.word, y.n FROM less x JOIN words y ON x.part = y.word
  UNION SELECT y.word, x.word, x.n FROM less x JOIN words y ON x.part = y.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(a := -near_n, b := near)) AS top FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN -b.top.a >= 10 * w.n THEN b.top.b END AS form, CASE WHEN -b.top.a >= 10 * w.n THEN -b.top.a END::BIGINT AS form_n
  FROM words w LEFT JOIN best b USING (word)),
follow AS (
  SELECT word, word AS here, 0 AS step FROM formed
  UNION ALL SELECT f.word, g.form, f.step + 1 FROM follow f JOIN formed g ON g.word = f.here WHERE g.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(here, step) AS root FROM follow GROUP BY word) r USING (word)""",
    }
