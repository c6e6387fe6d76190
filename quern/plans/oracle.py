"""SQL that DuckDB runs on the same tables, by query name."""

from __future__ import annotations

from quern.functions import text as T
from quern.operators import ops

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[])"
_KNN = f"""scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, p.vec_id AS point_id, p.label AS label, {_COS} AS score
  FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM scored),
knn AS (SELECT * FROM ranked WHERE rank <= 8)"""
_TOP = f"""{_KNN},
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS rn FROM knn),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM firsts WHERE rn = 1) WHERE place <= 3)"""
_GATE_ROWS = f"""{_KNN},
rows_ AS (
  SELECT query_id::VARCHAR AS question, round_even(score, 4) AS top_score, CASE WHEN query_id % 100 = 0 THEN 'tune' ELSE 'check' END AS "set",
         query_id % 150 <> 0 AS in_corpus, query_id % 250 = 0 AS exempt
  FROM knn WHERE rank = 1)"""
_UNIT = """windows AS (SELECT (vec_id // 50 % 3)::VARCHAR AS w, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
base AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 <> 0)"""
_LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents)"
_ARTICLES = """bodies AS (SELECT *, regexp_replace(coalesce(text, ''), '[ \\n]+', ' ', 'g') AS body, doc_id % 8 >= 5 AS rep FROM documents),
articles AS (
  SELECT doc_id AS n, rep, CASE WHEN rep THEN 'repealed ' || (doc_id // 8) ELSE '(١) ' || body || chr(10) || '(٢) ' || body END AS ar,
         CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 5 = 0 THEN body ELSE '(1) ' || lang || chr(10) || '(2) ' || body END AS en, body, lang
  FROM bodies),
marked AS (
  SELECT *, CASE WHEN rep AND lag(rep) OVER w AND lag(ar) OVER w = ar AND lag(n) OVER w + 1 = n THEN 0 ELSE 1 END AS fresh FROM articles WINDOW w AS (ORDER BY n)),
runs AS (SELECT *, sum(fresh) OVER (ORDER BY n) AS run FROM marked),
sized AS (SELECT *, count(*) OVER (PARTITION BY run) AS size FROM runs)"""
_S = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_CHUNKS = f"""{_ARTICLES},
single AS (SELECT * FROM sized WHERE NOT (rep AND size > 1)),
pieces AS (
  SELECT min(n) AS n, true AS rep, 'run' AS kind, min(n) || '-' || max(n) || '-repealed' AS chunk_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS numbers, NULL::INTEGER AS paragraph_index,
         'Law, Articles ' || min(n) || '-' || max(n) AS citation, any_value(ar) AS ar, arg_min(en, n) AS en, 'deduped_repealed_range' AS flags
  FROM sized WHERE rep AND size > 1 GROUP BY run
  UNION ALL
  SELECT n, rep, 'whole', n::VARCHAR, n::VARCHAR, NULL, 'Law, Article ' || n, ar, en, '' FROM single WHERE rep OR length(ar) <= 700
  UNION ALL
  SELECT n, rep, 'paragraph', n || '-p' || i, n::VARCHAR, i, 'Law, Article ' || n, {_S("CASE WHEN i = 1 THEN '(١) ' || body ELSE '(٢) ' || body END")},
         CASE WHEN n % 9 = 0 OR n % 5 = 0 THEN '' ELSE {_S("CASE WHEN i = 1 THEN '(1) ' || lang ELSE '(2) ' || body END")} END,
         CASE WHEN n % 9 = 0 OR n % 5 = 0 THEN 'ar_only_paragraph_split' ELSE '' END
  FROM single, (SELECT unnest([1, 2])::INTEGER AS i) WHERE NOT rep AND length(ar) > 700
  UNION ALL
  SELECT n, rep, 'second', n || '-en-whole', n::VARCHAR, NULL, 'Law, Article ' || n, '', en, 'en_whole_unaligned_source' FROM single WHERE NOT rep AND length(ar) > 700 AND (n % 9 = 0 OR n % 5 = 0))"""
_NS = "repeat(chr(18) || '4Vx', 4)"


def _uuid(key: str) -> str:
    h = f"sha1({_NS} || {key})"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr({h}, 17, 1))::INTEGER + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


_EMAIL = "[\\pL\\pM\\p{Nd}\\p{Pc}.+-]+@[\\pL\\pM\\p{Nd}\\p{Pc}-]+(?:\\.[\\pL\\pM\\p{Nd}\\p{Pc}-]+)+"


def _cards(x: str) -> str:
    """Luhn-valid card strings: digit blocks stand between private-use marks, so that blocks
    end where a look-around would say so."""
    marked = f"regexp_replace({x}, '([0-9]+)', chr(57344) || '\\1' || chr(57345), 'g')"
    pattern = "chr(57344) || '[0-9](?:(?:' || chr(57345) || '[ -]' || chr(57344) || ')?[0-9]){12,18}' || chr(57345)"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN (len({digits}) - i) % 2 = 0 THEN substr({digits}, i, 1)::INTEGER ELSE substr({digits}, i, 1)::INTEGER * 2 - CASE WHEN substr({digits}, i, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    found = f"list_filter(regexp_extract_all({marked}, {pattern}), lambda m: {luhn})"
    return f"list_transform({found}, lambda m: replace(replace(m, chr(57344), ''), chr(57345), ''))"


_OWN = "translate(coalesce({0}, ''), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"


def _score(m: int) -> str:
    return f"CASE WHEN l.doc_id % {m} = 0 OR l.doc_id % {m + 1} = 0 THEN NULL ELSE (d.n_chars * {m} % 1000) / 1000.0::DOUBLE END"


_EVAL = f"""ev AS (
  SELECT l.doc_id AS id, CASE WHEN l.doc_id % 6 = 0 THEN 'out_of_corpus' WHEN l.doc_id % 6 = 1 THEN 'article_lookup' ELSE 'substantive' END AS category, d.lang AS language, d.source AS config,
         l.toxic = 1 AS declined, CASE WHEN l.doc_id % 4 <> 0 THEN l.quality = 1 END AS hit, {_score(7)} AS f, {_score(11)} AS p, {_score(13)} AS r, {_score(17)} AS a
  FROM labels l JOIN documents d USING (doc_id))"""
_MEANS = """means AS (
  SELECT config, avg(f) FILTER (category <> 'out_of_corpus') AS faithfulness, count(f) FILTER (category <> 'out_of_corpus') AS nf, avg(p) FILTER (category <> 'out_of_corpus') AS context_precision, count(p) FILTER (category <> 'out_of_corpus') AS np,
         avg(r) FILTER (category <> 'out_of_corpus') AS context_recall, count(r) FILTER (category <> 'out_of_corpus') AS nr, avg(a) FILTER (category <> 'out_of_corpus') AS answer_relevancy, count(a) FILTER (category <> 'out_of_corpus') AS na,
         avg(hit::INTEGER) AS article_hit_rate, avg(declined::INTEGER) FILTER (category = 'out_of_corpus') AS refusal_rate, avg(declined::INTEGER) FILTER (category <> 'out_of_corpus') AS false_refusal_rate
  FROM ev GROUP BY config)"""
_LOG = """raw AS (
  SELECT event_id, ts, CASE WHEN event_type = 'view' THEN '/ask' ELSE '/health' END AS uri, CASE WHEN event_type = 'error' THEN 502 ELSE 200 END AS status, value AS request_time, user_id % 40 AS up,
         CASE WHEN event_type = 'error' THEN '' WHEN user_id % 2 = 0 THEN 'stable-1' ELSE 'canary-2' END AS rel FROM events),
learned AS (SELECT up, arg_max(rel, event_id) AS rel FROM raw WHERE rel <> '' GROUP BY up),
log AS (SELECT r.*, coalesce(nullif(r.rel, ''), l.rel, 'unknown') AS release FROM raw r LEFT JOIN learned l USING (up)),
stats AS (
  SELECT release, count(*) AS requests, count(CASE WHEN status >= 500 THEN 1 END) AS errors, count(CASE WHEN uri = '/ask' AND status < 500 THEN 1 END) AS ask_n, quantile_disc(request_time, 0.95) FILTER (uri = '/ask' AND status < 500) AS ask_p95
  FROM log GROUP BY release)"""
_BOUNDS = ", ".join(f"{float(b)!r}::DOUBLE" for b in ops.LATENCY_BOUNDS)
_BUCKETS = f"""bounds AS (SELECT unnest([{_BOUNDS}, 'Infinity'::DOUBLE]) AS le),
buckets AS (SELECT event_type, le, count(CASE WHEN value <= le THEN 1 END) AS cum_count FROM events CROSS JOIN bounds GROUP BY event_type, le)"""
_LAT = "lat AS (SELECT (user_id % 2)::VARCHAR AS variant, value AS l, CASE WHEN event_id % 5 <> 0 THEN value / 4 END AS t, CASE WHEN event_id % 40 <> 0 AND value <> 0 THEN (event_id % 40) / value END AS r FROM events)"
_VERSIONS = """old AS (SELECT doc_id AS point_id, source AS doc_id, n_chars AS payload FROM documents),
new AS (SELECT point_id, doc_id, payload + 1 AS payload FROM old WHERE doc_id = 'src3' AND payload % 3 <> 0
        UNION ALL SELECT point_id + 1000000000, doc_id, payload FROM old WHERE doc_id = 'src3' AND payload % 5 = 0)"""
_PLACE = "(?i)<[^<>]{0,120}>|\\bTODO\\b|\\bTBD\\b|\\.\\.\\.$|…$"
_VIOLATIONS = f"""{_ARTICLES},
parts AS (
  SELECT n // 10 AS g, n, CASE WHEN n % 19 = 0 THEN -1 WHEN n % 10 = 7 THEN n - 1 ELSE n END AS num, n % 23 <> 0 AS has_book,
         CASE WHEN n % 11 = 0 THEN 'TODO' WHEN n % 17 = 0 THEN 'short' ELSE ar END AS ar, en, row_number() OVER (PARTITION BY n // 10 ORDER BY n) - 1 AS place FROM articles),
docs AS (SELECT DISTINCT g, CASE WHEN g % 4 = 1 THEN 'Bad ' || g WHEN g = 0 THEN '{T.PRIMARY_DOC}' ELSE 'law_' || g END AS doc_id FROM parts),
found AS (
  SELECT doc_id, NULL::INTEGER AS article_at, 1 AS rule, 'doc_id is not a slug' AS message FROM docs WHERE NOT regexp_matches(doc_id, '^[a-z0-9][a-z0-9_]{{2,63}}$')
  UNION ALL SELECT doc_id, NULL, 2, 'doc_id is reserved' FROM docs WHERE doc_id = '{T.PRIMARY_DOC}'
  UNION ALL SELECT doc_id, NULL, 3, 'source is empty or a placeholder' FROM docs WHERE g % 6 = 3
  UNION ALL SELECT doc_id, NULL, 4, 'citation_prefix is empty' FROM docs WHERE g % 5 = 2
  UNION ALL SELECT doc_id, place, 1, 'missing field book' FROM parts JOIN docs USING (g) WHERE NOT has_book
  UNION ALL SELECT doc_id, place, 2, 'article_number is not positive' FROM parts JOIN docs USING (g) WHERE num < 1
  UNION ALL SELECT doc_id, p.place, 3, 'repeated article_number' FROM parts p JOIN docs USING (g) WHERE EXISTS (SELECT 1 FROM parts e WHERE e.g = p.g AND e.place < p.place AND e.num = p.num)
  UNION ALL SELECT doc_id, place, 4, 'empty text_ar' FROM parts JOIN docs USING (g) WHERE {_S("ar")} = ''
  UNION ALL SELECT doc_id, place, 5, 'text_ar is a placeholder' FROM parts JOIN docs USING (g) WHERE regexp_matches({_S("ar")}, '{_PLACE}')
  UNION ALL SELECT doc_id, place, 6, 'text_en is a placeholder' FROM parts JOIN docs USING (g) WHERE regexp_matches({_S("en")}, '{_PLACE}')
  UNION ALL SELECT doc_id, place, 7, 'text_ar is too short' FROM parts JOIN docs USING (g) WHERE length({_S("ar")}) < 20
  UNION ALL SELECT doc_id, place, 8, 'text_ar is too long' FROM parts JOIN docs USING (g) WHERE length(ar) > 6000
  UNION ALL SELECT doc_id, place, 9, 'text_en is too long' FROM parts JOIN docs USING (g) WHERE length(en) > 6000)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "knn_top8": f"WITH {_KNN} SELECT query_id, rank::INTEGER AS rank, point_id, round(score, 6) AS score FROM knn",
        "knn_distinct_top3": f"WITH {_TOP} SELECT query_id, place::INTEGER AS place, point_id, label, round(score, 6) AS score FROM top",
        "hybrid_two_lane_topk": f"""WITH {_KNN},
exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rk FROM scored WHERE label = query_label),
lanes AS (SELECT query_id, point_id, label, score, 0 AS lane, rk AS rank FROM exact WHERE rk <= 8 UNION ALL SELECT query_id, point_id, label, score, 1, rank FROM knn),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY lane, rank) AS rn FROM lanes),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lane, rank) AS place FROM one WHERE rn = 1)
SELECT query_id, place::INTEGER AS place, lane, point_id, label, round(score, 6) AS score FROM placed WHERE place <= 3""",
        "twin_swap": f"""WITH {_TOP}
SELECT t.query_id, t.place::INTEGER AS place, coalesce(w.vec_id, t.point_id) AS point_id, round(t.score, 6) AS score, w.vec_id IS NOT NULL AS swapped
FROM top t LEFT JOIN embeddings w ON w.vec_id = t.point_id + 1 AND w.label = t.label""",
        "point_lookup": "SELECT vec_id AS point_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
        "payload_filter": "SELECT vec_id AS point_id, label FROM embeddings WHERE label = 4 AND list_has_any([label, label + 1], [3, 5])",
        "refusal_gate": f"""WITH {_TOP}
SELECT query_id, round(max(score), 6) AS best_score, bool_or(query_id % 100 = 0 AND label = query_label AND point_id % 2 = 0) AS exempt,
       NOT bool_or(query_id % 100 = 0 AND label = query_label AND point_id % 2 = 0) AND max(score) < 0.35 AS refused
FROM top GROUP BY query_id""",
        "refusal_threshold_sweep": f"""WITH {_GATE_ROWS}, th AS (SELECT unnest([0.3::DOUBLE, 0.35, 0.4, 0.45]) AS threshold),
j AS (SELECT *, NOT exempt AND top_score < threshold AS r FROM rows_ CROSS JOIN th)
SELECT threshold, "set", count(CASE WHEN in_corpus AND r THEN 1 END) AS in_corpus_refused, count(CASE WHEN in_corpus THEN 1 END) AS in_corpus, count(CASE WHEN NOT in_corpus AND r THEN 1 END) AS out_of_corpus_refused, count(CASE WHEN NOT in_corpus THEN 1 END) AS out_of_corpus
FROM j GROUP BY threshold, "set\"""",
        "recommended_threshold": f"""WITH {_GATE_ROWS} SELECT round_even(min(top_score) FILTER ("set" = 'tune' AND in_corpus AND NOT exempt) - 0.005::DOUBLE, 3) AS threshold FROM rows_""",
        "closest_calls": f"""WITH {_GATE_ROWS}, k AS (
  SELECT *, row_number() OVER (PARTITION BY in_corpus ORDER BY CASE WHEN in_corpus THEN top_score ELSE -top_score END, question) AS i FROM rows_)
SELECT question, in_corpus, top_score FROM k WHERE i <= 3""",
        "prompt_assembly": f"""WITH {_TOP},
shown AS (
  SELECT t.query_id, t.place, 'Doc, Article ' || t.label AS citation, '[Doc, Article ' || t.label || ']' || CASE WHEN t.point_id % 3 = 0 THEN ' (REPEALED -- no longer in force)' ELSE '' END || chr(10) || d.text
         || CASE WHEN t.point_id % 3 = 0 AND t.label IN (3, 4) THEN chr(10) || 'Note: Article 4 is within this range, so Article 4 is REPEALED.' ELSE '' END AS context
  FROM top t JOIN documents d ON d.doc_id = t.point_id)
SELECT query_id, md5(coalesce(string_agg(context, chr(10) || chr(10) ORDER BY place), '')) AS contexts, string_agg(citation, '|' ORDER BY place) AS sources FROM shown GROUP BY query_id""",
        "centroid_drift": f"""WITH {_UNIT},
both_ AS (SELECT w AS g, id, v FROM windows UNION ALL SELECT 'base', id, v FROM base),
dims AS (SELECT g, unnest(range(len(v))) AS dim, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM both_),
means AS (SELECT g, dim, avg(x) AS x FROM dims GROUP BY g, dim),
sims AS (SELECT a.g AS w, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS c FROM means a JOIN means b ON a.dim = b.dim AND b.g = 'base' AND a.g <> 'base' GROUP BY a.g)
SELECT w AS "window", (SELECT count(*) FROM windows x WHERE x.w = s.w) AS n_queries, round(c, 6) AS centroid_cosine, round(1 - c, 6) AS drift FROM sims s""",
        "nearest_baseline": f"""WITH {_UNIT}, near AS (SELECT w, q.id, max(list_cosine_similarity(q.v, b.v)) AS m FROM windows q CROSS JOIN base b GROUP BY w, q.id)
SELECT w AS "window", round(avg(m), 6) AS nearest_baseline_similarity_mean FROM near GROUP BY w""",
        "off_corpus_share": f"""WITH RECURSIVE {_KNN}, best AS (SELECT (query_id // 50 % 3)::VARCHAR AS w, score FROM knn WHERE rank = 1),
cut AS (SELECT quantile_cont(score, 0.05) AS cut FROM best WHERE w = '0'),
agg AS (SELECT w, avg(score) AS m, count(CASE WHEN score < cut THEN 1 END) AS low, count(*) AS n, any_value(cut) AS cut FROM best CROSS JOIN cut GROUP BY w),
tails AS (
  SELECT n, 0::BIGINT AS k, pow(0.95::DOUBLE, n) AS mass, 1.0::DOUBLE AS tail FROM (SELECT DISTINCT n FROM agg)
  UNION ALL SELECT n, k + 1, mass * (n - k) / (k + 1) * (0.05::DOUBLE / 0.95::DOUBLE), tail - mass FROM tails WHERE k <= n AND tail > 0.01),
lim AS (SELECT n, max(k) AS k FROM tails GROUP BY n)
SELECT w AS "window", round(m, 6) AS corpus_score_mean, round(cut, 6) AS corpus_cutoff, low AS low_similarity_queries, k AS low_similarity_limit, round(low / n, 6) AS off_corpus_share, low >= k AS off_corpus
FROM agg JOIN lim USING (n)""",
        "binomial_limit": """WITH RECURSIVE tails AS (
  SELECT n, 0::BIGINT AS k, pow(0.95::DOUBLE, n) AS mass, 1.0::DOUBLE AS tail FROM (SELECT unnest(range(1, 61)) AS n)
  UNION ALL SELECT n, k + 1, mass * (n - k) / (k + 1) * (0.05::DOUBLE / 0.95::DOUBLE), tail - mass FROM tails WHERE k <= n AND tail > 0.01)
SELECT n, max(k) AS limit_k FROM tails GROUP BY n""",
        "drift_threshold_md5perm": f"""WITH {_UNIT}, sizes AS (SELECT 'small' AS w, 3 AS n UNION ALL SELECT 'large', 10000), total AS (SELECT count(*) AS c FROM windows),
drawn AS (SELECT trial, id, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '|' || id), id) AS place FROM windows CROSS JOIN (SELECT unnest(range(1000)) AS trial)),
sided AS (SELECT s.w, trial, id, place <= least(s.n, c - 1) AS inside FROM drawn CROSS JOIN sizes s CROSS JOIN total),
dims AS (SELECT id, unnest(range(len(v))) AS dim, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM windows),
means AS (SELECT s.w, trial, dim, avg(x) FILTER (inside) AS a, avg(x) FILTER (NOT inside) AS b FROM sided s JOIN dims USING (id) GROUP BY s.w, trial, dim),
drifts AS (SELECT w, trial, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS drift FROM means GROUP BY w, trial)
SELECT w AS "window", round(quantile_cont(drift, 0.99), 6) AS threshold FROM drifts GROUP BY w""",
        "drift_threshold_baseline": f"""WITH {_UNIT}, sizes AS (SELECT 'small' AS w, 3 AS n UNION ALL SELECT 'large', 40), total AS (SELECT count(*) AS c FROM base),
drawn AS (SELECT trial, id, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '|' || id), id) AS place FROM base CROSS JOIN (SELECT unnest(range(1000)) AS trial)),
sided AS (SELECT s.w, trial, id, place <= least(s.n, c - 1) AS inside FROM drawn CROSS JOIN sizes s CROSS JOIN total),
dims AS (SELECT id, unnest(range(len(v))) AS dim, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM base),
means AS (SELECT s.w, trial, dim, avg(x) FILTER (inside) AS a, avg(x) FILTER (NOT inside) AS b FROM sided s JOIN dims USING (id) GROUP BY s.w, trial, dim),
drifts AS (SELECT w, trial, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS drift FROM means GROUP BY w, trial)
SELECT w AS "window", round(quantile_cont(drift, 0.99), 6) AS threshold FROM drifts GROUP BY w""",
        "cosine_pairs": f"SELECT q.vec_id AS query_id, p.vec_id AS point_id, round({_COS}, 6) AS cosine FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0",
        "digits_normalize": """SELECT conv_id, turn, translate('٠١٢ ۳۴ 7 ' || turn || coalesce(text, ''), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS digits,
       translate('٠١٢ ۳۴ 7 ' || turn || coalesce(text, ''), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS all_digits, 12::INTEGER AS number, reverse(conv_id::VARCHAR)::INTEGER AS turned FROM conversations""",
        "article_refs": """WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'المادة ١٤٧ and Article: 54 of Articles 9-12 article #' || turn || ' ' || coalesce(text, '') AS q FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(q, '(?:Article|article|مادة|المادة)\\s*[:#]?\\s*([0-9٠-٩]+)', 1), lambda x: translate(x, '٠١٢٣٤٥٦٧٨٩', '0123456789')::INTEGER::VARCHAR), ',') AS numbers,
       CASE WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE 'en' END AS lang, 'ar' AS mixed_lang FROM q""",
        "strip_think": f"SELECT conv_id, turn, {_S("regexp_replace(' <think>a' || chr(10) || 'b</think>  ' || coalesce(text, '') || '<think>c</think>' || chr(10) || ' ', '<think>.*?</think>\\s*', '', 'gs')")} AS answer FROM conversations",
        "point_id_uuid5": f"SELECT doc_id, {_uuid("(CASE WHEN doc_id % 2 = 0 THEN doc_id || '-' || lang ELSE source || ':' || doc_id || '-' || lang END)")} AS point_id FROM documents",
        "citation_format": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Law, Article ' || doc_id ELSE 'Law, Articles ' || doc_id || '-' || (doc_id + 2) END AS citation,
       CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE doc_id || '-' || (doc_id + 2) || '-repealed' END AS chunk_id, md5(text) AS md5 FROM documents""",
        "report_cells": """WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 7 <> 0 THEN n_chars / 1024.0::DOUBLE END AS x FROM documents)
SELECT doc_id, coalesce(format('{:.2f} s', floor(x * 4) / 4), 'n/a') AS fixed, coalesce(format('{:.1f}%', floor(x * 8) / 125 * 100), 'n/a') AS share, md5(replace(replace(text, '|', '\\|'), chr(10), ' ')) AS cell FROM x""",
        "refusal_answers": f"SELECT conv_id, turn, coalesce(regexp_matches(CASE WHEN turn % 2 = 0 THEN 'The provided articles DO NOT contain it. ' || text ELSE text END, '(?i){T.REFUSAL}'), false) AS refused FROM conversations",
        "segment_lines": f"""WITH {_LINES}, s AS (SELECT *, sum(CASE WHEN ends_with(text, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS segment FROM lines)
SELECT doc_id, segment, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM s GROUP BY doc_id, segment""",
        "heading_carry_forward": f"""WITH {_LINES},
h AS (SELECT doc_id, line_no, CASE WHEN length(text) < 20 THEN text END AS p, CASE WHEN length(text) BETWEEN 20 AND 39 THEN text END AS b, CASE WHEN length(text) BETWEEN 40 AND 59 THEN text END AS c FROM lines),
s AS (SELECT *, count(p) OVER (PARTITION BY doc_id ORDER BY line_no) AS sp, count(coalesce(p, b)) OVER (PARTITION BY doc_id ORDER BY line_no) AS sb FROM h)
SELECT doc_id, line_no::INTEGER AS line_no, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS part, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY doc_id, sp ORDER BY line_no), '') AS book,
       coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id, sb ORDER BY line_no), '') AS chapter FROM s""",
        "paragraph_split": f"""WITH {_LINES}, s AS (SELECT *, sum(CASE WHEN line_no > 0 AND starts_with({_S("text")}, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM lines),
p AS (SELECT doc_id, i, {_S("string_agg(text, chr(10) ORDER BY line_no)")} AS p FROM s GROUP BY doc_id, i)
SELECT doc_id, i::INTEGER AS i, length(p)::INTEGER AS n_chars, md5(p) AS md5 FROM p""",
        "run_collapse": f"WITH {_ARTICLES} SELECT min(n)::INTEGER AS lo, max(n)::INTEGER AS hi, count(*) AS n FROM sized WHERE rep GROUP BY run",
        "chunk_build": f"WITH {_CHUNKS} SELECT chunk_id, numbers, paragraph_index, citation, rep AS is_repealed, md5(ar) AS ar, md5(en) AS en, flags FROM pieces",
        "chunk_coverage": f"WITH {_ARTICLES} SELECT n::INTEGER AS article_number, 'missing' AS problem FROM sized WHERE rep",
        "chunk_stats": f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(CASE WHEN kind = 'whole' THEN 1 END) AS whole_article, count(CASE WHEN kind = 'paragraph' THEN 1 END) AS paragraph, count(CASE WHEN kind = 'second' THEN 1 END) AS second_whole, count(CASE WHEN kind = 'run' THEN 1 END) AS repealed_run FROM pieces",
        "index_points": f"""WITH {_CHUNKS}, jobs AS (SELECT chunk_id, 'ar' AS lang, ar AS text FROM pieces UNION ALL SELECT chunk_id, 'en', en FROM pieces)
SELECT {_uuid("(chunk_id || '-' || lang)")} AS point_id, chunk_id, lang, length(text)::INTEGER AS n_chars FROM jobs WHERE {_S("text")} <> ''""",
        "numbering_gaps": f"""WITH {_ARTICLES}
SELECT CASE WHEN n IN (1000, 1001) THEN 'warning' ELSE 'error' END AS severity, CASE WHEN n IN (1000, 1001) THEN 'known gap' ELSE 'gap' END AS "check", n::INTEGER AS article_number FROM (SELECT unnest(range(1, 1201)) AS n) WHERE n NOT IN (SELECT n FROM articles)
UNION ALL SELECT 'error', 'outside range', n::INTEGER FROM articles WHERE n < 1 OR n > 1200
UNION ALL SELECT 'error', 'empty text_ar', n::INTEGER FROM articles WHERE {_S("ar")} = ''
UNION ALL SELECT 'error', 'empty text_en', n::INTEGER FROM articles WHERE {_S("en")} = ''
UNION ALL SELECT 'warning', 'long text_ar', n::INTEGER FROM articles WHERE length(ar) > 6000
UNION ALL SELECT 'error', 'repeated number', n::INTEGER FROM articles GROUP BY n HAVING count(*) > 1
UNION ALL SELECT 'error', 'no repeal range', NULL FROM articles HAVING count(CASE WHEN regexp_matches(ar, 'المواد\\s+من\\s+([٠-٩]+)\\s+إلى\\s+([٠-٩]+)') THEN 1 END) = 0""",
        "validate_documents": f"WITH {_VIOLATIONS} SELECT doc_id, article_at::INTEGER AS article_at, message FROM found",
        "first_violation": f"WITH {_VIOLATIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(article_at, -1), rule) AS i FROM found) SELECT doc_id, article_at::INTEGER AS article_at, message FROM o WHERE i = 1",
        "pii_email_card": f"SELECT doc_id, len(regexp_extract_all({_OWN.format('text')}, '{_EMAIL}'))::BIGINT AS n_email, len({_cards(_OWN.format('text'))})::BIGINT AS n_card FROM documents",
        "pii_pages": f"SELECT page_id, len(regexp_extract_all({_OWN.format('html')}, '{_EMAIL}'))::BIGINT AS n_email FROM pages",
        "pii_redact": f"""WITH c AS (SELECT doc_id, regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g') AS t, regexp_matches({_OWN.format('text')}, '{_EMAIL}') AS e, {_cards(_OWN.format('text'))} AS cards FROM documents)
SELECT doc_id, md5(list_reduce(cards, lambda a, x: replace(a, x, '[CREDIT_CARD]'), t)) AS md5, CASE WHEN len(cards) > 0 AND e THEN 'CREDIT_CARD,EMAIL' WHEN len(cards) > 0 THEN 'CREDIT_CARD' WHEN e THEN 'EMAIL' ELSE '' END AS entities FROM c""",
        "pii_counts": f"""WITH u AS (SELECT 'documents' AS place, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations),
f AS (SELECT place, regexp_matches({_OWN.format('text')}, '{_EMAIL}') AS e, len({_cards(_OWN.format('text'))}) > 0 AS c FROM u)
SELECT place, 'EMAIL' AS entity, count(*) AS n FROM f WHERE e GROUP BY place UNION ALL SELECT place, 'CREDIT_CARD', count(*) FROM f WHERE c GROUP BY place""",
        "eval_mean_scores": f"""WITH {_EVAL}, {_MEANS}
SELECT config, round(faithfulness, 6) AS faithfulness, nf AS faithfulness_n_scored, round(context_precision, 6) AS context_precision, np AS context_precision_n_scored, round(context_recall, 6) AS context_recall, nr AS context_recall_n_scored,
       round(answer_relevancy, 6) AS answer_relevancy, na AS answer_relevancy_n_scored, round(article_hit_rate, 6) AS article_hit_rate, round(refusal_rate, 6) AS refusal_rate, round(false_refusal_rate, 6) AS false_refusal_rate FROM means""",
        "eval_stratum_means": f"WITH {_EVAL} SELECT category, language, round(avg(f), 3) AS faithfulness FROM ev GROUP BY category, language",
        "article_hit_rate": """SELECT lang, round(avg((doc_id % 10 = n_chars % 10 OR doc_id % 10 = n_chars % 7)::INTEGER) FILTER (doc_id % 3 <> 0), 6) AS hit_rate, count(CASE WHEN doc_id % 3 <> 0 THEN 1 END) AS n FROM documents GROUP BY lang""",
        "best_of_config": f"""WITH {_EVAL}, {_MEANS}, o AS (SELECT *, row_number() OVER (ORDER BY config NULLS FIRST) AS pos FROM means),
w AS (SELECT * FROM o ORDER BY coalesce(faithfulness, -1) DESC, coalesce(context_precision, -1) DESC, coalesce(article_hit_rate, -1) DESC, pos LIMIT 1), i AS (SELECT * FROM o WHERE pos = 1)
SELECT CASE WHEN coalesce(w.faithfulness - i.faithfulness < 0.05, false) THEN i.config ELSE w.config END AS config, round(CASE WHEN coalesce(w.faithfulness - i.faithfulness < 0.05, false) THEN i.faithfulness ELSE w.faithfulness END, 6) AS faithfulness FROM w CROSS JOIN i""",
        "ci_subset": f"""WITH {_EVAL}, r AS (SELECT *, row_number() OVER (PARTITION BY category, language ORDER BY id) AS rn FROM ev)
SELECT id, category, language FROM r WHERE rn <= CASE WHEN category = 'substantive' AND language = 'en' THEN 4 WHEN category = 'substantive' AND language = 'fr' THEN 3 WHEN category = 'article_lookup' AND language = 'en' THEN 2 WHEN category = 'out_of_corpus' AND language IN ('en', 'de') THEN 2 ELSE 0 END""",
        "release_gate": f"""WITH {_EVAL},
x AS (SELECT count(CASE WHEN category = 'out_of_corpus' AND language <> 'fr' AND declined THEN 1 END) AS declined, count(CASE WHEN category = 'out_of_corpus' THEN 1 END) AS expected_declines, count(f) FILTER (category <> 'out_of_corpus' AND language <> 'fr') AS scored,
             count(CASE WHEN category <> 'out_of_corpus' THEN 1 END) AS expected_scored, avg(f) FILTER (category <> 'out_of_corpus' AND language <> 'fr') AS faithfulness FROM ev),
y AS (SELECT *, list_filter([CASE WHEN expected_declines > 0 AND declined < 0.75 * expected_declines THEN 'too few declined' END, CASE WHEN scored < 0.8 * expected_scored THEN 'too few scored' END, CASE WHEN faithfulness < 0.75 THEN 'faithfulness below the threshold' END, 'stale embedding'], lambda m: m IS NOT NULL) AS fails FROM x)
SELECT declined, expected_declines, scored, expected_scored, round(faithfulness, 6) AS faithfulness, array_to_string(fails, '|') AS failures, len(fails) = 0 AS passed FROM y""",
        "faithfulness_gauge": f"WITH {_EVAL} SELECT round(avg(f), 6) AS value FROM ev WHERE category <> 'out_of_corpus' HAVING count(f) > 0",
        "low_spread": f"""WITH {_EVAL}, s AS (SELECT 'faithfulness' AS metric, stddev_samp(f) AS std FROM ev UNION ALL SELECT 'context_precision', stddev_samp(p) FROM ev UNION ALL SELECT 'context_recall', stddev_samp(r) FROM ev UNION ALL SELECT 'answer_relevancy', stddev_samp(a) FROM ev)
SELECT metric, round(std, 6) AS std, coalesce(std < 0.02, false) AS suspicious FROM s""",
        "latency_summary": f"""WITH {_LAT}
SELECT variant, round(quantile_disc(l, 0.5), 6) AS latency_p50_s, round(quantile_disc(l, 0.95), 6) AS latency_p95_s, round(quantile_disc(t, 0.5), 6) AS ttft_p50_s, round(quantile_disc(t, 0.95), 6) AS ttft_p95_s, round(quantile_disc(r, 0.5), 6) AS tokens_per_s_p50 FROM lat GROUP BY variant""",
        "quality_compare": f"""WITH {_LAT}, {_EVAL}, l AS (SELECT variant, quantile_disc(l, 0.5) AS p FROM lat GROUP BY variant), s AS (SELECT (id % 2)::VARCHAR AS variant, avg(f) AS f FROM ev WHERE category <> 'out_of_corpus' GROUP BY 1)
SELECT round(a.f - b.f, 6) AS faithfulness_drop, coalesce(a.f - b.f < 0.03, false) AS passed, round(x.p / y.p, 6) AS speedup_latency_p50, 2.5::DOUBLE AS speedup_concurrent_rps
FROM s a, s b, l x, l y WHERE a.variant = '0' AND b.variant = '1' AND x.variant = '0' AND y.variant = '1'""",
        "recall_at_3": f"WITH {_KNN}, h AS (SELECT query_id, max((label = query_label)::INTEGER) AS hit FROM knn WHERE rank <= 3 GROUP BY query_id) SELECT round(avg(hit), 6) AS recall FROM h",
        "header_attribution": f"WITH {_LOG} SELECT release, count(*) AS n FROM log GROUP BY release",
        "canary_report": f"WITH {_LOG} SELECT release, requests, errors, ask_n, round(ask_p95, 6) AS ask_p95, round(requests / sum(requests) OVER (), 6) AS share, round(errors / requests, 6) AS error_rate FROM stats",
        "canary_gates": f"""WITH {_LOG}, s AS (SELECT * FROM stats WHERE release = 'stable-1'), c AS (SELECT * FROM stats WHERE release = 'canary-2')
SELECT 'enough canary traffic' AS gate, c.ask_n >= 20 AS passed FROM c UNION ALL SELECT 'error rate', c.errors / c.requests <= s.errors / s.requests + 0.01 FROM s, c UNION ALL SELECT 'p95 latency', coalesce(c.ask_p95 <= s.ask_p95 * 1.2, false) FROM s, c""",
        "latency_histogram": f"WITH {_BUCKETS} SELECT event_type, CASE WHEN isinf(le) THEN '+Inf' ELSE format('{{:.1f}}', le) END AS le, cum_count FROM buckets",
        "histogram_quantile": f"""WITH {_BUCKETS}, w AS (SELECT *, coalesce(lag(le) OVER p, 0) AS lo, coalesce(lag(cum_count) OVER p, 0) AS before, max(cum_count) OVER (PARTITION BY event_type) AS total FROM buckets WINDOW p AS (PARTITION BY event_type ORDER BY le)),
h AS (SELECT *, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95::DOUBLE * total - before) / nullif(cum_count - before, 0) END AS v FROM w WHERE cum_count >= 0.95::DOUBLE * total)
SELECT event_type, round(arg_min(v, le), 6) AS value FROM h GROUP BY event_type""",
        "stage_means": """WITH s AS (SELECT event_type AS stage, sum(floor(value)) FILTER (event_id % 2 = 0) AS s, sum(floor(value)) FILTER (event_id % 2 = 1) AS c FROM events WHERE NOT (event_type = 'view' AND event_id % 2 = 1) GROUP BY 1)
SELECT stage, coalesce(c, 0)::BIGINT AS count, round(CASE WHEN c <> 0 THEN coalesce(s, 0) / c END, 6) AS mean_s FROM s""",
        "rate_5m": """WITH c AS (SELECT event_type, date_trunc('minute', ts) AS ts, (sum(floor(value)) % 97)::DOUBLE AS v FROM events GROUP BY 1, 2),
x AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM c)
SELECT time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS window_start, event_type, sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) AS increase, round(sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) / 300, 6) AS rate FROM x GROUP BY 1, 2""",
        "cost_per_hour": "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, round(count(*) / 3600.0::DOUBLE * 3600 / 1000 * 0.25, 6) AS cost FROM events GROUP BY 1, 2",
        "error_ratio_alert": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, round(count(CASE WHEN event_type = 'error' THEN 1 END) / count(*), 6) AS ratio, count(CASE WHEN event_type = 'error' THEN 1 END) / count(*) > 0.05 AS firing FROM events GROUP BY 1",
        "alert_held_for": """WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) > 40 AS c FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts) AS run FROM h)
SELECT event_type, ts, c AND epoch(ts) - epoch(min(ts) FILTER (c) OVER (PARTITION BY event_type, run ORDER BY ts)) >= 10800 AS firing FROM r""",
        "throughput": "SELECT event_type, count(*) AS amount, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS per_s FROM events GROUP BY 1",
        "length_stats_floor_pct": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
p AS (SELECT lang, any_value(n_chars) AS p90 FROM r WHERE i = least(floor(n * 90 / 100), n - 1) GROUP BY lang)
SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, round(stddev_samp(n_chars), 6) AS std, quantile_cont(n_chars, 0.25) AS p25, any_value(p90) AS p90 FROM documents JOIN p USING (lang) GROUP BY lang""",
        "bench_p95": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, n_chars AS value FROM r WHERE i = greatest(0, floor(0.95::DOUBLE * n) - 1)""",
        "fixed_width_histogram": "SELECT floor(n_chars / 500)::BIGINT AS bucket, count(*) AS n FROM documents GROUP BY 1",
        "duplicate_detection": "SELECT md5(text) AS md5, round_even(n_chars / 10.0::DOUBLE, 1) AS x, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
        "index_upsert_stale_delete": f"WITH {_VERSIONS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id <> 'src3' OR doc_id IS NULL",
        "index_stale_ids": f"WITH {_VERSIONS} SELECT point_id FROM old WHERE doc_id = 'src3' AND point_id NOT IN (SELECT point_id FROM new)",
        "index_counts": "SELECT source AS doc_id, count(*) AS points FROM documents GROUP BY source",
        "disjointness": "SELECT count(*) AS n_common FROM documents WHERE text IN (SELECT text FROM benchmark)",
    }
    first = "first AS (SELECT doc_id AS n, coalesce(text, '') AS text, n_chars AS page, source AS book FROM documents WHERE n_chars % 3 <> 0), second AS (SELECT doc_id AS n, coalesce(text, '') AS text FROM documents WHERE n_chars % 5 <> 0)"
    num = lambda x, na: f"CASE WHEN n_chars % {na} > 1 THEN ({x})::DOUBLE END"
    out |= {
        "split_positions": """WITH w AS (SELECT user_id AS page, floor(value)::BIGINT AS lo, least(500, floor(value + 2))::BIGINT AS hi FROM events),
used AS (SELECT DISTINCT page, unnest(range(lo, hi + 1)) AS bin FROM w), free AS (
  SELECT page, bin FROM (SELECT DISTINCT page FROM w) CROSS JOIN (SELECT unnest(range(75, 426)) AS bin) EXCEPT SELECT page, bin FROM used),
runs AS (SELECT page, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS run, bin FROM free),
sized AS (SELECT page, min(bin) AS first, count(*) AS len FROM runs GROUP BY page, run),
best AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY len DESC, first) AS i FROM sized)
SELECT p.page, coalesce(first + len / 2, 250.0::DOUBLE) AS split_x FROM (SELECT DISTINCT page FROM w) p LEFT JOIN best b ON b.page = p.page AND b.i = 1""",
        "row_clusters": """WITH RECURSIVE w AS (SELECT user_id AS page, value AS top FROM events),
a AS (SELECT page, min(top) AS anchor, 1 AS i FROM w GROUP BY page
      UNION ALL SELECT a.page, min(w.top), any_value(a.i) + 1 FROM a JOIN w ON w.page = a.page AND abs(w.top - a.anchor) > 3 AND w.top > a.anchor GROUP BY a.page)
SELECT a.page, max(i)::INTEGER AS n_rows, (SELECT count(*) FROM w WHERE w.page = a.page)::INTEGER AS n_words FROM a GROUP BY a.page""",
        "merge_records": f"WITH {first} SELECT n::INTEGER AS article_number, book, md5(f.text) AS ar, md5(s.text) AS en, false AS is_repealed, page::INTEGER AS source_page, 'Law, Article ' || n AS citation FROM first f JOIN second s USING (n)",
        "merge_errors": f"""WITH {first}, e AS (SELECT n, 'missing-english' AS error FROM first WHERE n NOT IN (SELECT n FROM second) UNION ALL SELECT n, 'missing-arabic' FROM second WHERE n NOT IN (SELECT n FROM first))
SELECT n::INTEGER AS article_number, error, n NOT IN (SELECT doc_id FROM labels) AS blocking FROM e""",
        "fill_repealed": f"""WITH {first}, place AS (SELECT unnest(range(doc_id, doc_id + 4)) AS n, doc_id FROM labels WHERE toxic = 1), one AS (SELECT n, min(doc_id) AS d FROM place WHERE n NOT IN (SELECT n FROM first) GROUP BY n)
SELECT n::INTEGER AS article_number, md5(text) AS md5 FROM first UNION ALL SELECT n::INTEGER, md5('notice ' || d) FROM one""",
        "patched_articles": f"""WITH {first}, r AS (SELECT n, book, f.text AS ar, s.text AS en, page FROM first f JOIN second s USING (n)), p AS (SELECT doc_id AS n, CASE WHEN quality = 1 THEN 'patched' END AS ar, toxic = 1 AS rep FROM labels)
SELECT r.n::INTEGER AS article_number, r.book, md5(coalesce(p.ar, r.ar)) AS ar, md5(r.en) AS en, coalesce(p.rep, false) AS is_repealed, r.page::INTEGER AS source_page, CASE WHEN p.n IS NOT NULL THEN 'manually_patched' ELSE '' END AS flags FROM r LEFT JOIN p USING (n)
UNION ALL SELECT p.n::INTEGER, coalesce(b.book, a.book, ''), md5(coalesce(p.ar, '')), md5(''), p.rep, coalesce(b.page, a.page, 0)::INTEGER, 'manually_patched'
FROM p LEFT JOIN r b ON b.n = p.n - 1 LEFT JOIN r a ON a.n = p.n + 1 WHERE p.n NOT IN (SELECT n FROM r)""",
        "alert_lines": """SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || CASE WHEN event_type = 'error' THEN 'FIRING' ELSE 'RESOLVED' END || ' ' || CASE WHEN value > 100 THEN 'critical' ELSE '-' END || ' ' || event_type
       || CASE WHEN user_id % 3 = 0 THEN ' window=' || user_id ELSE '' END || ': ' || CASE WHEN user_id % 2 = 0 THEN coalesce(props, '') ELSE '' END AS line FROM events""",
        "grouped_alerts": """WITH h AS (SELECT event_type AS alertname, date_trunc('hour', ts)::TIMESTAMP AS ts, CASE WHEN avg(value) > 50 THEN 'firing' ELSE 'resolved' END AS status FROM events GROUP BY 1, 2),
g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER w) AS gap, lag(status) OVER w AS was FROM h WINDOW w AS (PARTITION BY alertname ORDER BY ts))
SELECT alertname, ts, status, gap IS NULL OR (was IS DISTINCT FROM status AND gap >= 60) OR gap >= CASE WHEN alertname = 'error' THEN 3600 ELSE 14400 END AS notify FROM g""",
        "load_summary": f"""WITH x AS (SELECT coalesce({num("n_chars", 11)}, 0)::BIGINT AS requests, coalesce({num("n_chars % 10", 13)}, 0)::BIGINT AS failures, {num("n_chars / 4", 7)} AS rps, coalesce({num("n_chars", 3)}, 0) / 1000 AS p50_s,
       coalesce({num("n_chars * 2", 5)}, 0) / 1000 AS p95_s, coalesce({num("n_chars * 3", 5)}, 0) / 1000 AS p99_s, coalesce({num("n_chars * 4", 9)}, 0) / 1000 AS max_s FROM documents WHERE lang = 'en')
SELECT *, round(CASE WHEN requests > 0 THEN failures / requests END, 6) AS failure_rate FROM x""",
        "drift_gauges": f"""WITH o AS ({out["off_corpus_share"]}), {_UNIT}, n AS (SELECT w, count(*) AS n FROM windows GROUP BY w)
SELECT "window", 'off_corpus_share' AS gauge, off_corpus_share AS value FROM o UNION ALL SELECT "window", 'off_corpus_limit', round(low_similarity_limit / n, 6) FROM o JOIN n ON o."window" = n.w""",
    }
    out["knn_top8_arrow"] = out["knn_bounded_top8"] = out["knn_top8"]
    from quern.plans.flow_sql import flow_sql

    return out | flow_sql(out)
