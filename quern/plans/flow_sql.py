"""SQL that DuckDB runs on the same tables for the queries of flows.py."""

from __future__ import annotations

from quern.functions import text as T
from quern.operators import ops
from quern.plans.config import HIGH_MEAN
from quern.streaming import channel
from quern.plans.oracle import _CHUNKS, _EMAIL, _EVAL, _KNN, _LAT, _LOG, _MEANS, _OWN, _S, _UNIT, _cards, _uuid

_POINTS = f"""raw_points AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, (vec_id // 2)::VARCHAR AS chunk, CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'ar' END AS lang,
         CASE WHEN vec_id // 2 % 3 = 0 THEN 'other' ELSE '{T.PRIMARY_DOC}' END AS doc, label, vec_id // 2 % 5 = 0 AS repealed FROM embeddings),
points AS (SELECT *, {_uuid(f"(CASE WHEN doc = '{T.PRIMARY_DOC}' THEN chunk || '-' || lang ELSE doc || ':' || chunk || '-' || lang END)")} AS point_id FROM raw_points)"""
_ASKED = """asked AS (
  SELECT vec_id AS query_id, list_reverse(embedding::DOUBLE[]) AS q,
         CASE WHEN vec_id % 400 = 300 THEN '  ' WHEN vec_id % 150 = 0 THEN 'Is Article ' || label || ' in force?' WHEN vec_id % 150 = 50 THEN 'ما حكم المادة ' || vec_id % 7 ELSE 'who pays? mail a@b.co' END AS question,
         CASE WHEN vec_id % 400 = 300 THEN NULL WHEN vec_id % 150 = 0 THEN label WHEN vec_id % 150 = 50 THEN vec_id % 7 END AS number,
         CASE WHEN vec_id % 400 <> 300 AND vec_id % 150 = 50 THEN 'ar' ELSE 'en' END AS qlang
  FROM embeddings WHERE vec_id % 50 = 0)"""
_SPOKEN = """asked AS (
  SELECT c.query_id, list_reverse(e.embedding::DOUBLE[]) AS q, CASE WHEN c.query_id % 3 = 0 THEN 'Is Article ' || c.query_id % 7 || ' in force?' ELSE c.first END AS question,
         CASE WHEN c.query_id % 3 = 0 THEN c.query_id % 7 END AS number, 'en' AS qlang,
         CASE WHEN c.query_id % 4 = 1 THEN 'Mail ann.b@law.org or pay from 4111 1111 1111 1111 now. ' ELSE '' END || c.said AS whole
  FROM (SELECT conv_id AS query_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS said, arg_min(text, turn) FILTER (role = 'user') AS first FROM conversations GROUP BY conv_id) c
  JOIN embeddings e ON e.vec_id = c.query_id)"""
_HASHED = "list_transform(range(16), lambda i: ('0x' || substr(md5(i || '|' || {0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5)"
_HITS = f"""{_POINTS}, {_ASKED},
pairs AS (SELECT a.query_id, a.question, a.number, a.qlang, p.*, list_cosine_similarity(a.q, p.v) AS score FROM asked a CROSS JOIN points p),
lanes AS (
  SELECT *, 0 AS lane, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM pairs WHERE doc = '{T.PRIMARY_DOC}' AND label = number
  UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) FROM pairs),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY lane, rank) AS rn FROM lanes WHERE rank <= 8),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lane, rank) AS place FROM firsts WHERE rn = 1),
hits AS (
  SELECT h.query_id, h.question, h.number, h.qlang, h.place, h.lane, h.score, coalesce(t.point_id, h.point_id) AS point_id, coalesce(t.lang, h.lang) AS lang, h.doc, coalesce(t.label, h.label) AS label,
         coalesce(t.repealed, h.repealed) AS repealed, coalesce(t.vec_id, h.vec_id) AS vec_id
  FROM placed h LEFT JOIN points t ON h.lang <> h.qlang AND t.chunk = h.chunk AND t.doc = h.doc AND t.lang = h.qlang WHERE h.place <= 3)"""


def _said(least: str) -> str:
    return f"""{_HITS},
best AS (SELECT query_id, max(score) AS best, coalesce(bool_or(doc = '{T.PRIMARY_DOC}' AND label = number), false) AS exempt, string_agg('Law, Article ' || label, '|' ORDER BY place) AS sources FROM hits GROUP BY query_id),
said AS (
  SELECT a.query_id, a.qlang, CASE WHEN trim(a.question) = '' THEN 'invalid' WHEN b.best IS NULL THEN 'no_context' WHEN NOT b.exempt AND b.best < {least} THEN 'refused' ELSE 'answered' END AS status, b.sources
  FROM asked a LEFT JOIN best b USING (query_id)),
told AS (
  SELECT query_id, status, CASE status WHEN 'answered' THEN 'Answer ' || query_id || ', write to [EMAIL]' WHEN 'refused' THEN CASE WHEN qlang = 'ar' THEN '{T.REFUSAL_TEXT["ar"]}' ELSE '{T.REFUSAL_TEXT["en"]}' END END AS answer,
         CASE WHEN status = 'answered' THEN sources ELSE '' END AS sources, CASE WHEN status = 'answered' THEN 'EMAIL' ELSE '' END AS entities
  FROM said)"""


_CONTEXT = "'[Law, Article ' || label || ']' || CASE WHEN repealed THEN ' (REPEALED -- no longer in force)' ELSE '' END || chr(10) || 'text ' || vec_id"
_AR = lambda x: f"translate(({x})::VARCHAR, '0123456789', '{T.ARABIC_DIGITS}')"
_N = "numbered AS (SELECT doc_id::VARCHAR AS doc, (doc_id % 90 + 1)::INTEGER AS n, md5(coalesce(text, '')) AS m FROM documents)"
_EXPO = "x AS (SELECT event_type, user_id % 2 AS service, count(*) AS n, sum(floor(value)) AS s FROM events GROUP BY 1, 2)"
_STORED = "stored AS (SELECT vec_id, 'law' || label % 3 AS doc_id, label, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"
_DRIFT = f"""{_UNIT},
both_ AS (SELECT w AS g, id, v FROM windows UNION ALL SELECT 'base', id, v FROM base),
dims AS (SELECT g, unnest(range(len(v))) AS dim, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM both_),
centres AS (SELECT g, dim, avg(x) AS x FROM dims GROUP BY g, dim),
sims AS (SELECT a.g AS w, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS c FROM centres a JOIN centres b ON a.dim = b.dim AND b.g = 'base' AND a.g <> 'base' GROUP BY a.g),
drifts AS (SELECT w, (SELECT count(*) FROM windows x WHERE x.w = s.w) AS n, c, 1 - c AS drift, CASE w WHEN '0' THEN 0.5::DOUBLE WHEN '1' THEN 0.9 ELSE 0.7 END AS threshold FROM sims s)"""
_SCORES = ", ".join(f"{float(b)!r}::DOUBLE" for b in ops.SCORE_BOUNDS)


def _table(title: str, head: list[str], cells: list[str], order: str, source: str) -> str:
    line = " || ' | ' || ".join(cells)
    top = f"# {title}', '', '| {' | '.join(head)} |', '|{'---|' * len(head)}"
    return f"SELECT array_to_string(['{top}', string_agg('| ' || {line} || ' |', chr(10) ORDER BY {order}), ''], chr(10)) AS text FROM {source}"


def _quantile(q: str) -> str:
    return f"""w AS (SELECT *, coalesce(lag(le) OVER p, 0) AS lo, coalesce(lag(cum_count) OVER p, 0) AS before, max(cum_count) OVER (PARTITION BY g) AS total FROM buckets WINDOW p AS (PARTITION BY g ORDER BY le)),
h AS (SELECT *, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * ({q}::DOUBLE * total - before) / nullif(cum_count - before, 0) END AS v FROM w WHERE cum_count >= {q}::DOUBLE * total),
q AS (SELECT g, arg_min(v, le) AS value FROM h GROUP BY g)"""


def flow_sql(out: dict[str, str]) -> dict[str, str]:
    bounds = ", ".join(f"{float(b)!r}::DOUBLE" for b in ops.LATENCY_BOUNDS)
    return {
        "retrieve_contexts": f"WITH {_HITS} SELECT query_id, place, lane, point_id, lang, doc AS doc_id, label::VARCHAR AS numbers, round(score, 6) AS score FROM hits",
        "twin_lookup": f"""WITH {_POINTS} SELECT p.point_id AS was, coalesce(t.point_id, p.point_id) AS point_id, coalesce(t.lang, p.lang) AS lang, 'text ' || coalesce(t.vec_id, p.vec_id) AS text, 0.5::DOUBLE AS score
FROM points p LEFT JOIN points t ON t.chunk = p.chunk AND t.doc = p.doc AND t.lang <> p.lang AND NOT (t.doc = 'other' AND t.lang = 'ar')""",
        "bucketed_twins": f"""WITH {_POINTS} SELECT p.point_id AS was, coalesce(t.point_id, p.point_id) AS point_id, coalesce(t.lang, p.lang) AS lang, 'text ' || coalesce(t.vec_id, p.vec_id) AS text, 0.5::DOUBLE AS score
FROM points p LEFT JOIN points t ON t.chunk = p.chunk AND t.doc = p.doc AND t.lang <> p.lang AND NOT (t.doc = 'other' AND t.lang = 'ar')""",
        "ask_batch": f"WITH {_said('0.3')} SELECT * FROM told",
        "ask_stream": f"""WITH {_said("0.3").replace(_ASKED, _SPOKEN)},
redacted AS (
  SELECT query_id, {_cards(_OWN.format("whole"))} AS cards, {_cards(_OWN.format("question"))} AS asked_cards, regexp_matches({_OWN.format("whole")}, '{_EMAIL}') AS mail, regexp_matches({_OWN.format("question")}, '{_EMAIL}') AS asked_mail,
         regexp_replace(whole, '{_EMAIL}', '[EMAIL]', 'g') AS t
  FROM asked),
ends AS (
  SELECT s.query_id, s.status, '["' || replace(s.sources, '|', '", "') || '"]' AS shown, s.status = 'answered' AND s.query_id % 10 = 3 AS failed, s.status = 'answered' AND s.query_id % 10 = 7 AS silent,
         CASE WHEN s.status = 'answered' THEN list_reduce(r.cards, lambda a, x: replace(a, x, '[CREDIT_CARD]'), r.t) WHEN s.qlang = 'ar' THEN '{T.REFUSAL_TEXT["ar"]}' ELSE '{T.REFUSAL_TEXT["en"]}' END AS text,
         CASE WHEN len(r.asked_cards) > 0 OR (s.status = 'answered' AND len(r.cards) > 0) THEN ['CREDIT_CARD'] ELSE [] END || CASE WHEN r.asked_mail OR (s.status = 'answered' AND r.mail) THEN ['EMAIL'] ELSE [] END AS found
  FROM said s JOIN redacted r USING (query_id))
SELECT query_id, status, true AS in_order, CASE WHEN NOT failed THEN md5(text) END AS text,
       CASE WHEN failed THEN '{{"type": "error", "message": "{channel.FAILED}"}}' WHEN silent THEN '{{"type": "error", "message": "{channel.TIMED_OUT}"}}'
            ELSE '{{"type": "done", "sources": ' || CASE WHEN status = 'answered' THEN shown ELSE '[]' END || ', "pii_redacted": [' || array_to_string(list_transform(found, lambda x: '"' || x || '"'), ', ') || ']}}' END AS ending
FROM ends""",
        "request_counters": f"""WITH {_said("0.3")},
best_ AS (SELECT b.best FROM best b JOIN said s USING (query_id) WHERE s.status <> 'invalid'),
samples AS (
  SELECT 'rag_requests_total' AS metric, 'batch|' || CASE status WHEN 'answered' THEN 'ok' WHEN 'invalid' THEN 'error' ELSE status END || '|-|-|-|-' AS labels, count(*)::DOUBLE AS value FROM said GROUP BY status
  UNION ALL SELECT 'rag_pii_redactions_total', 'batch|-|question|EMAIL|-|-', count(*) FROM asked WHERE regexp_matches({_OWN.format("question")}, '{_EMAIL}')
  UNION ALL SELECT 'rag_pii_redactions_total', 'batch|-|answer|EMAIL|-|-', count(*) FROM said WHERE status = 'answered'
  UNION ALL SELECT 'rag_retrieval_top_score_bucket', 'batch|-|-|-|-|' || b::DOUBLE::VARCHAR, count(CASE WHEN best <= b THEN 1 END) FROM best_, (SELECT unnest([{_SCORES}]) AS b) GROUP BY b
  UNION ALL SELECT 'rag_retrieval_top_score_bucket', 'batch|-|-|-|-|+Inf', count(*) FROM best_
  UNION ALL SELECT 'rag_retrieval_top_score_sum', 'batch|-|-|-|-|-', round(sum(best), 4) FROM best_
  UNION ALL SELECT 'rag_retrieval_top_score_count', 'batch|-|-|-|-|-', count(*) FROM best_)
SELECT * FROM samples WHERE value <> 0""",
        "stream_counters": f"""WITH samples AS (
  SELECT 'rag_requests_total' AS metric, 'events|' || CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'refused' ELSE 'ok' END || '|-|-|-|-' AS labels, count(*)::DOUBLE AS value FROM events GROUP BY ALL
  UNION ALL SELECT 'rag_request_latency_seconds_bucket', 'events|-|-|-|total|' || b::DOUBLE::VARCHAR, count(CASE WHEN value <= b THEN 1 END) FROM events, (SELECT unnest([{", ".join(f"{float(b)!r}::DOUBLE" for b in ops.LATENCY_BOUNDS)}]) AS b) GROUP BY b
  UNION ALL SELECT 'rag_request_latency_seconds_bucket', 'events|-|-|-|total|+Inf', count(value) FROM events
  UNION ALL SELECT 'rag_request_latency_seconds_sum', 'events|-|-|-|total|-', round(sum(value), 4) FROM events
  UNION ALL SELECT 'rag_request_latency_seconds_count', 'events|-|-|-|total|-', count(value) FROM events)
SELECT * FROM samples WHERE value <> 0""",
        "embedded_index_knn": f"""WITH {_CHUNKS}, jobs AS (SELECT chunk_id, 'ar' AS lang, ar AS text FROM pieces UNION ALL SELECT chunk_id, 'en', en FROM pieces),
points AS (SELECT chunk_id, lang, {_uuid("(chunk_id || '-' || lang)")} AS point_id, {_HASHED.format("text")} AS v FROM jobs WHERE {_S("text")} <> ''),
asked AS (SELECT doc_id AS query_id, {_HASHED.format("('Is Article ' || doc_id || ' in force?')")} AS q FROM documents WHERE doc_id % 50 = 0),
ranked AS (SELECT query_id, chunk_id, lang, list_cosine_similarity(q, v) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q, v) DESC, point_id) AS rank FROM asked CROSS JOIN points)
SELECT query_id, rank::INTEGER AS rank, chunk_id, lang, round(score, 6) AS score FROM ranked WHERE rank <= 3""",
        "read_first_statistics": """WITH first AS (
  SELECT coalesce(source, 'none') AS run, arg_min(n_chars, doc_id) AS n FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT run, n::BIGINT AS requests, (CASE WHEN n % 3 = 0 THEN 0 ELSE n % 10 END)::BIGINT AS failures, CASE WHEN n > 0 THEN round((CASE WHEN n % 3 = 0 THEN 0 ELSE n % 10 END) / n, 6) END AS failure_rate, n / 1000.0::DOUBLE AS max_s FROM first""",
        "read_first_lines": f"WITH {_LOG}, firsts AS (SELECT * FROM log ORDER BY event_id LIMIT 100) SELECT uri, status::INTEGER AS status, count(*) AS n FROM firsts GROUP BY ALL",
        "read_server_log": "SELECT event_type AS server, max(event_id * 7) FILTER (event_id % 3 = 0) AS tokens FROM events GROUP BY event_type",
        "calibration_rows": f"WITH {_said('0.3')} SELECT b.query_id, round(b.best, 4) AS top_score, b.exempt FROM best b JOIN said s USING (query_id) WHERE s.status <> 'invalid'",
        "alert_line_log": f"SELECT line FROM ({out['alert_lines']})",
        "range_rates": """WITH c AS (
  SELECT event_type, ts, epoch(date_trunc('second', ts))::BIGINT AS s, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) % 500)::DOUBLE AS v FROM events WHERE event_type IS NOT NULL),
g AS (SELECT *, CASE WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS grown FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
seen AS (SELECT event_type, ts, grown, l, unnest(range((ceil(s / 15.0) * 15)::BIGINT, (ceil((s + l) / 15.0) * 15)::BIGINT, 15)) AS at_ FROM g, (SELECT unnest([300, 900, 3600]) AS l)),
found AS (SELECT event_type, l, at_, count(*) AS n, coalesce(sum(grown), 0) - coalesce(arg_min(coalesce(grown, 0), ts), 0) AS inc FROM seen GROUP BY event_type, l, at_)
SELECT event_type, l::INTEGER AS lookback, strftime(make_timestamp(at_ * 1000000), '%Y-%m-%d') AS day, count(*) AS steps, sum(inc) AS increase, round(max(inc / l), 6) AS most FROM found WHERE n > 1 GROUP BY ALL""",
        "score_median_15m": f"""WITH e AS (SELECT event_id, ts, epoch(date_trunc('second', ts))::BIGINT AS s, least(value / 100, 1.0) AS score FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
seen AS (SELECT e.*, unnest(range((ceil(s / 15.0) * 15)::BIGINT, (ceil((s + 900) / 15.0) * 15)::BIGINT, 15)) AS at_ FROM e),
later AS (SELECT *, row_number() OVER (PARTITION BY at_ ORDER BY ts, event_id) AS i FROM seen),
cum AS (SELECT at_, le, count(CASE WHEN score <= le THEN 1 END) AS c, max(score) AS m FROM later, (SELECT unnest([{_SCORES}, 'Infinity'::DOUBLE]) AS le) WHERE i > 1 GROUP BY at_, le),
stepped AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS was, max(c) OVER (PARTITION BY at_) AS total FROM cum WINDOW w AS (PARTITION BY at_ ORDER BY le)),
hit AS (SELECT at_, arg_min(CASE WHEN le = 'Infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * (0.5 * total - was) / nullif(c - was, 0) END, le) AS value FROM stepped WHERE c >= 0.5 * total AND was < 0.5 * total GROUP BY at_)
SELECT strftime(make_timestamp(at_ * 1000000), '%Y-%m-%d') AS day, count(*) AS steps, round(avg(value), 5) AS median FROM hit WHERE value IS NOT NULL GROUP BY ALL""",
        "down_alert": """WITH u AS (SELECT user_id % 2 AS target, ts, epoch(date_trunc('second', ts))::BIGINT AS s, event_type <> 'error' AS up FROM events),
n AS (SELECT *, least(coalesce(lead(s) OVER (PARTITION BY target ORDER BY ts), s + 300), s + 300) AS until FROM u),
steps AS (SELECT target, up, unnest(range((ceil(s / 15.0) * 15)::BIGINT, (ceil(until / 15.0) * 15)::BIGINT, 15)) AS at_ FROM n WHERE ceil(s / 15.0) * 15 < until),
marked AS (SELECT *, up OR at_ - lag(at_, 1, at_) OVER w > 15 AS breaks, at_ - lag(at_, 1, at_) OVER w > 15 AS gap FROM steps WINDOW w AS (PARTITION BY target ORDER BY at_)),
runs AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY target ORDER BY at_) AS run FROM marked),
since AS (SELECT *, min(CASE WHEN NOT up THEN at_ END) OVER (PARTITION BY target, run ORDER BY at_) AS since FROM runs)
SELECT target, strftime(make_timestamp(at_ * 1000000), '%Y-%m-%d') AS day, count(*) AS steps, count(CASE WHEN NOT up AND at_ - since >= 60 THEN 1 END) AS firing FROM since GROUP BY ALL""",
        "varied_stream_articles": f"""WITH base AS (
  SELECT doc_id, doc_id::VARCHAR AS doc, (doc_id % 90 + 1)::INTEGER AS n, md5(coalesce(text, '')) AS m, coalesce(n_chars, 0) % 4 + 1 AS c FROM documents WHERE doc_id % 4 <> 1),
a AS (SELECT *, unnest(range(c)) AS j FROM base),
told AS (SELECT *, j = 1 AND doc_id % 3 = 0 AS inside FROM a)
SELECT doc, (n + 2 * j)::INTEGER AS article_number, md5('body ' || j || ' ' || m || CASE WHEN inside THEN chr(10) || 'المواد من ' || {_AR("n + 20")} || ' إلى ' || {_AR("n + 22")} || chr(10) || 'ملغاة' ELSE '' END) AS text,
       'الكتاب الأول' AS book, ((1 + 2 * j + CASE WHEN j > 1 AND doc_id % 3 = 0 THEN 2 ELSE 0 END) // 5)::INTEGER AS page, CASE WHEN inside THEN n + 20 END AS lo, CASE WHEN inside THEN n + 22 END AS hi, CASE WHEN inside THEN true END AS in_body FROM told""",
        "settings_of_tables": """SELECT (SELECT count(*) FROM labels)::INTEGER AS threshold, (SELECT count(*) % 2 = 0 FROM labels) AS dedupe, (SELECT min(lang) FROM documents) AS model, 9::INTEGER AS batch_size, (SELECT max(doc_id) % 10 / 10.0::DOUBLE FROM labels) AS min_score,
       (SELECT arg_min(md5(n_name), n_regionkey * 1000 + n_nationkey) FROM nation WHERE n_name[1] = 'C') AS md5""",
        "drift_alert_shifted": f"""WITH o AS ({out["off_corpus_share"].replace("AS w, score FROM knn", "AS w, score - CASE WHEN query_id // 50 % 3 = 2 THEN 0.5 ELSE 0 END AS score FROM knn")}), {_UNIT}, n AS (SELECT w, count(*) AS n FROM windows GROUP BY w)
SELECT "window", off_corpus_share FROM o JOIN n ON o."window" = n.w WHERE low_similarity_queries >= low_similarity_limit""",
        # changes are hours apart, so each is told ten seconds later and none waits for an interval
        "alert_notifications": f"""WITH seen AS (
  SELECT event_type AS alertname, (user_id % 4)::VARCHAR AS instance, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) > {HIGH_MEAN} AS firing FROM events GROUP BY 1, 2, 3),
hours AS (SELECT DISTINCT alertname, ts FROM seen),
held AS (
  SELECT h.alertname, h.ts, s.instance, arg_max(s.firing, s.ts) AS firing FROM hours h JOIN seen s ON s.alertname = h.alertname AND s.ts <= h.ts GROUP BY h.alertname, h.ts, s.instance),
sets AS (SELECT alertname, ts, coalesce(list(instance ORDER BY instance) FILTER (firing), []) AS f FROM held GROUP BY alertname, ts),
steps AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY alertname ORDER BY ts), []) AS before FROM sets),
changed AS (SELECT *, lead(ts) OVER (PARTITION BY alertname ORDER BY ts) AS upto FROM steps WHERE f <> before),
ends AS (SELECT max(ts) + INTERVAL 1 HOUR AS last FROM seen),
told AS (
  SELECT alertname, ts + INTERVAL 10 SECOND AS told_at, f AS firing, list_sort(list_filter(before, lambda x: NOT list_contains(f, x))) AS resolved FROM changed
  UNION ALL
  SELECT alertname, unnest(generate_series(ts + INTERVAL 10 SECOND + w, coalesce(upto, last) + INTERVAL 9 SECOND, w)), f, []
  FROM (SELECT *, CASE WHEN alertname = 'error' THEN INTERVAL 1 HOUR ELSE INTERVAL 4 HOUR END AS w FROM changed, ends) WHERE len(f) > 0)
SELECT CASE WHEN alertname = 'error' THEN 'critical' ELSE 'default' END AS route, alertname, told_at, CASE WHEN len(firing) > 0 THEN 'firing' ELSE 'resolved' END AS status,
       array_to_string(firing, ',') AS firing, array_to_string(resolved, ',') AS resolved
FROM told, ends WHERE told_at <= last""",
        "ask_without_threshold": f"WITH {_said('-2')} SELECT status, count(*) AS n FROM told GROUP BY status",
        "answer_events": f"""WITH {_said('0.3')},
listed AS (SELECT *, CASE WHEN sources = '' THEN '[]' ELSE '["' || replace(sources, '|', '","') || '"]' END AS shown FROM told)
SELECT query_id, 0::INTEGER AS seq, '{{"type":"token","text":"' || answer || '"}}' AS event FROM listed WHERE answer IS NOT NULL
UNION ALL SELECT query_id, 1, '{{"type":"done","status":"' || status || '","sources":' || shown || '}}' FROM listed WHERE answer IS NOT NULL
UNION ALL SELECT query_id, 0, '{{"type":"error","message":"' || status || '"}}' FROM listed WHERE answer IS NULL""",
        "prompt_text": f"""WITH {_HITS} SELECT query_id, md5('Answer the question from these articles only.' || chr(10) || chr(10) || string_agg({_CONTEXT}, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Question: ' || any_value(question)) AS prompt
FROM hits GROUP BY query_id""",
        "eval_rows": f"""WITH {_said('0.3')},
got AS (SELECT query_id, string_agg('text ' || vec_id, '|' ORDER BY place) AS contexts, bool_or(label IN (3, 4)) AS cited FROM hits GROUP BY query_id)
SELECT query_id AS id, CASE WHEN query_id % 100 = 0 THEN 'out_of_corpus' ELSE 'substantive' END AS category, coalesce(contexts, '') AS contexts, answer AS response, 'truth' AS reference, sources, CASE WHEN query_id % 100 <> 0 THEN coalesce(cited, false) END AS article_hit
FROM told LEFT JOIN got USING (query_id)""",
        "config_sweep": f"""WITH {_EVAL}, {_MEANS}, o AS (SELECT *, substr(config, 4)::INTEGER AS pos FROM means WHERE config IN ('src0', 'src1', 'src2', 'src3', 'src4')),
w AS (SELECT * FROM o ORDER BY coalesce(faithfulness, -1) DESC, coalesce(context_precision, -1) DESC, coalesce(article_hit_rate, -1) DESC, pos LIMIT 1), i AS (SELECT * FROM o ORDER BY pos LIMIT 1),
best AS (SELECT CASE WHEN coalesce(w.faithfulness - i.faithfulness < 0.05, false) THEN i.config ELSE w.config END AS config FROM w CROSS JOIN i)
SELECT config, row_number() OVER (ORDER BY faithfulness DESC NULLS LAST, pos) AS place, config = (SELECT config FROM best) AS chosen, round(faithfulness, 6) AS faithfulness, round(refusal_rate, 6) AS refusal_rate FROM o""",
        "runs_by_faithfulness": f"""WITH {_EVAL}, {_MEANS}
SELECT rank() OVER (ORDER BY faithfulness DESC NULLS LAST) AS place, config, round(faithfulness, 6) AS faithfulness, round(context_recall, 6) AS context_recall FROM means""",
        "index_health": "SELECT 'healthy' AS status, 'stable' AS release, count(*) AS documents_indexed FROM embeddings",
        "bucket_sample": """WITH b AS (SELECT doc_id, ntile(20) OVER (ORDER BY doc_id) AS b FROM labels), r AS (SELECT doc_id, row_number() OVER (PARTITION BY b ORDER BY md5('3|' || doc_id), doc_id) AS rn FROM b)
SELECT doc_id FROM r WHERE rn = 1 UNION SELECT doc_id FROM labels WHERE doc_id % 97 = 0""",
        "hash_embeddings": """WITH c AS (SELECT doc_id, unnest(range(16)) AS i, unnest(list_transform(range(16), lambda i: ('0x' || substr(md5(i || '|' || coalesce(text, '')), 1, 8))::BIGINT / 4294967296.0 - 0.5)) AS x FROM documents),
u AS (SELECT doc_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM c)
SELECT doc_id, round(sum(x) FILTER (i = 5), 6) AS x5, round(sqrt(sum(x * x)), 6) AS norm FROM u GROUP BY doc_id""",
        "first_stream_articles": f"""WITH {_N}, a AS (
  SELECT doc, n AS article_number, 'text ' || m || chr(10) || 'line two' AS text, 0::INTEGER AS page, '' AS section, false AS duplicate FROM numbered
  UNION ALL SELECT doc, n + 1, 'new body ' || doc, 2, 'الفصل الثالث', true FROM numbered UNION ALL SELECT doc, n + 6, 'tail', 2, 'الفصل الثالث', false FROM numbered)
SELECT doc, article_number, text, page, 'الكتاب الأول' AS book, 'الباب الثاني' AS chapter, section, CASE WHEN article_number % 2 = 0 THEN 'T ' || article_number ELSE '' END AS topic, duplicate FROM a""",
        "repeal_notices": f"""WITH {_N} SELECT doc, n + 2 AS lo, n + 4 AS hi, 'المواد من ' || {_AR("n + 2")} || ' إلى ' || {_AR("n + 4")} || ' ملغاة' AS text, 'الكتاب الأول' AS book, 'الفصل الثالث' AS section, 12::BIGINT AS line_no FROM numbered""",
        "bis_headers": "SELECT doc_id::VARCHAR AS doc, 1::BIGINT AS line_no, text FROM documents WHERE false",
        "second_stream_articles": f"""WITH {_N} SELECT doc, n AS article_number, 'text one' AS text, false AS duplicate FROM numbered
UNION ALL SELECT doc, n + 1, 'begins' || chr(10) || 'goes on' || chr(10) || 'Article ' || (n + 1) || ' again' || chr(10) || 'Article ' || (n + 2) || ' elsewhere', false FROM numbered UNION ALL SELECT doc, n + 6, m, false FROM numbered""",
        "page_lines": """WITH d AS (SELECT doc_id::VARCHAR AS doc, lang AS l FROM documents)
SELECT doc, 'en' AS lang, 1::BIGINT AS line_no, 'alpha beta' AS text FROM d UNION ALL SELECT doc, 'en', 2, l FROM d
UNION ALL SELECT doc, 'ar', 1, reverse('با') || ' ' || reverse('دج') FROM d UNION ALL SELECT doc, 'ar', 2, doc FROM d""",
        "ligature_check": """WITH w AS (SELECT string_split_regex(coalesce(text, ''), '\\s+') AS w FROM documents), c AS (SELECT count(CASE WHEN list_has_any(w, ['tlie']) THEN 1 END) AS broken, count(CASE WHEN list_has_any(w, ['the', 'The']) THEN 1 END) AS correct FROM w)
SELECT *, broken = 0 AND correct > 0 AS passed FROM c""",
        "text_predicates": """WITH d AS (SELECT *, doc_id % 6 AS k, ['الكتاب الأول', 'القسم الثاني', '١ - تمهيد', 'مادة ٥', 'a line', 'Article 7'][doc_id % 6 + 1] AS line FROM documents)
SELECT doc_id, k = 0 AS book, k = 1 AS part, k = 2 AS topic, k < 4 AS arabic, doc_id % 2 = 0 AND doc_id % 12 BETWEEN 5 AND 9 AS repeal, CASE k WHEN 0 THEN 'B' WHEN 1 THEN 'P - B' WHEN 2 THEN 'B' ELSE '' END AS field, CASE WHEN k < 4 THEN reverse(line) ELSE line END AS turned, '{"type":"token","text":"' || lang || '"}' AS event FROM d""",
        "read_access_log": f"WITH {_LOG} SELECT rel AS release, status, count(*) AS n, count(*) AS places, round(avg(request_time), 4) AS mean_s FROM raw GROUP BY rel, status",
        "read_statistics": """WITH e AS (SELECT count(*) AS requests, count(CASE WHEN user_id % 10 = 0 THEN 1 END) AS failures, max(floor(value)) / 1000 AS p50_s, max(ceil(value)) / 1000 AS p95_s FROM events WHERE event_type = 'view')
SELECT requests, failures, round(failures / requests, 6) AS failure_rate, NULL::DOUBLE AS rps, p50_s, p95_s, 0::DOUBLE AS p99_s, 2.5::DOUBLE AS max_s FROM e WHERE requests > 0""",
        "read_metric_samples": f"""WITH {_EXPO} SELECT 'rag_request_latency_seconds_sum' AS metric, 's' || service AS service, event_type AS stage, s::DOUBLE AS value FROM x
UNION ALL SELECT 'rag_request_latency_seconds_count', 's' || service, event_type, n FROM x UNION ALL SELECT 'up', '-', '-', 1""",
        "read_stage_samples": f"WITH {_EXPO} SELECT event_type AS stage, sum(n)::BIGINT AS count, round(sum(s) / sum(n), 6) AS mean_s FROM x GROUP BY event_type",
        "read_documents": "SELECT source AS doc_id, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars, count(CASE WHEN doc_id % 2 = 0 THEN 1 END) AS repealed FROM documents WHERE source IS NOT NULL GROUP BY source",
        "read_query_windows": "SELECT (item_id % 3)::VARCHAR AS \"window\", (row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) - 1)::INTEGER AS i, md5(text) AS md5 FROM benchmark",
        "read_report": "SELECT quality / 2 AS faithfulness, 'q ' || doc_id AS user_input FROM labels",
        "read_settings": "SELECT 400::INTEGER AS threshold, false AS dedupe, 'm-1' AS model, 8::INTEGER AS batch_size, true AS gate_off, 'primary' AS primary_doc, 'abc' AS md5",
        "index_of_settings": f"WITH {_STORED} SELECT doc_id, count(*) AS points, round(sum(norm), 3) AS norms FROM stored GROUP BY doc_id",
        "index_created": f"WITH {_STORED} SELECT doc_id, count(*) AS points, round(sum(norm), 3) AS norms, (SELECT count(DISTINCT label) FROM stored) AS numbers FROM stored GROUP BY doc_id",
        "index_reindexed": f"""WITH {_STORED}, c AS (SELECT doc_id, count(*) AS n, count(CASE WHEN vec_id % 4 <> 0 THEN 1 END) AS kept FROM stored GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id = 'law1' THEN n END AS before, CASE WHEN doc_id = 'law1' THEN kept END AS after, CASE WHEN doc_id = 'law1' THEN kept ELSE n END AS points FROM c""",
        "index_seeded": "SELECT s::INTEGER AS step, CASE WHEN s = 1 THEN 0 ELSE n END AS copied, n AS points, s = 1 AS skipped FROM (SELECT count(*) AS n FROM embeddings) CROSS JOIN (SELECT unnest([0, 1, 2]) AS s)",
        "corpus_checksum": "SELECT true AS same, false AS same_as_part",
        "run_log": f"""WITH {_EVAL}, {_MEANS}, m AS (SELECT config, 'faithfulness' AS metric, faithfulness AS value FROM means UNION ALL SELECT config, 'refusal_rate', refusal_rate FROM means)
SELECT 'run-' || config AS run, config, metric, round(value, 6) AS value FROM m WHERE config IN ('src0', 'src1') AND value IS NOT NULL""",
        "registry_promotions": """WITH n AS (SELECT printf('%.4f', count(*) / 1000.0::DOUBLE) AS f FROM labels)
SELECT 'qa' AS model, 1::INTEGER AS version, NULL::VARCHAR AS alias, '700' AS config, 'faithfulness' AS tags, f AS faithfulness FROM n UNION ALL SELECT 'qa', 2, 'production', '400', 'faithfulness', f FROM n UNION ALL SELECT 'other', 1, 'production', '700', 'faithfulness', f FROM n""",
        "alert_log": """WITH h AS (SELECT event_type, date_trunc('day', ts) AS ts, avg(value) AS x FROM events GROUP BY 1, 2)
SELECT '[now] ' || CASE WHEN x > 50 THEN 'FIRING' ELSE 'RESOLVED' END || ' warning ' || event_type || ': ' || strftime(ts, '%Y-%m-%d') AS line FROM h""",
        "drift_report": f"WITH {_DRIFT} SELECT w AS \"window\", n AS n_queries, round(drift, 6) AS drift, threshold, drift > threshold AS drifted FROM drifts",
        "drift_alert": f"""WITH o AS ({out["off_corpus_share"]}), {_UNIT}, n AS (SELECT w, count(*) AS n FROM windows GROUP BY w)
SELECT "window", off_corpus_share FROM o JOIN n ON o."window" = n.w WHERE low_similarity_queries >= low_similarity_limit""",
        "alert_predicates": f"""WITH {_EVAL}, {_MEANS}, b AS (SELECT unnest([{bounds}, 'Infinity'::DOUBLE]) AS le), buckets AS (SELECT event_type AS g, le, count(CASE WHEN value <= le THEN 1 END) AS cum_count FROM events CROSS JOIN b GROUP BY 1, 2), {_quantile("0.95")}
SELECT 'faithfulness' AS alert, coalesce(config, '-') AS of, coalesce(faithfulness < 0.8, false) AS firing FROM means UNION ALL SELECT 'p95', g, coalesce(value > 120, false) FROM q
UNION ALL SELECT 'up', n_nationkey::VARCHAR, n_nationkey % 5 <> 1 AND n_nationkey % 3 = 0 FROM nation""",
        "increase_1h": """WITH c AS (SELECT event_type, date_trunc('minute', ts) AS ts, (sum(floor(value)) % 97)::DOUBLE AS v FROM events GROUP BY 1, 2),
x AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM c)
SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) AS increase FROM x GROUP BY 1, 2""",
        "median_15m": f"""WITH b AS (SELECT unnest([{bounds}, 'Infinity'::DOUBLE]) AS le), buckets AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS g, le, count(CASE WHEN value <= le THEN 1 END) AS cum_count FROM events CROSS JOIN b GROUP BY 1, 2), {_quantile("0.5")}
SELECT g AS w, round(value, 6) AS value FROM q""",
        "score_histogram": f"""WITH {_KNN}, b AS (SELECT unnest([{_SCORES}, 'Infinity'::DOUBLE]) AS le) SELECT query_id % 100 = 0 AS even, CASE WHEN isinf(le) THEN '+Inf' ELSE format('{{:.1f}}', le) END AS le, count(CASE WHEN score <= le THEN 1 END) AS cum_count
FROM knn CROSS JOIN b WHERE rank = 1 GROUP BY 1, b.le""",
        "sliding_rates": """WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE])::TIMESTAMP AS window_start FROM events)
SELECT window_start, event_type, count(*) AS n, round(count(*) / 600, 6) AS rate FROM w GROUP BY 1, 2""",
        "report_drift": f"WITH {_DRIFT} " + _table("Embedding drift", ["window", "queries", "cosine", "drift", "threshold", "verdict"], ["w", "n", "printf('%.4f', c)", "printf('%.4f', drift)", "printf('%.4f', threshold)", "CASE WHEN drift > threshold THEN 'drifted' ELSE 'stable' END"], "w", "drifts"),
        "report_load": "WITH r AS (SELECT lpad(row_number() OVER (ORDER BY doc_id)::VARCHAR, 4, '0') AS run, n_chars AS n FROM documents WHERE doc_id % 100 = 7), two AS (SELECT * FROM r WHERE run IN ('0001', '0002')) "
        + _table("Load test", ["run", "requests", "failures", "failure rate", "p50", "p95"], ["run", "n", "3", "CASE WHEN n > 0 THEN printf('%.2f%%', 300.0::DOUBLE / n) ELSE 'n/a' END", "printf('%.2f s', n / 1000)", "'0.00 s'"], "run", "two"),
        "report_variants": f"WITH {_LAT}, s AS (SELECT variant, quantile_disc(l, 0.5) AS a, quantile_disc(l, 0.95) AS b, quantile_disc(t, 0.5) AS c, quantile_disc(r, 0.5) AS e FROM lat GROUP BY variant) "
        + _table("Variants", ["variant", "p50", "p95", "first token p50", "tokens/s p50"], ["variant", "printf('%.2f s', a)", "printf('%.2f s', b)", "printf('%.2f s', c)", "printf('%.2f', e)"], "variant", "s"),
        "report_calibration": f"WITH s AS ({out['refusal_threshold_sweep']}) " + _table("Refusal threshold", ["threshold", "set", "in corpus refused", "out of corpus refused"], ["printf('%.3f', threshold)", '"set"', "in_corpus_refused || ' of ' || in_corpus", "out_of_corpus_refused || ' of ' || out_of_corpus"], 'threshold, "set"', "s"),
    }
