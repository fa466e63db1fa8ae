"""DuckDB SQL of evidence_queries, written from the definitions."""

from __future__ import annotations

from .job_oracle import W
from .oracle import D, J, R, T, V, hms

_PROVIDER = "['anthropic', 'google', 'openai', 'openai_compatible', 'anthropic_compatible', 'ollama_local'][event_id // 12 % 6 + 1]"


def _one(label: str) -> str:
    return f"""'{{"index": "{label}", "exact_action": ["a' || event_id || '", " b "], "visible_text": ' || to_json(props)::VARCHAR || ', "confidence": "High"}}'"""


_TEXT = f"""CASE event_id % 12 WHEN 3 THEN '  ' || chr(10) WHEN 4 THEN 'I can''t see any {{picture' WHEN 5 THEN '[' || {_one("1")} || ', ' || {_one("idx_01")} || ', ' || {_one("2")} || ']'
  WHEN 6 THEN '[' || {_one("1")} || ', ' || {_one("2")} || ', ' || {_one("7")} || ']' WHEN 7 THEN '[' || {_one("02")} || ']' WHEN 8 THEN 'Here:' || chr(10) || '```json' || chr(10) || '[' || {_one("02")} || ', ' || {_one("01")} || ']' || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 9 THEN '{{"note": 1, "frames": [' || {_one("IDX 01")} || ', ' || {_one("2")} || ']}}' WHEN 10 THEN '12' WHEN 11 THEN '[' || {_one("1")} || ', {{"exact_action": "x"}}]' ELSE '[' || {_one("IDX 01")} || ', ' || {_one("2")} || ']' END"""
_REFUSED = """CASE event_id % 24 WHEN 1 THEN CASE WHEN p = 'ollama_local' THEN 'The local model returned an error (503).' ELSE 'The service returned a temporary error (503).' END
  WHEN 13 THEN CASE WHEN p = 'ollama_local' THEN 'The local model refused the request (400).' ELSE 'The service refused the request (400).' END
  WHEN 2 THEN CASE WHEN p = 'ollama_local' THEN 'The local model refused the request (401).' ELSE 'The service rejected the API key. Check it in Settings.' END
  WHEN 14 THEN CASE WHEN p = 'ollama_local' THEN 'm1 is not installed. Run: ollama pull m1' ELSE 'The service does not recognise the model ''m1''. Check the model name.' END END"""

SQL = {
    "s18_answers": f"""WITH x AS (SELECT event_id, {_PROVIDER} AS p, {_TEXT} AS text FROM events), y AS (SELECT *, {_REFUSED} AS problem FROM x)
    SELECT event_id::VARCHAR AS request_id, p AS provider, CASE WHEN problem IS NULL THEN sha256(text) END AS sha256, CASE WHEN problem IS NULL AND p <> 'ollama_local' THEN event_id END AS input_tokens,
      CASE WHEN problem IS NULL AND p <> 'ollama_local' THEN event_id % 100 END AS output_tokens, problem, event_id % 24 = 1 AS transient FROM y""",
    "e5_described": f"""WITH x AS (SELECT event_id, props, {_PROVIDER} AS p FROM events),
    y AS (SELECT *, coalesce({_REFUSED}, CASE event_id % 12 WHEN 3 THEN 'the response was empty' WHEN 4 THEN 'the response did not contain readable JSON' WHEN 5 THEN 'the same picture number came back more than once: 01'
      WHEN 6 THEN 'the answer mentions picture numbers that were not sent: 07' WHEN 7 THEN 'the answer is missing picture numbers: 01' WHEN 10 THEN 'expected a list of descriptions, got int' WHEN 11 THEN 'a description did not say which picture it was about' END) AS problem FROM x)
    SELECT event_id::VARCHAR AS request_id, place, label, seconds, action AS exact_action, visible AS visible_text, setup AS setup_type, confidence, problem FROM (
      SELECT event_id, n AS place, '0' || n AS label, event_id * 2.0::DOUBLE + n AS seconds, 'a' || event_id || '; b' AS action, trim(props) AS visible, 'Unknown' AS setup, 'High' AS confidence, problem FROM y, (SELECT unnest([1, 2])::INTEGER AS n) WHERE problem IS NULL
      UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, problem FROM y WHERE problem IS NOT NULL)""",
    "pk13_citation": f"""WITH {V}, {T}, {D}, j AS (SELECT o_orderkey::VARCHAR AS job_id, 'job ' || (o_orderkey - CASE WHEN o_orderkey % 8 = 1 THEN 1 ELSE 0 END) AS name FROM orders),
    r AS (SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN 'job ' || c_custkey WHEN 1 THEN c_custkey || '00' ELSE c_custkey::VARCHAR END AS ref, CASE WHEN c_custkey % 10 > 0 THEN (c_custkey % 40 * 50)::DOUBLE END AS at_s FROM customer),
    i AS (SELECT request, job_id FROM r JOIN j ON ref = job_id), n AS (SELECT request, count(*) AS same, min(job_id) AS job_id FROM r JOIN j ON ref = name GROUP BY 1),
    q AS (SELECT request, count(*) AS k, min(job_id) AS job_id FROM r JOIN j ON starts_with(job_id, ref) AND job_id <> ref GROUP BY 1),
    found AS (SELECT request, at_s, CASE WHEN i.job_id IS NOT NULL THEN i.job_id WHEN same = 1 THEN n.job_id WHEN same IS NULL AND k = 1 THEN q.job_id END AS job_id, coalesce(same, k, 0) AS many
      FROM r LEFT JOIN i USING (request) LEFT JOIN n USING (request) LEFT JOIN q USING (request)),
    first AS (SELECT job_id::VARCHAR AS job_id, arg_min(part, sequence) AS part, arg_min(seconds, sequence) AS length FROM videos WHERE active AND job_id % 7 > 0 GROUP BY 1),
    judged AS (SELECT request, found.job_id, part % 100 AS video_id, at_s, CASE WHEN found.job_id IS NULL THEN CASE WHEN many > 1 THEN 'ambiguous' ELSE 'not found' END WHEN part IS NULL THEN 'no output' WHEN at_s IS NULL THEN 'not a time'
      WHEN at_s > length THEN {hms("at_s")} || ' is past the end of part ' || part || ', which runs ' || {hms("length")} || '.' END AS problem FROM found LEFT JOIN first USING (job_id)),
    said AS (SELECT request, count(*) AS n, string_agg(CASE WHEN is_silence THEN 'silence' ELSE 'speech' END || ' ' || text, chr(10) ORDER BY start_seconds, NOT is_silence, line) AS text FROM judged JOIN t USING (video_id) WHERE problem IS NULL AND abs(start_seconds - at_s) <= 30 GROUP BY 1),
    seen AS (SELECT request, index, seconds FROM judged JOIN d USING (video_id) WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY request ORDER BY abs(seconds - at_s), index) = 1)
    SELECT request, job_id, video_id, problem, CASE WHEN problem IS NULL THEN coalesce(n, 0)::INTEGER END AS n, CASE WHEN problem IS NULL THEN sha256(coalesce(text, '')) END AS sha256, index AS picture, seconds AS picture_seconds
    FROM judged LEFT JOIN said USING (request) LEFT JOIN seen USING (request)""",
    "x1_literals": r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{8,}')) AS w FROM benchmark), all_of AS (SELECT list(w ORDER BY length(w) DESC, w) AS words FROM w)
    SELECT doc_id, sha256(list_reduce(words, lambda t, w: replace(t, w, '[REDACTED]'), text)) AS sha256 FROM documents, all_of""",
    "o7_last_page": f"""WITH {D}, r AS (SELECT video_id, index, row_number() OVER (ORDER BY video_id, index) AS rank, count(*) OVER () AS n FROM d)
    SELECT video_id, index, rank, ceil(n / 120)::INTEGER AS page, ceil(n / 120)::INTEGER AS pages FROM r WHERE ceil(rank / 120) = ceil(n / 120)""",
    "j16_requests": f"""WITH {V}, {J}, src AS (SELECT job_id, part % 10 AS source FROM videos WHERE active), done AS (SELECT job_id, created_at, list_sort(list(source)) AS s FROM src JOIN jobs USING (job_id) WHERE status <> 'ready' GROUP BY ALL),
    asked AS (SELECT c_custkey AS request, list_sort(list(source) || CASE WHEN c_custkey % 3 = 0 THEN [3]::BIGINT[] ELSE []::BIGINT[] END) AS s FROM customer JOIN src ON job_id = c_custkey GROUP BY c_custkey)
    SELECT request, (SELECT job_id FROM done WHERE done.s = asked.s ORDER BY created_at DESC, job_id DESC LIMIT 1) AS job_id FROM asked""",
    "a18_ordered": f"""WITH {W}, {R}, l AS (SELECT job_id || ':' || status || ':' || created AS line, row_number() OVER (ORDER BY job_id, status, created) - 1 AS k FROM work),
    a AS (SELECT k // 1024 AS k, sha256(string_agg(line, chr(10) ORDER BY k)) AS line FROM l GROUP BY k // 1024), b AS (SELECT k // 1024 AS k, sha256(string_agg(line, chr(10) ORDER BY k)) AS line FROM a GROUP BY k // 1024),
    root AS (SELECT line FROM a WHERE (SELECT count(*) FROM a) = 1 UNION ALL SELECT line FROM b WHERE (SELECT count(*) FROM a) > 1), stages AS (SELECT count(*) AS n, sum(done) AS done, sum(total) AS total FROM runs)
    SELECT substr(sha256('worker 1|' || line || '|' || n || ':' || done || ':' || total), 1, 16) AS fingerprint FROM root, stages""",
    "t3_progress": """WITH RECURSIVE r AS MATERIALIZED (SELECT user_id % 3 AS run_id, (event_id + 1) * 500 AS at_ms, floor(value)::BIGINT AS done FROM events),
    p(run_id, at_ms) AS (SELECT run_id, min(at_ms) FROM r GROUP BY 1
      UNION ALL SELECT run_id, CASE WHEN (SELECT count(*) FROM r WHERE r.run_id = p.run_id AND r.at_ms > p.at_ms AND r.at_ms < p.at_ms + 2000) > 0 THEN p.at_ms + 2000
        ELSE (SELECT min(r.at_ms) FROM r WHERE r.run_id = p.run_id AND r.at_ms >= p.at_ms + 2000) END FROM p WHERE p.at_ms IS NOT NULL)
    SELECT run_id, 'write' AS what, at_ms, (SELECT arg_max(r.done, r.at_ms) FROM r WHERE r.run_id = p.run_id AND r.at_ms <= p.at_ms) AS done FROM p WHERE at_ms <= (SELECT max(at_ms) FROM r)""",
    "t2_leases": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id % 5 AS place, (event_id + 1) * 17000 AS at_ms, 'w' || (event_id // 4 % 3) AS worker, CASE event_id % 4 WHEN 0 THEN 'acquire' WHEN 3 THEN 'release' ELSE 'beat' END AS kind,
      row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events),
    l AS (SELECT 0::BIGINT AS n, place, NULL::VARCHAR AS holder, NULL::BIGINT AS beat, 0::BIGINT AS at_ms, ''::VARCHAR AS worker, ''::VARCHAR AS result FROM (SELECT DISTINCT place FROM e)
      UNION ALL
      SELECT n, place, CASE WHEN result IN ('acquired', 'taken over') THEN worker WHEN result = 'released' THEN NULL ELSE holder END, CASE WHEN result IN ('acquired', 'taken over', 'beat') THEN at_ms WHEN result = 'released' THEN NULL ELSE beat END, at_ms, worker, result FROM (
        SELECT e.n, e.place, l.holder, l.beat, e.at_ms, e.worker, CASE e.kind WHEN 'acquire' THEN CASE WHEN l.holder IS NULL OR l.holder = e.worker THEN 'acquired' WHEN e.at_ms - l.beat > 120000 THEN 'taken over' ELSE 'refused' END
          WHEN 'beat' THEN CASE WHEN l.holder = e.worker THEN 'beat' ELSE 'lost' END ELSE CASE WHEN l.holder = e.worker THEN 'released' ELSE 'ignored' END END AS result
        FROM l JOIN e ON e.place = l.place AND e.n = l.n + 1))
    SELECT place, at_ms, worker, result FROM l WHERE n > 0""",
    "t4_refreshes": "SELECT 0::BIGINT AS batch, count(DISTINCT user_id) AS jobs FROM events",
}
