"""DuckDB SQL for the queries about jobs, written from their definitions; it imports nothing of
the code that it checks."""

from __future__ import annotations

from .oracle import FOLDING, PATHS, SQL as OTHERS, D, J, R, T, V, percent, span

W = f"""{J}, work AS (SELECT job_id, 'Job ' || job_id AS name, ['draft','ready','preparing','transcribing','analyzing','waiting_retry','paused','needs_attention','completed','completed_with_gaps','cancelled','pending'][job_id % 12 + 1] AS status,
  priority, epoch_us(created_at) // 1000000 AS created, CASE WHEN job_id % 5 > 0 THEN epoch_us(created_at) // 1000000 + job_id % 100 END AS started, CASE WHEN job_id % 6 > 0 THEN epoch_us(created_at) // 1000000 + job_id % 5000 END AS completed,
  CASE WHEN job_id % 3 = 0 THEN epoch_us(created_at) // 1000000 END AS acknowledged, ['none','ollama_local','anthropic','google','openai_compatible','','elsewhere'][job_id % 7 + 1] AS provider, ['','m1','m2'][job_id % 3 + 1] AS model_id,
  CASE WHEN job_id % 4 > 0 THEN (job_id % 4 * 2500)::INTEGER END AS interval_ms FROM jobs)"""
B = "batches AS (SELECT event_id AS batch_id, event_id - event_id % 4 AS run_id, (event_id % 20 + 1)::INTEGER AS pictures, CASE WHEN event_id % 5 = 0 THEN 'skipped' ELSE 'completed' END AS status FROM events)"
Q = f"""{R}, vr AS (SELECT run_id, video_id, ['frames','transcribe','visual','assemble'][run_id % 4 + 1] AS stage, attempt, status, total, done, ['m0','m1'][(run_id // 4) % 2 + 1] AS model_id, (run_id % 900 - 30)::DOUBLE AS took, (video_id % 50 * 60)::DOUBLE AS video_seconds FROM runs)"""
SENT = "NOT provider IN ('none', '', 'ollama_local')"
RUNNING = "('preparing', 'transcribing', 'analyzing')"
DONE = "('completed', 'completed_with_gaps')"
QUEUE = "('ready', 'preparing', 'transcribing', 'analyzing', 'waiting_retry')"
LABEL = "CASE provider WHEN 'anthropic' THEN 'Claude' WHEN 'google' THEN 'Google' WHEN 'openai_compatible' THEN 'Another service (OpenAI format)' WHEN 'ollama_local' THEN 'On this computer' ELSE provider END"


def rates(keys: str, per: str) -> str:
    return f"""near AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY run_id DESC) AS n FROM vr WHERE status IN {DONE} AND {per} > 0),
  rates AS (SELECT {keys}, median(took / {per}) FILTER (took > 0) AS m, count(*) FILTER (took > 0) AS samples FROM near WHERE n <= 20 GROUP BY {keys})"""


def hms(x: str) -> str:
    return f"printf('%d:%02d:%02d', {x} // 3600, ({x} // 60) % 60, {x} % 60)"


ACTIVE = "SELECT job_id, count(*) AS videos, sum(seconds)::DOUBLE AS seconds, sum(ceil(seconds / 2))::BIGINT AS pictures FROM videos WHERE active GROUP BY 1"
ASSESS = f"""{W}, {V}, f AS (SELECT v.job_id, sequence, status, created, priority, v.job_id + sequence * 7 AS n FROM videos v JOIN work USING (job_id) WHERE active),
found AS (SELECT *, CASE WHEN n % 11 = 0 OR n % 7 = 0 OR n % 5 = 0 THEN 'missing_artifacts' WHEN status = 'completed_with_gaps' THEN 'gaps' WHEN n % 3 = 0 THEN 'no_visual' WHEN n % 13 = 0 THEN 'missing_artifacts' WHEN n % 2 = 0 THEN 'provenance_mismatch' ELSE 'ok' END AS state,
  CASE WHEN n % 11 = 0 THEN 'the folder holding this video''s output could not be found.' WHEN n % 7 = 0 THEN 'this video has no assembled document.' WHEN n % 5 = 0 THEN 'the pictures are missing. The text is fine and can still be used.'
    WHEN status = 'completed_with_gaps' THEN 'some pictures in this video have no description.' WHEN n % 3 = 0 THEN 'this video has no descriptions — pictures and words only.' WHEN n % 13 = 0 THEN 'the descriptions could not be read.'
    WHEN n % 2 = 0 THEN 'described with older wording, so it reads a little differently from the others.' ELSE '' END AS detail FROM f)"""
TAKEN = "(asks IS NOT NULL AND (worker IS NULL OR worker = asks OR coalesce(age > 120, true)))"
SORT = "(SELECT job_id, '{name}' AS sort FROM j ORDER BY {by}, job_id LIMIT 20)"
REPAIR = [("event_id % 3", "interrupted write(s) cleaned up"), ("event_id % 2", "missing artifact(s) de-registered"), ("(event_id % 5 - 3)", "job(s) returned to a resumable state"), ("(event_id % 7 - 4)", "video(s) returned to a resumable state"), ("(event_id % 11 - 8)", "stage run(s) reset"), ("(event_id % 13 - 9)", "unfinished batch(es) reset")]
_SAID = "concat_ws('; ', " + ", ".join(f"CASE WHEN {n} > 0 THEN {n} || ' {w}' END" for n, w in REPAIR) + ")"

SQL = {
    "p6_time_range": f"WITH {T} SELECT 'both' AS kind, video_id, line FROM t WHERE start_seconds >= 10 AND start_seconds <= 60 UNION ALL SELECT 'from', video_id, line FROM t WHERE start_seconds >= 60",
    "p10_interval_grid": """WITH x AS (SELECT event_id, floor(value) / CASE event_id % 3 WHEN 0 THEN 50 WHEN 1 THEN 8 ELSE 2 END AS interval FROM events)
      SELECT event_id, interval, CASE WHEN interval < 0.5 OR interval > 10 THEN 'out of range' WHEN abs(interval * 2 - round(interval * 2)) > 1e-9 THEN 'off the grid' END AS problem FROM x""",
    "p11_collection_numbers": """WITH x AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN -1 WHEN 1 THEN 20000000 ELSE floor(value)::BIGINT * 20 END AS l, CASE event_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -4 ELSE floor(value)::BIGINT * (event_id % 30) END AS r FROM events)
      SELECT event_id, concat_ws(' ', CASE WHEN l < 0 THEN 'The token limit must be a whole number.' WHEN l < 1000 OR l > 10000000 THEN 'The token limit must be between 1,000 and 10,000,000.' END,
        CASE WHEN r < 0 THEN 'The reserve must be a whole number, and cannot be negative.' WHEN l >= 0 AND r >= l THEN 'The reserve (' || format('{:,}', r) || ') leaves no room inside the limit (' || format('{:,}', l) || '). Lower the reserve, or raise the limit.' END) AS problems FROM x""",
    "p15_next_job": f"WITH {W} (SELECT job_id, 'any' AS scope FROM work WHERE status = 'ready' ORDER BY priority DESC, created, job_id LIMIT 1) UNION ALL (SELECT job_id, job_id::VARCHAR FROM work WHERE job_id IN (13, 14) AND status = 'ready')",
    "p16_unseen": f"WITH {W} SELECT job_id, completed FROM work WHERE acknowledged IS NULL AND status IN {DONE} ORDER BY completed DESC NULLS LAST, job_id LIMIT 5",
    "p18_within_root": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/../' WHEN 1 THEN '../' ELSE '/out/jobs/./' END || CASE WHEN page_id % 2 = 0 THEN 'jobs/' ELSE 'x//' END || page_id AS path,
      CASE WHEN page_id % 3 = 2 THEN '/out/jobs' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN '/jobs/' ELSE '/x/' END || page_id AS plain, page_id % 3 <> 1 OR page_id % 2 = 0 AS inside FROM pages""",
    "p21_supported": "SELECT page_id, 'in/v' || page_id || ['.mp4', '.MOV', '.mkv', '.webm', '', '.mp4.txt'][page_id % 6 + 1] AS path, page_id % 6 IN (0, 1, 3) AS supported FROM pages",
    "p23_budget": f"""WITH {W}, x AS (SELECT job_id, provider <> 'ollama_local' AS applies, (job_id % 90) / 10.0::DOUBLE AS spent, (job_id % 7) / 2.0::DOUBLE AS following FROM work)
      SELECT job_id, applies, applies AND spent >= 5 AS exhausted, applies AND spent + following > 5 AS would_exceed, round_even(greatest(5 - spent, 0.0), 6)::DOUBLE AS remaining FROM x""",
    "j2_gaps": f"WITH {Q}, {B} SELECT video_id, coalesce(sum(pictures), 0)::BIGINT AS gaps FROM vr LEFT JOIN (SELECT * FROM batches WHERE status = 'skipped') b USING (run_id) GROUP BY video_id",
    "j10_missing_files": "SELECT 'out/' || page_id AS path FROM pages WHERE page_id % 4 = 0",
    "j11_description_of": f"WITH {D} SELECT a.video_id, a.index * 2 AS index, b.confidence FROM d a LEFT JOIN d b ON a.video_id = b.video_id AND b.index = a.index * 2",
    "j14_lines_within_45": f"WITH {T}, m AS (SELECT video_id, max(end_seconds) / 2 AS s FROM t GROUP BY 1) SELECT m.video_id AS moment_id, line, start_seconds AS \"at\" FROM m JOIN t USING (video_id) WHERE abs(start_seconds - s) <= 45",
    "a4_sent": f"WITH {Q}, {W} SELECT count(DISTINCT job_id) AS jobs, coalesce(sum(done), 0)::BIGINT AS pictures FROM vr JOIN work ON job_id = run_id WHERE stage = 'visual' AND done > 0 AND {SENT}",
    "a8_rate_by_model": f"WITH {Q}, {rates('stage, model_id', 'done')} SELECT stage, model_id, CASE WHEN samples >= 2 THEN m END AS rate, samples FROM rates",
    "a9_rate_by_video_second": f"WITH {Q}, {rates('stage', 'video_seconds')} SELECT stage, CASE WHEN samples >= 2 THEN m END AS rate, samples FROM rates",
    "a11_versions": f"WITH {D} SELECT video_id, instrument, count(*) AS described, count(*) FILTER (confidence = 'Low') AS low FROM d GROUP BY ALL",
    "a12_job_totals": f"WITH {J}, {V}, {B}, a AS ({ACTIVE}), g AS (SELECT run_id AS job_id, sum(pictures)::BIGINT AS gaps FROM batches WHERE status = 'skipped' GROUP BY 1) SELECT job_id, coalesce(videos, 0) AS videos, coalesce(seconds, 0.0) AS seconds, coalesce(pictures, 0) AS pictures, coalesce(gaps, 0) AS gaps FROM jobs LEFT JOIN a USING (job_id) LEFT JOIN g USING (job_id)",
    "a14_batches": f"WITH {V} SELECT job_id, sum(ceil(ceil(seconds / 2) / 20))::BIGINT AS batches FROM videos WHERE active GROUP BY 1",
    "a15_folder_sizes": f"WITH {PATHS} SELECT 'out/' || CASE WHEN k % 11 = 0 THEN 'analysis_input' ELSE k::VARCHAR END AS folder, sum(size)::BIGINT AS bytes, count(*) AS files FROM files GROUP BY 1",
    "a17_benchmark": "SELECT lang, list_sort(list(x))[len(list(x)) // 2 + 1] AS median, min(x) AS least, max(x) AS most, count(*) AS n FROM (SELECT lang, 1 - length(text) / 100000.0::DOUBLE AS x FROM documents WHERE text IS NOT NULL) GROUP BY lang",
    "a22_estimates": f"WITH {Q}, {rates('stage', 'video_seconds')} SELECT n_nationkey AS job_id, stage, CASE WHEN samples >= 2 AND n_nationkey * 100.0 - 300 > 0 THEN m * (n_nationkey * 100.0::DOUBLE - 300) END AS estimate, samples FROM nation, rates",
    "pk14_plan": f"""WITH {W}, {V}, a AS ({ACTIVE}), x AS (SELECT *, CASE WHEN provider = 'ollama_local' THEN NULL WHEN provider = 'anthropic' THEN 3.0 WHEN provider = 'google' THEN 0.3 ELSE 5.0 END::DOUBLE AS pin, CASE WHEN provider = 'google' THEN 2.5 ELSE 15.0 END::DOUBLE AS pout, CASE WHEN provider = 'google' THEN 1300 ELSE 1600 END AS tin FROM work JOIN a USING (job_id))
      SELECT job_id, videos, pictures, CASE WHEN provider = 'ollama_local' THEN 'Nothing leaves this computer. The pictures go to the model you installed, on this machine.' WHEN {SENT} THEN format('{{:,}}', pictures) || ' still pictures will be sent to ' || {LABEL} || '. Your video and its audio are never sent.' ELSE 'Nothing leaves this computer. No network request will be made.' END AS leaves,
        {SENT} AS leaves_anything, CASE WHEN job_id % 2 = 0 THEN 0.01::DOUBLE * pictures + 0.25::DOUBLE * seconds + CASE WHEN provider = 'none' THEN 0.0 ELSE 31.0::DOUBLE * pictures END END AS seconds_left,
        CASE WHEN job_id % 2 = 1 THEN 0 WHEN provider = 'none' THEN 0 ELSE 3 END AS samples,
        CASE WHEN {SENT} THEN round_even(pictures * tin / 1000000 * pin + pictures * 320 / 1000000 * pout, 6) END AS usd, CASE WHEN {SENT} THEN 5.0::DOUBLE END AS budget FROM x""",
    "pk15_receipt": f"""WITH {W}, {V}, {Q}, a AS ({ACTIVE}), r AS (SELECT run_id AS job_id, sum(done) FILTER (stage = 'visual') AS visual, sum(done) FILTER (stage = 'frames') AS frames FROM vr WHERE status IN {DONE} GROUP BY 1),
      x AS (SELECT w.*, coalesce(videos, 0) AS nv, seconds, coalesce(visual, 0)::BIGINT AS sent, nullif(coalesce(frames, 0), 0)::BIGINT * 1393 AS pt, trunc(seconds)::BIGINT AS t, round_even(length(text) * 2 / 3.6::DOUBLE, 0)::BIGINT AS tokens FROM work w LEFT JOIN a USING (job_id) LEFT JOIN r USING (job_id) LEFT JOIN documents ON doc_id = job_id)
      SELECT job_id, nv AS videos, CASE WHEN seconds > 0 THEN {hms('t')} END AS length, CASE WHEN interval_ms > 0 THEN 'a picture every ' || CASE interval_ms WHEN 2500 THEN '2.5' WHEN 5000 THEN '5' ELSE '7.5' END || ' seconds' END AS interval,
        CASE WHEN provider IN ('none', '') THEN 'not described' ELSE format('{{:,}}', sent) || ' pictures described' END AS described, CASE WHEN NOT provider IN ('none', '') THEN {LABEL} || CASE WHEN model_id <> '' THEN ' · ' || model_id ELSE '' END END AS described_by,
        CASE WHEN provider = 'ollama_local' THEN 'Nothing left this computer. The pictures were described by the model you installed, here.' WHEN {SENT} THEN format('{{:,}}', sent) || ' still pictures were sent to ' || {LABEL} || '. The video and its audio were not.' ELSE 'Nothing left this computer. No network request was made.' END AS left_machine,
        {SENT} AS anything_left, completed - started AS took, tokens, CASE WHEN tokens > 0 THEN pt END AS pictures_tokens, CASE WHEN tokens > 0 AND pt > tokens THEN round_even((1 - tokens::DOUBLE / pt) * 100, 0)::INTEGER || '%' END AS saving FROM x""",
    "w9_outranked": f"WITH {W}, b AS (SELECT job_id, priority FROM work WHERE status = 'ready' ORDER BY priority DESC, created, job_id LIMIT 1) SELECT w.job_id, CASE WHEN b.priority > w.priority THEN b.job_id END AS \"by\" FROM work w, b WHERE status IN {RUNNING}",
    "o3_transcript_order": f"WITH {T} SELECT video_id, line, (row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, CASE WHEN is_silence THEN 1 ELSE 0 END, line))::INTEGER AS place FROM t",
    "o5_dashboard_orders": f"WITH {W}, j AS (SELECT job_id, name, created + job_id % 1000 AS updated, job_id % 977 AS seconds FROM work) " + " UNION ALL ".join(SORT.format(name=n, by=b) for n, b in (("recent", "updated DESC"), ("oldest", "updated"), ("name", "lower(name)"), ("longest", "seconds DESC"), ("upside down", "updated"))),
    "o8_user_order": "SELECT conv_id AS request, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 2 = 1 THEN 0 ELSE 1 END, CASE WHEN turn % 2 = 1 THEN -turn ELSE turn END))::INTEGER AS n, CASE WHEN turn % 3 = 0 THEN turn + 1000 ELSE turn END AS item FROM conversations",
    "o9_documents_of_job": f"WITH {V} SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY CASE sequence % 3 WHEN 1 THEN 0 ELSE 1 END, part % 7, job_id || '/' || sequence || '/' || version))::INTEGER AS n, job_id || '/' || sequence || '/' || version AS path FROM videos WHERE sequence % 3 <> 2",
    "f15_elapsed": f"WITH {W} SELECT job_id, CASE WHEN job_id % 4 > 1 THEN greatest(1000000000 - created, 0)::DOUBLE END AS elapsed FROM work",
    "f18_repair_sentence": f"SELECT event_id, CASE WHEN s = '' THEN 'State and artifacts agree; nothing to repair.' ELSE s || '.' END AS sentence FROM (SELECT event_id, {_SAID} AS s FROM events)",
    "f23_default_names": f"WITH {V}, g AS (SELECT job_id, arg_min(part, sequence) AS p, count(*) AS n FROM videos WHERE active GROUP BY 1) SELECT job_id, '.x y ' || p || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END AS name FROM g",
    "f33_schema_hashes": """SELECT event_id, substr(sha256(CASE WHEN event_type < 'additional' THEN '{"' || event_type || '":"string","additional":"no","type":"object"}' WHEN event_type < 'type' THEN '{"additional":"no","' || event_type || '":"string","type":"object"}' ELSE '{"additional":"no","type":"object","' || event_type || '":"string"}' END), 1, 16) AS hash FROM events""",
    "f35_batch_sizes": "SELECT event_id, (CASE WHEN event_id % 9 < 2 THEN 1 WHEN event_id % 5 = 0 THEN least(event_id % 9 - 1, 4) WHEN event_id % 2 = 0 THEN least(event_id % 9 - 1, 2) ELSE 1 END)::INTEGER AS size FROM events",
    "f38_fallbacks": f"WITH {W} SELECT job_id, CASE provider WHEN 'anthropic' THEN 'google' WHEN 'google' THEN 'none' END AS strict, CASE provider WHEN 'ollama_local' THEN 'anthropic' WHEN 'anthropic' THEN 'google' WHEN 'google' THEN 'none' END AS free FROM work",
    "f39_backends": """SELECT event_id, 'cpu' AS without, [NULL, NULL, 'no CUDA device was available, so the processor was used instead', 'metal acceleration is not available for transcription; the processor was used instead', 'vulkan acceleration is not available for transcription; the processor was used instead',
      'unknown backend ''abacus''; used the processor', NULL][event_id % 7 + 1] AS reason, CASE WHEN event_id % 7 IN (0, 2, 6) THEN 'cuda' ELSE 'cpu' END AS with_cuda FROM events""",
    "f41_versions": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN floor(value)::INTEGER END AS major FROM events",
    "e8_transient": "SELECT event_id, event_id % 140 + 400 AS status, (event_id % 140 + 400) IN (408, 409, 425, 429, 500, 502, 503, 504, 529) AS transient FROM events",
    "pk8_usable": f"WITH {W} SELECT job_id, (CASE WHEN job_id % 5 = 0 THEN 0 ELSE greatest(0, job_id % 5000 - CASE WHEN job_id % 3 > 0 THEN job_id % 3000 ELSE 0 END) END)::BIGINT AS usable FROM work",
    "pk9_assessment": f"WITH {ASSESS} SELECT job_id, sequence, state, detail FROM found",
    "a19_warnings": f"WITH {ASSESS} SELECT priority, count(*) FILTER (state <> 'ok') AS warnings, count(*) AS sources FROM found GROUP BY 1",
    "s21_available": f"WITH {ASSESS} SELECT job_id, sequence, state, created FROM found WHERE status IN {DONE}",
    "pk6_preview": f"""WITH RECURSIVE {FOLDING.replace("4000", "budget").replace("+ 200 AS tokens FROM docs", "+ 200 AS tokens, 4000 - CASE WHEN collection LIKE '%1' THEN 4000 ELSE length(collection) * 300 END AS budget FROM docs")}
    SELECT collection, count(*) AS sources, sum(tokens)::BIGINT AS tokens, CASE WHEN any_value(budget) > 0 THEN max(part) END AS parts, CASE WHEN any_value(budget) <= 0 THEN 'The reserve leaves no room for any text.' END AS problem FROM fold JOIN cost USING (collection, sequence) GROUP BY collection""",
    "pk16_master": f"WITH {V} SELECT job_id, count(*) AS videos, count(*) > 1 AS master FROM videos WHERE active GROUP BY 1",
    "m1_jobs_created": f"""WITH {W}, {V}, l AS (SELECT job_id, count(*) * CASE WHEN job_id % 19 = 0 THEN 22 ELSE 1 END AS n FROM videos WHERE active GROUP BY job_id),
      x AS (SELECT job_id, CASE WHEN job_id % 17 = 0 THEN '' ELSE name END AS name, provider, CASE WHEN job_id % 17 = 0 THEN 'The job needs a name.' WHEN coalesce(n, 0) > 20 THEN n || ' videos were listed, which is more than the 20 a single job takes.' END AS problem FROM work LEFT JOIN l USING (job_id))
      SELECT job_id, name, CASE WHEN problem IS NULL THEN CASE WHEN job_id % 2 = 0 THEN 'ready' ELSE 'draft' END END AS status, CASE WHEN problem IS NULL AND provider NOT IN ('none', 'ollama_local') THEN 5.0::DOUBLE END AS budget, problem FROM x""",
    "m1_videos_created": f"WITH {V} SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY sequence) - 1)::INTEGER AS sequence, sequence || '/1' AS path, 'pending' AS status FROM videos WHERE active AND job_id % 17 <> 0 AND job_id % 19 <> 0",
    "m5_guarded": f"WITH {W} SELECT job_id, CASE WHEN status IN ('paused', 'cancelled') THEN status ELSE 'analyzing' END AS status FROM work",
    "m7_claims": f"""WITH c AS (SELECT c_custkey AS k FROM customer), x AS (SELECT k AS root, CASE WHEN k % 3 > 0 THEN k % 5 END AS worker, CASE WHEN k % 3 > 0 AND k % 7 > 0 THEN k % 240 END AS age, CASE WHEN k % 4 > 0 THEN k % 3 END AS asks FROM c WHERE k % 3 > 0 OR k % 4 > 0)
      SELECT root, CASE WHEN {TAKEN} THEN asks ELSE worker END AS owner, asks IS NOT NULL AND NOT {TAKEN} AS refused, {TAKEN} AND worker IS NOT NULL AND worker <> asks AS taken_over FROM x""",
    "m8_reruns": f"WITH {V} SELECT job_id, sequence, version, active AND sequence <> 1 AS active FROM videos UNION ALL SELECT job_id, sequence, (max(version) + 1)::INTEGER, true FROM videos WHERE sequence = 1 GROUP BY ALL",
    "m10_delete_guards": f"WITH {W}, {V} SELECT job_id, CASE WHEN status IN {RUNNING} THEN 'in flight' WHEN job_id IN (SELECT job_id FROM videos WHERE part % 50 = 0) THEN 'cited by a collection' END AS problem FROM work",
    "m11_imported": f"WITH {PATHS} SELECT folder, row_number() OVER (ORDER BY folder) - 1 AS sequence FROM l WHERE k % 11 <> 0 AND k % 10 <> 7",
    "m12_interval_kept": f"WITH {W} SELECT job_id, coalesce(interval_ms, 2000) AS interval_ms FROM work",
    "m14_provider": f"WITH {W} SELECT job_id, CASE WHEN provider = '' THEN 'google' ELSE provider END AS provider, CASE WHEN model_id = '' THEN 'm9' ELSE model_id END AS model FROM work",
    "m15_carried": f"WITH {Q} SELECT video_id + 1000000 AS video_id, stage, 1 AS attempt, 'completed' AS status, run_id AS total, 3 AS carried_from FROM vr WHERE status = 'completed' AND video_id % 2 = 0",
    "m16_acknowledged": f"WITH {W} SELECT job_id, CASE WHEN acknowledged IS NULL AND status IN {DONE} THEN 1000000000 ELSE acknowledged END AS acknowledged FROM work",
    "m17_stages_begun": f"WITH {R} SELECT video_id, stage, (max(attempt) + 1)::INTEGER AS attempt, 'running' AS status FROM runs GROUP BY ALL UNION ALL SELECT DISTINCT video_id, 'assemble', 1, 'running' FROM runs",
    "k9_transcripts": f"WITH {T} SELECT video_id, count(*)::INTEGER AS segments, sha256(string_agg(text, chr(10) ORDER BY start_seconds, CASE WHEN is_silence THEN 1 ELSE 0 END, line) || chr(10)) AS sha256 FROM t GROUP BY 1",
    "k10_gap_files": f"WITH {Q}, {B}, g AS (SELECT video_id, sum(CASE WHEN b.status = 'skipped' THEN pictures ELSE 0 END)::BIGINT AS gaps, sum(CASE WHEN b.status <> 'skipped' THEN pictures ELSE 0 END)::BIGINT AS described FROM batches b JOIN vr USING (run_id) GROUP BY 1) SELECT video_id, gaps, described, CASE WHEN gaps > 0 THEN 'gaps.txt' END AS file FROM g",
    "k12_provenance": f"""WITH {V}, {Q}, a AS (SELECT job_id, string_agg('{{"sequence":' || sequence || ',"version":' || version || '}}', ',' ORDER BY sequence, version) AS v FROM videos WHERE active GROUP BY 1)
      SELECT job_id, '{{"job_id":' || job_id || ',"videos":[' || v || '],"stages":["' || stage || ':' || status || '"]}}' AS json FROM a JOIN vr ON run_id = job_id""",
    "k18_batch_states": f"WITH {B} SELECT batch_id, CASE WHEN batch_id % 3 > 0 THEN status ELSE 'open' END AS status FROM batches",
    "x2_structures": """WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN chr(8195) ELSE chr(160) END AS w FROM events), y AS (SELECT event_id, 'password' || w || '=' || w || '[REDACTED] end' AS note FROM x)
      SELECT event_id, note, CASE WHEN event_id % 3 > 0 THEN '[REDACTED]' END AS api_key, note || '|' || event_id AS list, '[REDACTED]' AS session, event_id::VARCHAR AS plain FROM y""",
    "s2_probe": """SELECT event_id AS video_id, 'mov,mp4' AS container, 'h264' AS video_codec, 'aac' AS audio_codec, 1280 AS width, 720 AS height,
      CASE WHEN event_id % 3 = 2 THEN 1.0 ELSE event_id % 7 + 0.5 END::DOUBLE AS seconds, NULL::VARCHAR AS problem FROM events""",
    "pk10_fits": f"WITH {ASSESS} SELECT job_id, sequence, CASE state WHEN 'ok' THEN 'Fits with the rest' WHEN 'no_visual' THEN 'No descriptions' WHEN 'provenance_mismatch' THEN 'Older wording' ELSE 'Pictures missing' END AS label FROM found WHERE state <> 'gaps'",
    "o4_emphasis_order": f"SELECT video_id, index, seconds, (row_number() OVER (PARTITION BY video_id ORDER BY seconds, index))::INTEGER AS place FROM ({OTHERS['pk11_emphasis']})",
    "k11_handoff": f"WITH {PATHS} SELECT 'out/' || CASE WHEN k % 11 = 0 THEN 'analysis_input' ELSE k::VARCHAR END AS folder, count(*) FILTER (path LIKE '%.jpg') AS pictures, count(*) FILTER (path LIKE '%.txt') AS documents, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1",
    "p12_stale_claims": "SELECT event_id, event_id % 7 < 2 OR event_id % 240 > 120 AS stale FROM events",
    "t4_refresh": "SELECT 'same' AS what, false AS refresh UNION ALL SELECT 'moved', true",
}

# cut to 3,000 characters: 2,000 tokens of 3.6 characters less a header of 200 and a margin of 4,000
_CUT = OTHERS["pk3_split"].replace("2000", "3000")
_CUT = _CUT[: _CUT.rindex("SELECT doc_id AS key")]
SQL["pk5_split_parts"] = f"""{_CUT} SELECT doc_id AS key, piece::INTEGER AS part, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS of,
  sha256(rtrim(CASE WHEN tail = '' THEN chunk ELSE '  <continues_from_previous_part>' || chr(10) || tail || chr(10) || '  </continues_from_previous_part>' || chr(10) || chr(10) || chunk END, chr(10))) AS sha256, length(tail)::INTEGER AS overlap_characters
  FROM (SELECT *, coalesce(right(lag(chunk) OVER (PARTITION BY doc_id ORDER BY piece), 2000), '') AS tail FROM p)"""

_HMS = "printf('%02d:%02d:%02d', trunc(start_seconds)::BIGINT // 3600, trunc(start_seconds)::BIGINT // 60 % 60, trunc(start_seconds)::BIGINT % 60)"
_BY = "ORDER BY start_seconds, is_silence, line"
SQL |= {
    "k9_transcript_files": f"""WITH {T}, f AS (SELECT video_id, string_agg(chr(10) || '{{"start_seconds":' || start_seconds || ',"end_seconds":' || end_seconds || ',"timestamp":"' || {_HMS} || '","text":' || to_json(text) || ',"is_silence":' || is_silence || '}}', ',' {_BY}) AS segments, string_agg({_HMS} || '  ' || text || chr(10), '' {_BY}) AS text, count(*) AS n FROM t GROUP BY 1)
      SELECT video_id || '/transcript.json' AS name, sha256('{{"version":1,"source_filename":"v' || video_id || '.mp4","provenance":{{' || CASE WHEN video_id % 3 = 0 THEN '"backend":"cpu"' ELSE '' END || '}},"segment_count":' || n || ',"segments":[' || segments || ']}}' || chr(10)) AS sha256 FROM f UNION ALL SELECT video_id || '/transcript.txt', sha256(text) FROM f""",
    "k10_gap_texts": f"""WITH {Q}, {B}, s AS (SELECT video_id, batch_id * 37 % 2000000 AS i, CASE WHEN batch_id % 3 > 0 THEN 'refused after ' || pictures || ' tries' ELSE '' END AS reason FROM batches b JOIN vr USING (run_id) WHERE b.status = 'skipped')
      SELECT video_id || '/gaps.txt' AS name, sha256(count(*) || ' picture(s) have no description.' || chr(10) || chr(10) || 'Everything else in this video was processed normally. You can ask for' || chr(10) || 'these to be described again later without redoing any other work.' || chr(10) || chr(10) || string_agg(printf('  picture %6d   %s', i + 1, reason) || chr(10), '' ORDER BY i, reason)) AS sha256 FROM s GROUP BY video_id""",
    "m6_repairs": f"""WITH {W}, {V}, {R}, {PATHS} SELECT 'batch' AS kind, event_id::VARCHAR AS id, 'running' AS was, 'pending' AS now, NULL::VARCHAR AS event FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'run', run_id::VARCHAR, status, 'pending', NULL FROM runs WHERE status = 'running'
      UNION ALL SELECT 'video', job_id || '/' || sequence, status, 'pending', NULL FROM videos JOIN work USING (job_id) WHERE active AND status IN {RUNNING} UNION ALL SELECT 'job', job_id::VARCHAR, status, 'ready', 'Picked this back up after an interruption. Everything finished before the interruption was kept.' FROM work WHERE status IN {RUNNING}
      UNION ALL SELECT 'file', path, 'registered', NULL, NULL FROM files WHERE size % 30 = 0""",
    "m17_stages_finished": f"""WITH {R}, x AS (SELECT *, video_id % 2 = 0 AND status = 'running' AND attempt = max(attempt) OVER (PARTITION BY video_id, stage) AS closes, video_id % 6 = 0 AS bad FROM runs)
      SELECT video_id, stage, attempt, run_id, CASE WHEN closes THEN CASE WHEN bad THEN 'failed' ELSE 'completed' END ELSE status END AS status, CASE WHEN closes THEN 100 ELSE total END AS total, CASE WHEN closes THEN CASE WHEN bad THEN 0 ELSE 100 END ELSE done END AS done, CASE WHEN closes THEN 1000000000::BIGINT END AS finished_at, CASE WHEN closes AND bad THEN 'no room' END AS error FROM x""",
    "s21_newest_first": f"WITH {ASSESS} SELECT row_number() OVER (ORDER BY created DESC NULLS LAST, job_id, sequence) AS place, job_id, sequence, state, detail, created AS updated FROM found WHERE status IN {DONE}",
}

_LEFT = "(age / (done - skipped) * (total - done))"
_AT = lambda x: f"CASE WHEN {x} <= 0 THEN '—' WHEN {x} >= 3600 THEN printf('%d:%02d:%02d', {x} // 3600, ({x} // 60) % 60, {x} % 60) ELSE printf('%d:%02d', {x} // 60, {x} % 60) END"
SQL["f13_stage_screen"] = f"""WITH {Q}, r AS (SELECT video_id, stage, status, CASE WHEN run_id % 9 > 0 THEN total * 7 ELSE 0 END AS total, done, run_id % 4 * 5 AS skipped, (run_id % 3000)::DOUBLE AS age FROM vr WHERE NOT (video_id % 5 = 0 AND stage = 'visual') QUALIFY row_number() OVER (PARTITION BY video_id, stage ORDER BY run_id DESC) = 1),
  k AS (SELECT DISTINCT video_id FROM vr WHERE NOT (video_id % 5 = 0 AND stage = 'visual')), v AS (SELECT video_id FROM k UNION ALL SELECT video_id + 1000000 FROM k),
  s(place, stage, label) AS (VALUES (1, 'frames', 'Pictures'), (2, 'transcribe', 'Transcript'), (3, 'visual', 'Descriptions'), (4, 'assemble', 'Put together'))
  SELECT video_id, place, label, coalesce(floor({percent()}), 0)::INTEGER AS percent,
    CASE WHEN status IS NULL THEN CASE WHEN stage = 'visual' AND video_id % 3 > 0 AND video_id % 2 = 1 THEN 'Not run' ELSE 'Waiting' END WHEN status = 'completed' THEN 'Done' WHEN total > 0 AND stage = 'transcribe' THEN {_AT('done')} || ' of ' || {_AT('total')} WHEN total > 0 THEN format('{{:,}}', done) || ' of ' || format('{{:,}}', total)
      WHEN status = 'running' THEN 'Working' ELSE 'Pending' END AS detail, coalesce(status, 'ready') AS state,
    CASE WHEN coalesce(status, '') <> 'running' OR age < 45 OR total = 0 OR done <= 0 OR done >= total OR done <= skipped THEN '' WHEN {_LEFT} < 30 THEN 'nearly done' ELSE {span(_LEFT)} || ' left' END AS eta, coalesce(status = 'running' AND total <= 0, false) AS indeterminate
  FROM v CROSS JOIN s LEFT JOIN r USING (video_id, stage)"""
