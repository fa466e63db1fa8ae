"""The corpus operators' registered queries (opN_<name>) and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole table
and derives digest columns where the result contract asks for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, context_tree, decontaminate, hard_negatives, importance, licences, line_dedup, minhash, neighbours, substring_dedup, token_counts, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), minhash.Shape(words=3, percent=85))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), least=0.8)
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_matches", "best_score")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=2048)


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"), width=35).drop("spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.report(table(spark, sf_dir, "documents"), least=3, length=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least=20, seed=42)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"), positives=5, negatives=5)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP9_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
),
hot AS (SELECT win FROM win GROUP BY win HAVING count(*) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM win SEMI JOIN hot USING (win) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN sha256(array_to_string(words, ' '))
  ELSE sha256(coalesce((SELECT string_agg(words[i], ' ' ORDER BY i) FROM (SELECT unnest(range(1, len(words) + 1)) AS i) p ANTI JOIN (SELECT unnest(gone) AS i) g USING (i)), '')) END AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


_OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS s FROM w
),
item AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
pair AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM item a JOIN item b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
),
edge AS MATERIALIZED (
  SELECT a, b FROM pair JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)
),
near AS (SELECT a AS p, b AS q FROM edge UNION ALL SELECT b, a FROM edge),
reach AS (SELECT doc_id AS p, doc_id AS r FROM sets UNION SELECT near.q, reach.r FROM reach JOIN near ON near.p = reach.p),
root AS (SELECT p, min(r) AS r FROM reach GROUP BY p)
SELECT doc_id, len(s)::BIGINT AS n_shingles, r AS component_id, doc_id = r AS kept FROM sets JOIN root ON p = doc_id
"""


_OP10_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size)
),
hit AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
agg AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(i, i + size)))))::BIGINT AS n_hit, count(DISTINCT item_id) AS n_items,
    sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS items_sha256
  FROM hit GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN agg USING (doc_id)
"""


def _op2_sql(least: float = 0.8) -> str:
    """The same coefficient by a join of distinct bigrams, without size bounds or arrays."""
    values = ", ".join(f"({k}, '{name}', '{b}')" for k, (name, own) in enumerate(licences.templates()) for b in own)
    return rf"""
WITH tb(t, name, bigram) AS (VALUES {values}),
ts AS (SELECT t, name, count(*) AS n FROM tb GROUP BY t, name),
low AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '[^a-z0-9
]+', ' ', 'g') AS x FROM documents),
unit AS (
  SELECT doc_id, row_number() OVER () AS u, string_split(unit, ' ') AS w FROM (
    SELECT DISTINCT doc_id, trim(unit, ' ') AS unit FROM (
      SELECT doc_id, unnest(string_split(x, chr(10))) AS unit FROM low
      UNION ALL SELECT doc_id, regexp_replace(unnest(string_split_regex(x, '\n ?(?:\n ?)+')), '[ \n]+', ' ', 'g') FROM low
      UNION ALL SELECT doc_id, regexp_replace(x, '[ \n]+', ' ', 'g') FROM low))
),
ub AS MATERIALIZED (SELECT doc_id, u, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS bigram FROM unit WHERE len(w) > 1),
us AS (SELECT u, count(*) AS n FROM ub GROUP BY u),
m AS (
  SELECT ub.doc_id, ub.u, ts.name, 2.0::DOUBLE * count(*) / (us.n + ts.n) AS d
  FROM ub JOIN tb USING (bigram) JOIN us USING (u) JOIN ts ON ts.t = tb.t GROUP BY ub.doc_id, ub.u, tb.t, ts.name, us.n, ts.n
),
best AS (SELECT doc_id, u, max(d) AS d, arg_min(name, (-d, name)) AS name FROM m WHERE d >= {least} GROUP BY doc_id, u),
good AS (SELECT doc_id, count(*) AS n_matches, max(d) AS best_score, array_to_string(list_sort(list_distinct(list(name))), ',') AS licences FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_matches, 0) AS n_matches, coalesce(best_score, 0.0) AS best_score
FROM documents LEFT JOIN good USING (doc_id)
"""


_OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

_OP7_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


_OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, k, lines[k] AS line, translate(trim(lines[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
),
held AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, k, line, coalesce(keeper <> doc_id, false) AS gone FROM l LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: crc32 bit by bit has no SQL function; its table is made by the recursion, bytes are folded by list_reduce.
_OP12_SQL = r"""
WITH RECURSIVE step(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
f AS MATERIALIZED (
  SELECT side, id, f, count(*) AS n FROM (
    SELECT side, id, unnest(words) AS f FROM w
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w WHERE len(words) > 1
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) FROM w WHERE len(words) > 2
  ) GROUP BY ALL
),
crc AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM f), tab
),
x AS MATERIALIZED (SELECT side, id, bucket, n FROM f JOIN crc USING (f)),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (S_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t FROM x GROUP BY bucket) p,
    (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS S_all, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS T_all FROM x) q
),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM x JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) AS n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN d ON id = doc_id JOIN (SELECT id AS wid, words FROM w WHERE side = 'd') ON wid = doc_id
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

_OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c AS positive, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
n AS (
  SELECT p.a, positive, ps, c AS negative, score AS ns, row_number() OVER (PARTITION BY p.a, positive ORDER BY score DESC, c) AS r
  FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * ps <= 100 * score AND 100 * score <= 100 * ps
)
SELECT a AS anchor_id, positive AS positive_id, r::INTEGER AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5
"""


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_licence_scan": op2_licence_scan,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_context_tree": op4_context_tree,
        "op5_warc": op5_warc,
        "op7_neighbours": op7_neighbours,
        "op6_token_counts": op6_token_counts,
        "op8_toxicity": op8_toxicity,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_line_dedup": op11_line_dedup,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": _OP1_SQL,
        "op2_licence_scan": _op2_sql(),
        "op5_warc": _OP5_SQL,
        "op7_neighbours": _OP7_SQL,
        "op9_substring_dedup": _OP9_SQL,
        "op10_decontaminate": _OP10_SQL,
        "op11_line_dedup": _OP11_SQL,
        "op12_importance_resampling": _OP12_SQL,
        "op13_hard_negatives": _OP13_SQL,
    }
