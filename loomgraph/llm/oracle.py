"""DuckDB SQL for the rows of the queries that SQL can express, over all documents or vectors, by the plainest definition."""

from __future__ import annotations

from .search import B, K1

# doc_id and its words
_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"
# the least id that links reach, for every row of `ids`
_REACH = "reach AS (SELECT id, id AS r FROM ids UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r), least AS (SELECT id, min(r) AS r FROM reach GROUP BY id), links AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)"

NEAR_DUPLICATES = f"""
WITH RECURSIVE {_WORDS},
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: md5(array_to_string(ws[i:i+4], ' '))))) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS own FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
ids AS (SELECT doc_id AS id FROM documents), {_REACH},
copies AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY own) AS copy_of FROM n)
SELECT ids.id AS doc_id, r AS class_id, coalesce(copy_of, ids.id) AS copy_of, coalesce(n, 0) AS n_links, ids.id = r AS kept
FROM ids JOIN least ON least.id = ids.id LEFT JOIN links ON links.id = ids.id LEFT JOIN copies ON copies.id = ids.id"""

LM_SCORING = f"""
WITH {_WORDS},
t AS (SELECT doc_id, len(ws) AS n_words, unnest(list_transform(range(1, len(ws) + 1), lambda i: {{'i': i, 'g1': ws[i], 'g2': CASE WHEN i > 1 THEN ws[i-1] || ' ' || ws[i] END, 'g3': CASE WHEN i > 2 THEN ws[i-2] || ' ' || ws[i-1] || ' ' || ws[i] END}})) AS x FROM w),
f AS (SELECT doc_id, x.i AS i, greatest(1, sum(1) OVER () - n_words) AS n,
  count(*) OVER (PARTITION BY x.g1) - count(*) OVER (PARTITION BY doc_id, x.g1) AS f1,
  CASE WHEN x.i > 1 THEN count(*) OVER (PARTITION BY x.g2) - count(*) OVER (PARTITION BY doc_id, x.g2) END AS f2,
  CASE WHEN x.i > 2 THEN count(*) OVER (PARTITION BY x.g3) - count(*) OVER (PARTITION BY doc_id, x.g3) END AS f3 FROM t),
c AS (SELECT *, lag(f1) OVER o AS c1, lag(f2) OVER o AS c2 FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
v1 AS (SELECT *, (CASE WHEN f1 > 0 THEN f1 ELSE 0.4::DOUBLE END) / n AS v FROM c),
v2 AS (SELECT * REPLACE (CASE WHEN f2 IS NULL THEN v WHEN f2 > 0 THEN f2::DOUBLE / greatest(c1, 1) ELSE 0.4::DOUBLE * v END AS v) FROM v1),
v3 AS (SELECT * REPLACE (CASE WHEN f3 IS NULL THEN v WHEN f3 > 0 THEN f3::DOUBLE / greatest(c2, 1) ELSE 0.4::DOUBLE * v END AS v) FROM v2),
s AS (SELECT doc_id, sum(ln(v)) AS s FROM v3 GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0), 6) AS score, round(s / nullif(len(ws), 0), 6) AS mean FROM w LEFT JOIN s ON s.doc_id = w.doc_id"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
ids AS (SELECT vec_id AS id FROM v), {_REACH}
SELECT ids.id AS vec_id, coalesce(n, 0) AS n_links, r AS component_id, ids.id = r AS kept FROM ids JOIN least ON least.id = ids.id LEFT JOIN links ON links.id = ids.id"""

SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ts FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
a AS (SELECT count(*) AS n, sum(len(ts))::DOUBLE / count(*) AS mean FROM d),
s AS (SELECT q.doc_id AS query_id, tf.doc_id, round(sum(q.f * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.f * {K1 + 1} / (tf.f + {K1} * ({1 - B} + {B} * len(d.ts) / mean))), 6) AS score
  FROM tf q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term JOIN d ON d.doc_id = tf.doc_id CROSS JOIN a WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

SUBSTRING_DEDUP = f"""
WITH {_WORDS},
h AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: {{'i': i, 'k': md5(array_to_string(ws[i:i+19], ' '))}})) AS x FROM w WHERE len(ws) >= 20),
r AS (SELECT doc_id, x.i AS i FROM h QUALIFY row_number() OVER (PARTITION BY x.k ORDER BY doc_id, x.i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: {{'i': i, 'word': ws[i]}})) AS x FROM w),
k AS (SELECT p.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE gone.i IS NULL), '') AS kept FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = x.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

ORACLE_SQL = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op2_lm_scoring": LM_SCORING,
    "op3_embedding_dedup": EMBEDDING_DEDUP,
    "op5_search": SEARCH,
    "op7_substring_dedup": SUBSTRING_DEDUP,
}
