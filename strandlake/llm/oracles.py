"""SQL of the operators that SQL can express, besides mixing: repeated passages and near-duplicates, by brute force."""

REPEATED_PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
g AS (SELECT k.doc_id, list(k.i) AS starts FROM k JOIN f USING (h) WHERE f.first < k.doc_id GROUP BY 1),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: generate_series(s, s + 49)))) AS gone FROM g),
u AS (SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d JOIN c USING (doc_id)),
x AS (SELECT u.doc_id, u.i, u.word FROM u ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM c) z USING (doc_id, i)),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
