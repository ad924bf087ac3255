"""SQL for DuckDB of the queries that SQL can express; ids are taken to be distinct, as in the tables it runs on."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, k, md5(array_to_string(ws[k:k + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM d)),
hit AS (SELECT doc_id, k FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM hit),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[k:k + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS k FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.least, d.doc_id)::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(w) AS least FROM r GROUP BY v) c ON c.v = d.doc_id
"""

OP6 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT DISTINCT a AS v, a AS w FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w),
c AS (SELECT v, min(w) AS least FROM r GROUP BY v)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, coalesce(least, vec_id)::BIGINT AS component_id, coalesce(least, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON c.v = vec_id
"""

OP5 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r)),
o AS (SELECT *, row_number() OVER w AS place, len({WORDS.format('text')}) + 4 AS tokens, length(regexp_replace(role, '[\\<\[>]', '..', 'g')) + length(regexp_replace(text, '[\\<\[>]', '..', 'g')) + 7 + 8 AS size FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM o),
own AS MATERIALIZED (SELECT *, prefix // 1024 AS win, place = 1 AND role = 'system' AS system FROM p),
spans AS (SELECT conv_id, win, min(prefix) AS start FROM own GROUP BY ALL),
nexts AS (SELECT conv_id, win, lead(start) OVER (PARTITION BY conv_id ORDER BY win) AS next_start FROM spans),
sizes AS (SELECT conv_id, sum(size) AS n FROM (SELECT conv_id, size FROM own UNION ALL
  SELECT o.conv_id, o.size FROM own o JOIN nexts x ON x.conv_id = o.conv_id AND x.win = o.win WHERE NOT o.system AND x.next_start - o.prefix <= 256 UNION ALL
  SELECT o.conv_id, o.size FROM own o JOIN spans s ON s.conv_id = o.conv_id WHERE o.system AND s.win > 0) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(n)::BIGINT AS formatted_chars FROM own JOIN sizes USING (conv_id) GROUP BY conv_id
"""

#: Words of a repeated run; every line of one has a word, so it has as many lines at most.
LEAST = 3

OP2 = rf"""
WITH l AS (SELECT doc_id, line, k, len({WORDS.format('line')}) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL)),
w AS MATERIALIZED (SELECT doc_id, line, k, n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM l WHERE n > 0),
ahead AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + {LEAST} AND b.upto - a.upto + a.n >= {LEAST} GROUP BY ALL),
back AS (SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i - {LEAST} AND a.i AND a.upto - b.upto + b.n >= {LEAST} GROUP BY a.doc_id, a.i),
r AS (SELECT * FROM ahead UNION SELECT doc_id, s, e FROM back),
c AS MATERIALIZED (SELECT r.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS content FROM r JOIN w ON w.doc_id = r.doc_id AND w.i BETWEEN s AND e GROUP BY r.doc_id, s, e),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS copy FROM c) WHERE copy > 1),
gone AS (SELECT DISTINCT w.doc_id, w.k FROM w JOIN later x ON x.doc_id = w.doc_id AND w.i BETWEEN x.s AND x.e),
f AS (SELECT d.doc_id, d.text, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS lines_removed FROM documents d),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM l ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT f.doc_id, n_lines, lines_removed, sha256(CASE WHEN lines_removed = 0 THEN f.text WHEN lines_removed = n_lines THEN '' ELSE kept.text END) AS kept_sha256 FROM f LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other AS negative_id, positive_score, score AS negative_score FROM pos JOIN p USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
"""
