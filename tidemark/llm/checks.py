"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

import string

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BIT = " + ".join(f"{1 << 4 - j} * substr(bits, 5 * k + {1 + j}, 1)::INT" for j in range(5))
_NIBBLES = "".join(f"{n:04b}" for n in range(16))

OP4 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{string.ascii_uppercase}234567', 1 + {_BIT}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

# smallest node reachable from each node over the links of l(u, v), both directions in it
_REACH = """reach(node, dest) AS (SELECT u, u FROM l UNION SELECT node, v FROM reach JOIN l ON dest = u),
c AS (SELECT node, min(dest) AS component FROM reach GROUP BY 1)"""

OP8 = f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98::DOUBLE),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id) LEFT JOIN c ON node = vec_id"""

OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS n FROM d),
h AS (SELECT doc_id, p, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM w),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM h WHERE p + 50 <= n),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM f WHERE first < doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM w ANTI JOIN g USING (doc_id, p) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)"""

OP10 = f"""WITH RECURSIVE t AS (SELECT doc_id, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
d AS (SELECT doc_id, {_WORDS} AS ws FROM t),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS n FROM d),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM w)
  WHERE p + 5 <= n OR (n < 5 AND p = 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * same >= 80 * (x.n + y.n - same)),
{_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id"""

OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, row_number() OVER () AS r FROM documents),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS n FROM d),
t AS (SELECT r, p, n, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) AS t FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, t) AS k FROM t WHERE p + 3 <= n),
g AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM c WHERE k > 1) GROUP BY 1),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM d JOIN l USING (r) LEFT JOIN g USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines,
   word_chars < 3 * n_words, word_chars > 10 * n_words, 100 * n_capitals > 50 * word_chars] AS fails FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals,
  list_sum(list_transform(range(7), lambda k: fails[k + 1]::BIGINT << k))::BIGINT AS failed, base_failed, NOT list_contains(fails, true) AS kept FROM f"""
