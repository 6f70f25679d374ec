"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op3_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size,
        CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM s),
l AS (SELECT *,
        (CAST(sum(source_size) OVER () AS DOUBLE)
         - 3 * CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
        CAST(floor(target) AS BIGINT) AS budget,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken, source
FROM e""",
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(embedding), embedding) = 1),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_chat_formatting": r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || r || '<|text|>' || t || '<|end|>')) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id""",
    "op6_suffix_array_dedup": """
WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, n, unnest(range(n)) AS i, x FROM h WHERE n > 0),
w AS (SELECT doc_id, i, hex(x[i + 1 : i + 1]) AS byte, CASE WHEN i + 100 <= n THEN md5_number(x[i + 1 : i + 100]) END AS win FROM b),
d AS (SELECT doc_id, i, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS dup FROM w),
g AS (SELECT doc_id, i, byte, max(CAST(dup AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM d),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM g),
r AS (SELECT doc_id, count(*) AS n, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN r USING (doc_id)""",
    "op11_prefix_trie": """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, xor(CAST(4294967295 AS BIGINT), list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) % 6 AS h
      FROM (SELECT DISTINCT c FROM t)),
u AS (
  SELECT v.c, 0 AS own, t.p, t.r, t.x FROM v JOIN t ON t.c = v.c - v.c % 100 AND t.p <= v.h
  UNION ALL SELECT v.c, 1, t.p, t.r, t.x FROM v JOIN t ON t.c = v.c AND t.p > v.h),
w AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, md5(md5(r) || md5(x)) AS turn, length(x) AS chars FROM u),
q AS (
  SELECT c, d, chars, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS node FROM w
  UNION ALL SELECT c, 0, 0, '' FROM v),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM q GROUP BY node, d),
k AS (SELECT substr(node, 1, CAST(32 * (d - 1) AS BIGINT)) AS above, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.above = n.node),
s AS (SELECT q.node, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.chars) AS BIGINT) AS saved_tokens
      FROM m JOIN q ON q.c = m.conv_id AND q.d <= m.d GROUP BY q.node),
e AS (SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256
      FROM (SELECT c, arg_max(node, d) AS node FROM q GROUP BY c) GROUP BY node)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM m JOIN s ON s.node = m.node LEFT JOIN e ON e.node = m.node LEFT JOIN n p ON m.d > 0 AND p.node = substr(m.node, 1, CAST(32 * (m.d - 1) AS BIGINT))""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS place,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
z AS (SELECT doc_id, place, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM z),
f AS (SELECT place, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT place, unnest(terms) AS term FROM z) GROUP BY place, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, g GROUP BY term),
i AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
s AS (SELECT item_id, z.doc_id, z.place,
             CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN f USING (term) JOIN z USING (place), g GROUP BY item_id, z.doc_id, z.place),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""",
}
