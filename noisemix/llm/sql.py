"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH fold AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM (SELECT *, least(13, len(w)) AS m FROM items WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM fold, lengths WHERE len(w) >= m)
), hits AS (SELECT rid, item_id, i, grams.m AS m FROM grams JOIN windows USING (g, m)),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM fold LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""

JACCARD = r"""
WITH RECURSIVE fold AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rid, w, least(3, len(w)) AS k, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM fold WHERE len(w) > 0)
), sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
common AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
  SELECT rid AS a, rid AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least_id AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN fold ON fold.rid = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM fold LEFT JOIN sizes USING (rid) LEFT JOIN least_id USING (rid)
"""

TOP_K = r"""
WITH parts AS (
  SELECT vec_id, pos, floor(256 * embedding[pos]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
), bad AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) WHERE e IS NULL OR NOT isfinite(e)),
good AS (SELECT * FROM parts WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM good q JOIN good c ON q.pos = c.pos AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""

TOKEN_COUNTS = r"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
"""

TOOL_CALLS = r"""
WITH numbered AS (
  SELECT *, coalesce(role IN ('user', 'assistant'), false) AND conv_id IS NOT NULL AND turn IS NOT NULL AS linkable,
    row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY coalesce(text, ''), text NULLS FIRST) AS k
  FROM conversations
), named AS (
  SELECT *, conv_id || ':' || CASE role WHEN 'user' THEN turn ELSE turn - 1 END || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS call_id
  FROM numbered WHERE linkable
), calls AS (
  SELECT conv_id, turn, call_id, coalesce(text, '') AS asked, row_number() OVER w - 1 AS level, lag(call_id) OVER w AS after
  FROM named WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, k)
), results AS (
  SELECT *, coalesce(text, '') AS content FROM named WHERE role = 'assistant'
), alone AS (
  SELECT conv_id, turn, role, text, 'no call' AS status FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT conv_id, turn, role, text, 'plain' FROM numbered WHERE NOT linkable
)
SELECT calls.conv_id, calls.turn, call_id, level::INTEGER AS level,
  CASE WHEN length(asked) < 1 THEN '$.n_chars: below minimum' WHEN length(asked) > 400 THEN '$.text: too long'
    WHEN content IS NULL THEN 'no result' ELSE 'ok' END AS status,
  '{"after":' || coalesce(to_json(after)::VARCHAR, 'null') || ',"arguments":{"n_chars":' || length(asked) || ',"text":' || to_json(asked)
    || '},"id":"' || call_id || '","name":"answer","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS line
FROM calls LEFT JOIN results USING (call_id)
UNION ALL
SELECT conv_id, turn, NULL, NULL, status,
  '{"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}'
FROM alone
"""


def crc32(text: str) -> str:
    """Checksum of an ASCII text in SQL, bit by bit; null for null."""
    bits = "list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"


MERKLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, row_number() OVER () AS rid,
    CASE WHEN CRC32 % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
      lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')) AS f
  FROM documents
), leaves AS (
  SELECT doc_id, source, rid, sha256(array_to_string(f, '') || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(array_to_string(f, '') || coalesce(strlen(changed)::VARCHAR || ':' || changed, '-')) AS claimed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n FROM leaves
), low AS (
  SELECT source, 0 AS level, place, n, leaf AS h FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM low WHERE n > 1 GROUP BY source, level, place // 3
), subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, place, n, h FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM high WHERE n > 1 GROUP BY level, place // 3
), runs AS (
  SELECT false AS top, source, level, place, h, n FROM low UNION ALL SELECT true, NULL, level, place, h, n FROM high
), sides AS (
  SELECT top, source, level, place,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
  FROM runs WHERE n > 1 WINDOW w AS (PARTITION BY top, source, level, place // 3 ORDER BY place)
), fold AS (
  SELECT rid, source, false AS top, 0 AS level, place, claimed AS h, '' AS proof, false AS over FROM placed
  UNION ALL
  SELECT f.rid, f.source, f.top OR s.h IS NULL AND NOT f.over, CASE WHEN s.h IS NULL THEN 0 ELSE f.level + 1 END,
    CASE WHEN s.h IS NULL THEN (SELECT r.place FROM subroots r WHERE r.source IS NOT DISTINCT FROM f.source) ELSE f.place // 3 END,
    CASE WHEN s.h IS NULL THEN f.h ELSE sha256(s.pre || f.h || s.post) END,
    f.proof || coalesce(s.pre || s.post, ''), f.top AND s.h IS NULL
  FROM fold f LEFT JOIN (SELECT *, true AS h FROM sides) s
    ON s.top = f.top AND (f.top OR s.source IS NOT DISTINCT FROM f.source) AND s.level = f.level AND s.place = f.place
  WHERE NOT f.over
), root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, low.h AS subroot, root, sha256(proof) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM placed JOIN fold ON fold.rid = placed.rid AND fold.over
JOIN low ON low.source IS NOT DISTINCT FROM placed.source AND low.n = 1, root
""".replace("CRC32", crc32("doc_id::VARCHAR"))

PREFIX_TRIE = r"""
WITH turns AS (
  SELECT conv_id, r, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, CRC32 % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM turns)
), openings AS (
  SELECT c.conv_id, t.i, t.r, t.t FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
), rebuilt AS (
  SELECT * FROM openings
  UNION ALL
  SELECT conv_id, 1000000 + i, r, t FROM turns JOIN convs USING (conv_id) WHERE i > h
), paths AS (
  SELECT conv_id, coalesce(p, []) AS p FROM convs LEFT JOIN
    (SELECT conv_id, list(struct_pack(r := r, t := t) ORDER BY i) AS p FROM rebuilt GROUP BY conv_id) USING (conv_id)
), prefixes AS (
  SELECT conv_id, len(p) AS l, d, p[1:d] AS k FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths)
), nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE l = d), '')) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(k[d].t) END AS own
  FROM prefixes GROUP BY d, k
), children AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, k)),
subtrees AS (
  SELECT a AS d, k[1:a] AS k, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY 1, 2
)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM counted c JOIN subtrees USING (d, k) LEFT JOIN nodes p ON p.d = c.d - 1 AND p.k = c.k[1:c.d - 1]
""".replace("CRC32", crc32("conv_id::VARCHAR"))
