"""DuckDB SQL of the longer contracts: conversation repair and spelling variants."""

from __future__ import annotations


def _crc32(codes: str) -> str:
    """crc32 of a list of bytes, bit by bit."""
    return (
        f"xor(4294967295, list_reduce([4294967295::BIGINT] || ({codes})::BIGINT[], lambda r, b:"
        " list_reduce([xor(r, b)] || range(8)::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    )


def _ascii_bytes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c))"


#: Texts of letters up to U+00FF in UTF-8: those from U+0080 on take two bytes.
def _latin_bytes(text: str) -> str:
    each = "CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END"
    return f"flatten(list_transform(string_split({text}, ''), lambda c: {each}))"


CONVERSATIONS = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_ascii_bytes("key"))} % 20 AS k
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
kept AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM base WHERE k <> 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         left(role, 1) AS c FROM kept),
lined AS (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM ranked),
one(p, q, w) AS (VALUES ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a'), ('0', 's', 's')),
after(p, q, edit, cost, ins, w) AS (
  SELECT p, q, 'K', 0, '', w FROM one
  UNION ALL SELECT p, q, 'R', 1, '', w FROM one WHERE w <> 's'
  UNION ALL SELECT x.p, y.q, 'I' || e, 5 + (e = 'R')::INT, x.w, y.w
            FROM one x JOIN one y ON x.q = y.p CROSS JOIN (VALUES ('K'), ('R')) t(e) WHERE x.w <> 's' AND y.w <> 's'
  UNION ALL SELECT p, p, 'D', 2, '', '' FROM (VALUES ('0'), ('s'), ('u'), ('a')) t(p)),
names(w, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
moves AS (
  SELECT after.*, coalesce(n.name || ':' || chr(10), '') AS inserted, m.name AS new_role
  FROM after LEFT JOIN names n ON n.w = after.ins LEFT JOIN names m ON m.w = after.w),
path AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS state, {{'cost': 0::BIGINT, 'audit': '', 'body': ''}} AS best FROM ids
  UNION ALL
  SELECT p.conv_id, l.i, m.q, min({{
           'cost': p.best.cost + m.cost + CASE WHEN l.fault = 'truncated' AND m.edit <> 'D' THEN 5 ELSE 0 END,
           'audit': p.best.audit || m.edit,
           'body': CASE WHEN m.edit = 'D' THEN p.best.body ELSE p.best.body || CASE WHEN p.state = '0' THEN '' ELSE chr(10) END
                   || m.inserted || CASE WHEN ends_with(m.edit, 'R') THEN m.new_role ELSE l.role END || ':' || l.text END}})
  FROM path p JOIN lined l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.i = p.i + 1
  JOIN moves m ON m.p = p.state AND (m.edit = 'D' OR l.fault NOT IN ('blank', 'duplicate'))
       AND (NOT ends_with(m.edit, 'K') OR m.w = l.c)
  GROUP BY p.conv_id, l.i, m.q),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM lined GROUP BY conv_id),
ends AS (
  SELECT p.conv_id, min(CASE WHEN state = 'u' THEN {{'cost': best.cost + 5, 'audit': best.audit || 'I', 'body': best.body || chr(10) || 'assistant:'}}
                             ELSE best END) AS best
  FROM path p LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE p.state <> 's' AND p.i = coalesce(s.n, 0) GROUP BY p.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit, sha256(e.best.body) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""

SPELLING = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, count(*) AS m,
         translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM raw WHERE length(run) >= 6 GROUP BY ALL),
sums AS (SELECT *, {_crc32(_latin_bytes("id || ':' || run"))} AS h FROM runs),
written AS (
  SELECT m, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                 ELSE run END AS word FROM sums),
v AS (SELECT word, sum(m)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
shorter AS (SELECT DISTINCT c.word, c.n, v.word AS near, v.n AS near_n FROM cut c JOIN v ON c.rest = v.word),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION ALL SELECT word, near, near_n FROM shorter
  UNION ALL SELECT near, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, min({{'m': -near_n, 'near': near}}) AS b FROM near GROUP BY word),
linked AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN -b.m >= 5 * n THEN b.near END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END::BIGINT AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at, form AS next FROM linked
  UNION ALL SELECT w.word, l.word, l.form FROM walk w JOIN linked l ON l.word = w.next)
SELECT l.word, n, n_near, l.form, form_n, w.at AS root FROM linked l JOIN walk w ON w.word = l.word AND w.next IS NULL
"""
