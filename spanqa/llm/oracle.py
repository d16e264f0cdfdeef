"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('20240:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT AS weight
  FROM sized GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS t FROM src),
levels AS (
  SELECT 0 AS k, (SELECT t FROM total)::DOUBLE / (SELECT sum(weight) FROM src)::DOUBLE AS level
  UNION ALL
  SELECT k + 1, nxt FROM (
    SELECT l.k, l.level,
           (SELECT ((SELECT t FROM total) - coalesce(sum(CASE WHEN 3 * s.source_size <= s.weight * l.level
                                                           THEN 3 * s.source_size END), 0))::DOUBLE
                   / nullif(sum(CASE WHEN 3 * s.source_size <= s.weight * l.level THEN 0 ELSE s.weight END), 0)::DOUBLE
            FROM src s) AS nxt
    FROM levels l) WHERE nxt > level),
top AS (SELECT max(level) AS level FROM levels),
plan AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS rest
  FROM (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM src, top)),
h1 AS (
  SELECT source, substr(draw, 1, 3) AS b1, sum(size)::BIGINT AS s FROM sized GROUP BY ALL),
c1 AS (
  SELECT h1.*, p.rest, sum(s) OVER (PARTITION BY h1.source ORDER BY b1) AS cum
  FROM h1 JOIN plan p ON h1.source IS NOT DISTINCT FROM p.source),
e1 AS (
  SELECT source, min(b1) AS b1, arg_min(cum - s, b1) AS base, min(rest) AS rest FROM c1 WHERE cum > rest GROUP BY source),
h2 AS (
  SELECT d.source, substr(draw, 4, 3) AS b2, sum(d.size)::BIGINT AS s, min(e.base) AS base, min(e.rest) AS rest
  FROM sized d JOIN e1 e ON d.source IS NOT DISTINCT FROM e.source AND substr(d.draw, 1, 3) = e.b1 GROUP BY ALL),
e2 AS (
  SELECT source, max(b2) AS b2
  FROM (SELECT *, base + sum(s) OVER (PARTITION BY source ORDER BY b2) AS cum FROM h2)
  WHERE cum - s / 2.0::DOUBLE <= rest GROUP BY source),
final AS (
  SELECT d.doc_id, d.size, p.source_size, p.target,
         p.whole + CASE WHEN substr(d.draw, 1, 3) < e1.b1
                          OR (substr(d.draw, 1, 3) = e1.b1 AND substr(d.draw, 4, 3) <= e2.b2) THEN 1 ELSE 0 END AS repeats
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
  LEFT JOIN e1 ON p.source IS NOT DISTINCT FROM e1.source
  LEFT JOIN e2 ON p.source IS NOT DISTINCT FROM e2.source)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, repeats::BIGINT AS repeats FROM final
"""

#: CTE `crc`: the 256 remainders of CRC-32, and the expression for the CRC-32 of an ASCII string.
CRC_TABLE = r"""
crc AS (
  SELECT list(t ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END,
                          b::BIGINT) AS t
    FROM range(256) AS r(b)))"""


def crc32(s: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string, given the list of remainders as crc.t."""
    step = "xor(c >> 8, list_extract(crc.t, (xor(c, x) & 255) + 1))"
    codes = f"list_transform(regexp_extract_all({s}, '.'), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


SQL["op12_merkle"] = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
texts AS (
  SELECT d.*, CASE WHEN {crc32("coalesce(doc_id, 0)::VARCHAR")} % 5 = 0 AND doc_id IS NOT NULL
                   THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS bad
  FROM documents d, crc),
coded AS (
  SELECT doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, bad
  FROM texts),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS bad_leaf
  FROM coded),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, r AS idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level, idx, digest, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT tree, level + 1 AS level, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
    FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16)),
subroots AS (SELECT tree, digest, level AS height FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, tree AS idx, digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level, idx, digest, count(*) OVER () AS n FROM (
    SELECT level + 1 AS level, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
    FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 16)),
top AS (SELECT digest AS root, level AS height FROM upper_nodes WHERE n = 1),
steps AS (
  SELECT p.tree, p.r, k.k AS level,
         CASE WHEN k.k < h.height THEN p.r // (16 ** k.k)::BIGINT ELSE p.tree // (16 ** (k.k - h.height))::BIGINT END AS idx
  FROM placed p JOIN subroots h USING (tree), top t,
       range(40) AS k(k) WHERE k.k < h.height + t.height),
sides AS (
  SELECT st.tree, st.r, st.level,
         coalesce(string_agg(CASE WHEN c.idx < st.idx THEN c.digest END, '' ORDER BY c.idx), '') AS l,
         coalesce(string_agg(CASE WHEN c.idx > st.idx THEN c.digest END, '' ORDER BY c.idx), '') AS rt
  FROM steps st JOIN (
    SELECT n.tree, n.level, n.idx, n.digest FROM nodes n JOIN subroots h USING (tree) WHERE n.level < h.height
    UNION ALL
    SELECT h.tree, h.height + u.level, u.idx, u.digest FROM subroots h, upper_nodes u, top t WHERE u.level < t.height) c
    ON c.tree = st.tree AND c.level = st.level AND c.idx // 16 = st.idx // 16
  GROUP BY ALL),
folded AS (
  SELECT tree, r, 0 AS level, bad_leaf AS h FROM placed
  UNION ALL
  SELECT f.tree, f.r, f.level + 1, sha256(s.l || f.h || s.rt)
  FROM folded f JOIN sides s ON s.tree = f.tree AND s.r = f.r AND s.level = f.level),
ends AS (SELECT tree, r, arg_max(h, level) AS folded_root FROM folded GROUP BY ALL),
proofs AS (SELECT tree, r, sha256(string_agg(l || rt, '' ORDER BY level)) AS proof FROM sides GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = t.root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN ends e USING (tree, r) LEFT JOIN proofs q USING (tree, r), top t
"""

_W = r"[^\x20\x09-\x0D]"
SQL["op11_conversations"] = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) AS copies(n) WHERE h <> 0 AND (n = 0 OR h = 3)),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(
           concat_ws(':', coalesce('=' || conv_id, ''), strlen(role), role, text))) AS i,
         regexp_extract_all(text, '{_W}') AS ch
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN len(ch) = 0 THEN 1
                 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
                 WHEN ch[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS prev
  FROM placed),
facts AS (
  SELECT conv, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND (prev || ini) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv),
moves(st, k, st2) AS (
  VALUES ('', 0, ''), ('', 1, 'u'), ('', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'),
         ('u', 0, 'u'), ('u', 1, 'a'), ('u', 2, 'u'), ('a', 0, 'a'), ('a', 1, 'u'), ('a', 2, 'a')),
steps(st, letter, ini, st2) AS (
  VALUES ('', 'D', '', ''), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a'), ('', 'K', 's', 's'),
         ('', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'), ('a', 'K', 'u', 'u'), ('', 'R', '', 'u'),
         ('s', 'R', '', 'u'), ('u', 'R', '', 'a'), ('a', 'R', '', 'u')),
walk AS (
  SELECT conv, 0 AS i, '' AS st, '000000000000' AS best FROM facts
  UNION ALL
  SELECT conv, i, st, min(printf('%012d', cost) || audit) AS best FROM (
    SELECT w.conv, f.i, s.st2 AS st,
           substr(w.best, 1, 12)::BIGINT + 5 * m.k + CASE s.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
             + CASE WHEN f.fault = 3 AND s.letter <> 'D' THEN 5 ELSE 0 END AS cost,
           substr(w.best, 13) || repeat('I', m.k) || s.letter AS audit
    FROM walk w JOIN faulty f ON f.conv = w.conv AND f.i = w.i + 1 JOIN moves m ON m.st = w.st JOIN steps s ON s.st = m.st2
    WHERE CASE s.letter WHEN 'D' THEN true WHEN 'K' THEN f.fault IN (0, 3) AND f.ini = s.ini ELSE f.fault IN (0, 3) END)
  GROUP BY conv, i, st),
ends AS (
  SELECT w.conv, min(printf('%012d', substr(w.best, 1, 12)::BIGINT + 5 * m.k) || substr(w.best, 13) || repeat('I', m.k)) AS best
  FROM walk w JOIN facts f ON f.conv = w.conv AND f.n = w.i JOIN moves m ON m.st = w.st WHERE m.st2 IN ('', 'a')
  GROUP BY w.conv),
letters AS (
  SELECT conv, substr(best, 12 + p, 1) AS letter, p,
         count(*) FILTER (substr(best, 12 + p, 1) <> 'I') OVER (PARTITION BY conv ORDER BY p) AS i,
         count(*) FILTER (substr(best, 12 + p, 1) <> 'D') OVER (PARTITION BY conv ORDER BY p) AS o
  FROM ends, range(1, 100000) AS r(p) WHERE p <= length(best) - 12),
repaired AS (
  SELECT l.conv, l.p, l.o, l.letter, CASE WHEN l.letter = 'K' THEN f.role END AS role,
         CASE WHEN l.letter = 'I' THEN '' ELSE f.text END AS text,
         max(CASE WHEN l.letter = 'K' AND l.o = 1 AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv) AS s
  FROM letters l LEFT JOIN faulty f ON f.conv = l.conv AND f.i = l.i WHERE l.letter <> 'D'),
texts AS (
  SELECT conv, string_agg(coalesce(role, CASE WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text,
                          chr(10) ORDER BY p) AS t
  FROM repaired GROUP BY conv)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
       coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
       coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(substr(e.best, 1, 12)::BIGINT, 0) AS cost,
       coalesce(substr(e.best, 13), '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv = f.conv LEFT JOIN texts t ON t.conv = f.conv
"""
