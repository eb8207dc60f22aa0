"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per),
ordered AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source ASC NULLS LAST) AS k FROM weighed),
-- pour the total by weight; cap the source of least size per weight while its cap is below the level
fill AS (
  SELECT 0 AS k, (SELECT SUM(source_size) FROM per) AS words, (SELECT SUM(weight) FROM weighed) AS share
  UNION ALL
  SELECT o.k, f.words - 3 * o.source_size, f.share - o.weight FROM fill f JOIN ordered o ON o.k = f.k + 1
  WHERE CAST(f.words AS DOUBLE) / f.share * o.weight > 3 * o.source_size),
capped AS (SELECT k, CAST(words AS DOUBLE) / NULLIF(share, 0) AS level FROM fill ORDER BY k DESC LIMIT 1),
goal AS (
  SELECT source, source_size, CASE WHEN o.k <= c.k THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target
  FROM ordered o, capped c),
need AS (SELECT *, COALESCE(floor(target / NULLIF(source_size, 0)), 0) AS base FROM goal),
grouped AS (SELECT source, h, SUM(size) AS words FROM d GROUP BY source, h),
running AS (SELECT source, h, words, SUM(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM grouped)
SELECT d.doc_id, d.size, n.source_size, n.target,
       CAST(d.size * (n.base + CASE WHEN r.upto + r.upto - r.words <= 2 * (n.target - n.base * n.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN need n ON d.source IS NOT DISTINCT FROM n.source JOIN running r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h
"""

ORACLE["op5_exact_topk"] = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(p.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id AND len(q.v) = len(p.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

WORDS = r"[^\x20\x09-\x0D]+"

ORACLE["op2_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM w, unnest(range(1, len(ws) - 33)) t(i)),
again AS (SELECT k FROM win GROUP BY k HAVING COUNT(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN again USING (k), unnest(range(35)) t(j)),
word AS (SELECT doc_id, pos, ws[pos] AS word FROM w, unnest(range(1, len(ws) + 1)) t(pos)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, COUNT(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op7_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, CASE WHEN COALESCE(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (
  SELECT doc_id, k AS line, ls[k] AS txt, list_sort(list_distinct(regexp_extract_all(ls[k], '{WORDS}'))) AS ws,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, k) AS place
  FROM d, unnest(range(1, len(ls) + 1)) t(k)),
c AS (SELECT ws, len(ws) AS n, MIN(place) AS first FROM l WHERE len(ws) > 0 GROUP BY ws),
tok AS (SELECT first, n, unnest(ws) AS w FROM c),
df AS (SELECT w, COUNT(*) AS d FROM tok GROUP BY w),
pre AS (
  SELECT first, n, w FROM tok JOIN df USING (w)
  QUALIFY row_number() OVER (PARTITION BY first ORDER BY d, w) <= n - (n * 80 + 99) // 100 + 1),
cand AS (
  SELECT DISTINCT x.first AS a, y.first AS b FROM pre x JOIN pre y
  ON x.w = y.w AND x.first < y.first AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
late AS (
  SELECT DISTINCT b FROM (
    SELECT b, ca.n AS na, cb.n AS nb, len(list_intersect(ca.ws, cb.ws)) AS common
    FROM cand JOIN c ca ON ca.first = a JOIN c cb ON cb.first = b)
  WHERE 100 * common >= 80 * (na + nb - common)),
kept AS (
  SELECT doc_id, COUNT(*) AS n, string_agg(txt, chr(10) ORDER BY line) AS text
  FROM l LEFT JOIN c USING (ws)
  WHERE len(ws) = 0 OR (place = first AND place NOT IN (SELECT b FROM late)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - COALESCE(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE["op8_minmax_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(ws) >= 4 THEN ws[i:i + 3] ELSE ws END, ' ')) AS h
  FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (
  SELECT doc_id AS start, doc_id AS node FROM w
  UNION
  SELECT start, b FROM reach JOIN links ON node = a),
least AS (SELECT start AS doc_id, MIN(node) AS component_id FROM reach GROUP BY start)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLE["op12_filter_audit"] = rf"""
WITH w AS (
  SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '{WORDS}') AS ws FROM documents),
least AS (SELECT t, MIN(doc_id) AS first FROM w GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, COALESCE(good, FALSE) AS good, COALESCE(toxic, FALSE) AS toxic,
         CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS x, filter_order[:k - 1] AS before FROM orders, range(1, 6) t(k)),
c AS (
  SELECT part, fails, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
-- whether a filter of the first steps has removed it: a letter of both
r AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS bad,
         len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
  FROM c, steps),
s AS (
  SELECT part, filter_order, step, x, SUM(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept,
         SUM(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed, SUM(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant,
         SUM(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails, SUM(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost,
         SUM(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(SUM(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM s
"""

ORACLE["op11_conversation_repair"] = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
-- CRC-32 of the key, a bit at a time
crc AS (
  SELECT key, 0 AS done, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT key FROM raw)
  UNION ALL
  SELECT key, done + 1, CASE WHEN c0 % 2 = 1 THEN xor(c0 // 2, 3988292384) ELSE c0 // 2 END
  FROM (SELECT key, done, CASE WHEN done % 8 = 0 THEN xor(c, CAST(ascii(key[done // 8 + 1]) AS BIGINT)) ELSE c END AS c0 FROM crc WHERE done < 8 * length(key))),
hashed AS (SELECT key, xor(c, 4294967295) % 20 AS fault FROM crc WHERE done = 8 * length(key)),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw JOIN hashed USING (key) WHERE fault <> 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1] AS initial,
         regexp_replace(text, '[ 	-
]+$', '') AS trimmed
  FROM d),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM p),
rows AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN regexp_matches(trimmed[-1], '[.!?]') THEN '' ELSE 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM told),
report AS (
  SELECT conv_id, COUNT(*) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank,
         COUNT(*) FILTER (fault = 'duplicate') AS duplicate, COUNT(*) FILTER (fault = 'truncated') AS truncated,
         COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id),
moves(q, x, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
word(x, role) AS (VALUES ('u', 'user'), ('a', 'assistant')),
inserts AS (
  SELECT q, q AS r, 0 AS k, CAST([] AS VARCHAR[]) AS lines FROM (VALUES (0), (1), (2), (3)) t(q)
  UNION ALL
  SELECT i.q, m.r, k + 1, list_append(lines, word.role || ':') FROM inserts i JOIN moves m ON m.q = i.r JOIN word ON word.x = m.x WHERE k < 3),
edits AS (
  SELECT q, x, r, 'K' AS letter, 0 AS cost FROM moves
  UNION ALL SELECT q, x, r, 'R', 3 FROM moves WHERE x IN ('u', 'a')
  UNION ALL SELECT q, '', q, 'D', 4 FROM (VALUES (0), (1), (2), (3)) t(q)),
-- from the last row to the first: the cheapest way to an accepted end from each state, inserts before each row included
best AS (
  SELECT conv_id, n AS i, q, cost, audit, lines FROM (
    SELECT conv_id, n, i.q, 3 * k AS cost, repeat('I', k) AS audit, lines,
           row_number() OVER (PARTITION BY conv_id, i.q ORDER BY k) AS place
    FROM report, inserts i WHERE i.r IN (0, 3)) WHERE place = 1
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT b.conv_id, b.i - 1 AS i, n.q, 3 * n.k + e.cost + CASE WHEN w.fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END + b.cost AS cost,
           repeat('I', n.k) || letter || b.audit AS audit,
           list_concat(n.lines, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [w.role || ':' || w.text] ELSE [word.role || ':' || w.text] END, b.lines) AS lines,
           row_number() OVER (PARTITION BY b.conv_id, n.q ORDER BY 3 * n.k + e.cost + CASE WHEN w.fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END + b.cost,
                              repeat('I', n.k) || letter || b.audit) AS place
    FROM best b JOIN rows w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i
    JOIN edits e ON e.r = b.q AND (letter <> 'K' OR e.x = w.initial) AND (letter = 'D' OR w.fault NOT IN ('blank', 'duplicate'))
    JOIN inserts n ON n.r = e.q LEFT JOIN word ON word.x = e.x) WHERE place = 1),
done AS (SELECT conv_id, cost, audit, array_to_string(lines, chr(10)) AS repaired FROM best WHERE i = 0 AND q = 0)
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, CAST(COALESCE(cost, 0) AS BIGINT) AS cost, COALESCE(audit, '') AS audit, sha256(COALESCE(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN report r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""
