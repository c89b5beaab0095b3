"""SQL for the queries that SQL can express, over the same tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (
  SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

SOURCE_MIXING = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM docs GROUP BY source),
caps AS (
  SELECT source, source_size, nth, CAST([5, 2, 1][(nth - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM caps WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size, nth, CASE WHEN cap <= l * weight THEN cap ELSE l * weight END AS target
  FROM levels, (SELECT coalesce(arg_min(level, cap / weight), 0) AS l FROM levels WHERE level * weight <= cap)),
spans AS (
  SELECT *, coalesce(lag(high) OVER (ORDER BY nth), 0) AS low, lead(high) OVER (ORDER BY nth) IS NULL AS top
  FROM (SELECT *, sum(target) OVER (ORDER BY nth) / sum(target) OVER () AS high FROM plan WHERE target > 0)),
total AS (SELECT greatest(1024, CAST(ceil(sum(size) / 2048.0) AS BIGINT)) AS slots FROM docs),
points AS (
  SELECT slot, list_sum(list_transform(range(52), lambda k: CAST((slot >> k) & 1 AS DOUBLE) / pow(2, k + 1))) AS u
  FROM (SELECT unnest(range(slots)) AS slot FROM total)),
ranked AS (
  SELECT slot, source, nth, row_number() OVER (PARTITION BY nth ORDER BY slot) - 1 AS rank
  FROM points JOIN spans ON u >= low AND (u < high OR top)),
takes AS (
  SELECT p.*, CAST(floor(target + 0.5) AS BIGINT) AS take, greatest(1, CAST(ceil(floor(target + 0.5) / coalesce(n, 1)) AS BIGINT)) AS block
  FROM plan p LEFT JOIN (SELECT nth, count(*) AS n FROM ranked GROUP BY nth) r ON r.nth = p.nth),
placed AS (
  SELECT row_number() OVER () AS id, doc_id, size, source_size, target, take, block, t.nth,
    CAST(coalesce(sum(size) OVER (PARTITION BY t.nth ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM docs d JOIN takes t ON d.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT id, nth, block, pos + r * source_size AS start, least(pos + r * source_size + size, take) AS stop
  FROM placed, (SELECT unnest([0, 1, 2]) AS r) WHERE pos + r * source_size < least(pos + r * source_size + size, take)),
pieces AS (
  SELECT id, nth, start, stop, block, unnest(range(start // block, (stop - 1) // block + 1)) AS piece FROM parts),
taken AS (
  SELECT id, sum(least(stop, (piece + 1) * block) - greatest(start, piece * block)) AS taken, min(coalesce(slot, (SELECT slots FROM total))) AS first_slot
  FROM pieces p LEFT JOIN ranked r ON r.nth = p.nth AND r.rank = p.piece GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(first_slot, -1) AS BIGINT) AS first_slot
FROM placed LEFT JOIN taken USING (id)
"""
