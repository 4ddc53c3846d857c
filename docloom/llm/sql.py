"""DuckDB SQL for the rows of the operators that SQL can express, by plain joins over words and windows."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SOLID = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

#: r numbers the rows, so that rows with equal ids stay apart.
WORDS = "SELECT row_number() OVER () AS r, *, regexp_extract_all({text}, '{word}') AS w FROM documents"


def windows(size: int | str) -> str:
    """List of the windows of the words ``w``, as texts."""
    return f"[array_to_string(w[i:i + {size} - 1], ' ') FOR i IN range(1, len(w) - {size} + 2)]"


LINE_RULES = f"""
WITH d AS (
  SELECT *, string_split(body, chr(10)) AS all_lines, regexp_extract_all(body, '{SOLID}') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body FROM documents)
), lines AS (
  SELECT r, doc_id, source, body, line, lower(trim(line, {BLANKS})) AS normal
  FROM (SELECT r, doc_id, source, body, unnest(all_lines) AS line FROM d) WHERE regexp_matches(line, '{SOLID}')
), repeated_lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), hosts AS (
  SELECT source, count(*) AS documents FROM d GROUP BY source
), spread AS (
  SELECT source, normal, count(DISTINCT (doc_id, body)) AS found FROM lines GROUP BY source, normal
), boilerplate AS (
  SELECT s.source, s.normal FROM spread s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source
  WHERE s.found > 5 AND s.found > 0.001::DOUBLE * h.documents
), removed AS (
  SELECT r, sum(length(line))::BIGINT AS chars FROM lines l
  JOIN boilerplate b ON l.normal = b.normal AND l.source IS NOT DISTINCT FROM b.source GROUP BY r
), runs AS (
  SELECT r, unnest(x) AS run, generate_subscripts(x, 1) AS start FROM (SELECT r, {windows(8)} AS x FROM d)
), twice AS (
  SELECT r, start FROM (SELECT *, count(*) OVER (PARTITION BY r, run) AS times FROM runs) WHERE times > 1
), covered AS (
  SELECT r, count(DISTINCT start + o) AS n FROM twice, range(8) AS t(o) GROUP BY r
), facts AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, length(body)::BIGINT AS n_chars,
    coalesce(repeated_lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(removed.chars, 0)::BIGINT AS removed_chars
  FROM d LEFT JOIN repeated_lines USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_chars,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND n_chars - removed_chars >= 0.3::DOUBLE * n_chars) AS kept
FROM facts
"""

ARCHIVES = """
WITH p AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest
  FROM (SELECT page_id, coalesce(html, '') AS body FROM pages)
), o AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > original THEN original END AS refers_to
FROM o
"""

PASSAGES = f"""
WITH d AS (
  {WORDS.format(text=LOWERED, word=LETTERS)}
), b AS (
  SELECT item_id, w, least(13, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all({LOWERED}, '{LETTERS}') AS w FROM benchmark)
  WHERE len(w) > 0 AND item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, n, unnest({windows("n")}) AS run FROM b
), g AS (
  SELECT r, n, unnest(x) AS run, generate_subscripts(x, 1) AS start
  FROM (SELECT r, n, {windows("n")} AS x FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
), found AS (
  SELECT r, n, start, item_id FROM g JOIN p USING (n, run)
), hit AS (
  SELECT r, count(DISTINCT start + o) AS n_hit FROM found, range(13) AS t(o) WHERE o < n GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

REPEATS = f"""
WITH d AS (
  {WORDS.format(text="coalesce(text, '')", word=SOLID)}
), g AS (
  SELECT r, doc_id, unnest(x) AS run, generate_subscripts(x, 1) AS start FROM (SELECT r, doc_id, {windows(13)} AS x FROM d)
), later AS (
  SELECT r, start FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS least FROM g) WHERE doc_id > least
), covered AS (
  SELECT DISTINCT r, start + o AS place FROM later, range(13) AS t(o)
), each AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words FROM each ANTI JOIN covered USING (r, place) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Equal sets are one class; overlaps are counted for classes that share a shingle.
LINKED = f"""
WITH RECURSIVE d AS (
  {WORDS.format(text=LOWERED, word=SOLID)}
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct({windows(4)})) END AS grams
  FROM d
), named AS (
  SELECT r, doc_id, len(grams) AS n, CASE WHEN len(grams) > 0 THEN sha256(array_to_string(grams, chr(10))) END AS class FROM s
), classes AS (
  SELECT class, min(n) AS n, min(doc_id) AS least FROM named WHERE class IS NOT NULL GROUP BY class
), member AS (
  SELECT class, unnest(grams) AS gram FROM (
    SELECT class, any_value(grams) AS grams FROM named JOIN s USING (r) WHERE class IS NOT NULL GROUP BY class)
), overlap AS (
  SELECT a.class AS x, b.class AS y, count(*) AS n FROM member a JOIN member b ON a.gram = b.gram AND a.class <> b.class
  GROUP BY a.class, b.class
), link AS (
  SELECT x, y FROM overlap o JOIN classes a ON o.x = a.class JOIN classes b ON o.y = b.class
  WHERE 100 * o.n >= 85 * (a.n + b.n - o.n)
), reach AS (
  SELECT class AS x, class AS y FROM classes
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), component AS (
  SELECT reach.x AS class, min(least) AS component_id FROM reach JOIN classes ON reach.y = classes.class GROUP BY reach.x
)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN class IS NULL THEN doc_id ELSE component_id END AS component_id
FROM named LEFT JOIN component USING (class)
"""

HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
