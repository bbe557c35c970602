"""DuckDB SQL for the results of operators that SQL can express."""

from __future__ import annotations

from strandline.llm import quality_rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT item, n, width, i AS k, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT item, row_number() OVER () AS n, w, least(10, len(w)) AS width, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)),
hits AS (SELECT doc_id, i, width, item, n, k FROM places JOIN windows USING (width, s)),
chained AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, n, i - k ORDER BY i) AS chain FROM hits),
matches AS (SELECT doc_id, any_value(item) AS item, max(i) - min(i) + any_value(width) AS n_words, min(k) - 1 AS item_word, min(i) - 1 AS doc_word FROM chained GROUP BY doc_id, n, i - k, chain),
longest AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, item, doc_word, item_word) = 1),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS p FROM (SELECT DISTINCT doc_id, i, width FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(l.n_words, 0)::BIGINT AS longest_words, l.item AS longest_item, l.item_word::BIGINT AS longest_item_word, l.doc_word::BIGINT AS longest_doc_word
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest l USING (doc_id)
"""

_RATES = quality_rules.RATES
_CASES = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS rate, {r.sparse} AS sparse, {r.scale} * {r.numerator} // {r.denominator} AS v FROM counted WHERE NOT base_failed" for k, r in _RATES.items())

QUALITY = rf"""
WITH cut AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM cut WHERE len(w) >= 8))),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM windows WHERE n > 1) GROUP BY 1),
measured AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g'))::BIGINT AS n_marks
  FROM cut LEFT JOIN repeats USING (doc_id)),
counted AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
rated AS ({_CASES}),
celled AS (SELECT *, CASE WHEN v < 256 THEN v ELSE (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) END AS cell FROM rated),
pooled AS (SELECT lang, source, rate, cell FROM celled WHERE v > 0 OR NOT sparse),
placed AS (SELECT 0 AS lvl, lang, source, rate, cell FROM pooled UNION ALL SELECT 1, lang, NULL, rate, cell FROM pooled UNION ALL SELECT 2, NULL, NULL, rate, cell FROM pooled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lvl, lang, source, rate ORDER BY cell) AS k, count(*) OVER (PARTITION BY lvl, lang, source, rate) AS n FROM placed),
quart AS (SELECT lvl, lang, source, rate, any_value(n) AS n, min(cell) FILTER (4 * k >= n) AS q1, min(cell) FILTER (4 * k >= 3 * n) AS q3 FROM ranked GROUP BY ALL),
langs AS (SELECT b.lang, a.rate, (coalesce(c.n * c.q1, 0) + 200 * a.q1) // (coalesce(c.n, 0) + 200) AS q1, (coalesce(c.n * c.q3, 0) + 200 * a.q3) // (coalesce(c.n, 0) + 200) AS q3
  FROM quart a JOIN (SELECT DISTINCT lang FROM rated) b ON a.lvl = 2 LEFT JOIN quart c ON c.lvl = 1 AND c.lang = b.lang AND c.rate = a.rate),
sources AS (SELECT b.lang, b.source, a.rate, (coalesce(c.n * c.q1, 0) + 200 * a.q1) // (coalesce(c.n, 0) + 200) AS q1, (coalesce(c.n * c.q3, 0) + 200 * a.q3) // (coalesce(c.n, 0) + 200) AS q3
  FROM langs a JOIN (SELECT DISTINCT lang, source FROM rated) b ON b.lang = a.lang LEFT JOIN quart c ON c.lvl = 0 AND c.lang = b.lang AND c.source = b.source AND c.rate = a.rate),
fence AS (SELECT lang, source, rate, q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high FROM sources),
judged AS (SELECT r.doc_id, bool_and(coalesce(CASE WHEN r.sparse THEN r.v = 0 OR r.cell <= f.high ELSE r.cell BETWEEN f.low AND f.high END, TRUE)) AS inside
  FROM celled r LEFT JOIN fence f ON f.lang = r.lang AND f.source = r.source AND f.rate = r.rate GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN FALSE ELSE inside END AS kept FROM counted LEFT JOIN judged USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""
