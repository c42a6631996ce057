"""Checking SQL (DuckDB) of operators 4, 6 and 9."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM x GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM x JOIN f USING (g) WHERE doc_id > m),
u AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM u ANTI JOIN h USING (doc_id, i) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
x AS (SELECT doc_id, s, md5(substr(b, 2 * s - 1, 100)) AS g FROM (SELECT doc_id, b, unnest(range(1, length(b) // 2 - 48)) AS s FROM d WHERE length(b) >= 100)),
f AS (SELECT g, min(doc_id) AS m FROM x GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM x JOIN f USING (g) WHERE doc_id > m),
c AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN i = p + 1 THEN 0 ELSE 1 END) AS runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h) GROUP BY doc_id),
u AS (SELECT doc_id, i, substr(b, 2 * i - 1, 2) AS v FROM (SELECT doc_id, b, unnest(range(1, length(b) // 2 + 1)) AS i FROM d SEMI JOIN c USING (doc_id))),
k AS (SELECT doc_id, string_agg(v, '' ORDER BY i) AS t FROM u ANTI JOIN h USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, length(b) // 2 AS n_bytes, coalesce(c.n, 0) AS n_removed, CAST(coalesce(c.runs, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN c.n IS NULL THEN b ELSE coalesce(k.t, '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT v) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS v FROM d) WHERE regexp_matches(v, '[^\x20\x09-\x0D]') GROUP BY doc_id),
x AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS i FROM x JOIN (SELECT doc_id, g FROM x GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS lines,
        len(list_filter(w, lambda v: regexp_matches(v, '\p{{L}}'))) AS lettered, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper, len(regexp_extract_all(t, '\p{{Ll}}')) AS lower
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * lines OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words) OR lettered < 0.5 * n_words OR upper > 0.9 * (upper + lower)) AS kept
FROM b
"""
