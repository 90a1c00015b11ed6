"""DuckDB SQL for the queries whose rows SQL can express at whole-table speed."""

#: Exact top 20 by integer inner product.
TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Words of every document, numbered from 1.
WORDS = r"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)"""

#: Base metrics and the line rules.
LINE_RULES = f"""
WITH {WORDS},
x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x) WHERE n > 1),
z AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM y, range(3) r(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
f AS (SELECT doc_id, x, regexp_matches(x, '[^\\x20\\x09-\\x0D]') AS full_line,
  len(regexp_extract_all(x, '[|»›·•>]\\s*[^\\s|»›·•>]')) >= 2
  OR regexp_matches(x, '(?i)(lorem ipsum|javascript|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign (in|up)\\b|log ?in\\b|subscribe to|datenschutzerkl|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|politique de confidentialit|tous droits r|cliquez ici|pol.tica de privacidad|todos los derechos reservados|haga clic)')
  OR len(regexp_extract_all(x, '[#*$%&|<>!]')) > 0.1 * length(x)
  OR (length(x) >= 72 AND length(regexp_replace(x, '[^\\p{{Lu}}]+', '', 'g')) > 0.5 * length(regexp_replace(x, '[^\\p{{L}}]+', '', 'g')))
  OR (length(x) >= 72 AND NOT regexp_matches(x, '[.!?…。？！]')) AS fails FROM l),
g AS (SELECT doc_id, count(*) FILTER (full_line) - count(DISTINCT x) FILTER (full_line) AS n_dup_lines,
  coalesce(sum(length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (NOT (full_line AND fails)), 0) AS remaining FROM f GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(z.n, 0)::BIGINT AS n_repeat_words, remaining
  FROM w JOIN g USING (doc_id) LEFT JOIN z USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN word_chars = 0 THEN 0 ELSE 1.0 - remaining::DOUBLE / word_chars END <= 0.5 AS kept FROM b
"""

#: Windows of 35 words that start at two places or more, and the words left.
PASSAGES = f"""
WITH {WORDS},
x AS (SELECT doc_id, j, w[j] AS word, CASE WHEN j + 34 <= len(w) THEN array_to_string(w[j : j + 34], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM w)),
y AS (SELECT doc_id, j, word, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS hit FROM x),
z AS (SELECT doc_id, j, word, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS 34 PRECEDING) AS gone FROM y)
SELECT d.doc_id, count(z.j) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id
"""

ORACLES = {"op3_voronoi_topk": TOP_K, "op5_line_rules": LINE_RULES, "op8_substring_dedup": PASSAGES}
