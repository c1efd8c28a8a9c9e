"""Query of the spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.errata_trie import spelling_variants


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: The checksum is computed by its table, and near words are found through their texts with one character less.
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT k, k AS c, 0 AS step FROM range(256) AS r(k) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c::UBIGINT ORDER BY k) AS sums FROM bits WHERE step = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY ALL),
octets AS (SELECT w, n, [('0x' || x)::UBIGINT FOR x IN regexp_extract_all(hex(encode(id || ':' || w)), '..')] AS b FROM lowered),
hashed AS (SELECT w, n, xor(list_reduce([4294967295::UBIGINT] || b, lambda c, x: xor(c >> 8, sums[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h FROM octets, crc),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
links AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.short = b.word
),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM links GROUP BY 1),
best AS (SELECT word, n_near, best_n, min(other) AS other FROM links JOIN near USING (word) WHERE other_n = best_n GROUP BY ALL),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN other END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.next)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM steps WHERE next IS NULL) USING (word)
"""
