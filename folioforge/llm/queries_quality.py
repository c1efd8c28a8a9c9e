"""Query of the quality rules and its SQL, expectation-maximisation included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.quality import ALARMS, BASE_FAILED, GOOD, HITS, PRIOR, ROUNDS, RULES, STOP_WORDS, judge


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measures_sql(source: str = "documents") -> str:
    stops = ", ".join(f"'{x}'" for x in " ".join(STOP_WORDS).split())
    return rf"""
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
split_up AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM texts
),
windows AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split_up WHERE len(w) >= 3)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, coalesce(c.n, 0) AS n_repeat_words,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stops
  FROM split_up s LEFT JOIN covered c USING (doc_id)
)"""


def verdict_sql() -> str:
    """CTEs from measured to judged (measured columns, base_failed, kept)."""
    names = [name for name, _, _ in RULES]
    parts = [
        "voted AS (SELECT *, " + ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END AS {name}" for name, bad, good in RULES) + f", ({BASE_FAILED}) AS base_failed FROM measured)",
        f"patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL)",
        f"p0 AS (SELECT {', '.join(f'{ALARMS}::DOUBLE AS a{j}, {HITS}::DOUBLE AS h{j}' for j in range(len(names)))}, {GOOD}::DOUBLE AS good)",
    ]
    odds = "ln(good / (1 - good))" + "".join(f" + CASE {name} WHEN 1 THEN ln((1 - a{j}) / (1 - h{j})) WHEN 0 THEN ln(a{j} / h{j}) ELSE 0 END" for j, name in enumerate(names))
    of = lambda name, least, w: f"coalesce(sum(n * {w}) FILTER ({name} >= 0 AND {name} <= {least}), 0)"
    for k in range(ROUNDS):
        fits = ", ".join(
            f"({of(name, 0, 'p')} + {PRIOR * ALARMS}::DOUBLE) / ({of(name, 1, 'p')} + {PRIOR}) AS a{j}, "
            f"({of(name, 0, '(1 - p)')} + {PRIOR * HITS}::DOUBLE) / ({of(name, 1, '(1 - p)')} + {PRIOR}) AS h{j}"
            for j, name in enumerate(names)
        )
        parts.append(f"e{k} AS MATERIALIZED (SELECT q.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns q, p{k})")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT {fits}, (coalesce(sum(n * p), 0) + {PRIOR * GOOD}::DOUBLE) / (coalesce(sum(n), 0) + {PRIOR}) AS good FROM e{k})")
    parts.append(f"judged AS (SELECT v.*, NOT base_failed AND ({odds}) >= 0 AS kept FROM voted v, p{ROUNDS})")
    return ",\n".join(parts)


OP6_SQL = f"""WITH {measures_sql()},
{verdict_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""
