"""Query of the source mix and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.mixing import GOLDEN, SPAN, Mix


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sidx FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((sidx - 1) % 3 + 1)::INT] AS weight FROM sources
), shares AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS t, sum(weight) OVER ()::BIGINT AS w,
         coalesce(sum(source_size) OVER below, 0)::BIGINT AS below_size, coalesce(sum(weight) OVER below, 0)::BIGINT AS below_weight
  FROM weighed
  WINDOW below AS (ORDER BY source_size / weight, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fulls AS (
  SELECT *, weight * (3 * t - 4 * below_size)::DOUBLE > 4.0::DOUBLE * source_size * (w - below_weight) AS is_full FROM shares
), even AS (
  SELECT *, coalesce(sum(source_size) FILTER (is_full) OVER (), 0)::BIGINT AS full_size, coalesce(sum(weight) FILTER (is_full) OVER (), 0)::BIGINT AS full_weight FROM fulls
), targets AS (
  SELECT source, sidx, source_size, t, CASE WHEN is_full THEN 2.0::DOUBLE * source_size
         ELSE (weight * (3 * t - 4 * full_size))::DOUBLE / (2 * (w - full_weight))::DOUBLE END AS target
  FROM even
), cut AS (
  SELECT *, greatest(1, least(floor(sqrt(source_size) / 8), floor(target / 64)))::BIGINT AS b FROM targets
), blocked AS (
  SELECT *, ceil(source_size / b)::BIGINT AS blocks FROM cut
), slotted AS (
  SELECT *, CASE WHEN blocks > 0 THEN ceil(target / source_size * blocks)::BIGINT ELSE 0 END AS n FROM blocked
), edges AS (
  SELECT sidx, blocks, n, floor(sum(n) OVER (ORDER BY sidx)::BIGINT::DOUBLE / sum(n) OVER ()::BIGINT::DOUBLE * {float(SPAN)}::DOUBLE)::BIGINT AS hi
  FROM slotted
), ranges AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY sidx), 0) AS lo FROM edges
), slots AS (
  SELECT k, k * {GOLDEN} % {SPAN} AS u FROM unnest(range(0, (SELECT sum(n) FROM edges)::BIGINT)) AS r(k)
), ranked AS (
  SELECT sidx, blocks, row_number() OVER (PARTITION BY sidx ORDER BY k) - 1 AS rank
  FROM slots JOIN ranges ON u >= lo AND u < hi WHERE blocks > 0
), takes AS (
  SELECT sidx, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < 2 * blocks GROUP BY ALL
), placed AS (
  SELECT s.doc_id, s.size, t.sidx, t.source_size, t.target, t.b,
         coalesce(sum(s.size) OVER (PARTITION BY t.sidx ORDER BY md5(coalesce(s.doc_id::VARCHAR, 'null')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN blocked t ON s.source IS NOT DISTINCT FROM t.source
), met AS (
  SELECT p.*, unnest(range(start // b, (start + size - 1) // b + 1)) AS block FROM placed p WHERE size > 0
), used AS (
  SELECT m.sidx, m.start, m.doc_id, sum((least((m.block + 1) * m.b, m.start + m.size) - greatest(m.block * m.b, m.start)) * coalesce(times, 0))::BIGINT AS taken
  FROM met m LEFT JOIN takes USING (sidx, block) GROUP BY ALL
)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size, p.target, coalesce(u.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN used u ON p.size > 0 AND p.sidx = u.sidx AND p.start = u.start AND p.doc_id IS NOT DISTINCT FROM u.doc_id
"""
