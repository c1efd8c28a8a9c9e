"""Query of the perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.perspectives import rotate_perspectives


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, role IS NULL AS anonymous,
         replace(replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') AS content,
         replace(replace(regexp_replace(coalesce(role, 'unknown'), '[\r\n]+', ' ', 'g'), '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') AS shown
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE NOT anonymous AND speaker <> 'system'
), views AS (
  SELECT s.*, p.perspective, NOT anonymous AND speaker = perspective AS own, NOT anonymous AND speaker = 'system' AS rules
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, CASE WHEN own THEN '<|assistant|>' WHEN rules THEN '<|system|>' ELSE '<|user name=' || shown || '|>' END || chr(10) AS head
  FROM views
)
SELECT conv_id, perspective, turn,
       CASE WHEN own THEN 'assistant' WHEN rules THEN 'system' ELSE 'user' END AS chat_role,
       CASE WHEN NOT own AND NOT rules THEN speaker END AS name,
       head || content || '<|end|>' || chr(10) AS rendered,
       CASE WHEN own THEN length(head) ELSE 0 END AS mask_start,
       CASE WHEN own THEN length(head) + length(content) + 7 ELSE 0 END AS mask_end,
       own AS trained
FROM headed
"""
