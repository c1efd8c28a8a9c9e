"""Query of the licence lookup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.license_scan import LOWER, PATTERNS, SPELLINGS, UPPER, scan_licenses
from folioforge.llm.license_texts import KNOWN, KNOWN_DIGESTS


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    form = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, to in PATTERNS:
        form = f"regexp_replace({form}, {_quoted(pattern)}, {_quoted(to.replace('{', chr(92)).replace('}', ''))}, 'g')"
    for old, new in SPELLINGS:
        form = f"replace({form}, {_quoted(old)}, {_quoted(new)})"
    return f"trim({form}, ' ')"


OP8_SQL = f"""
WITH known_texts (license_id, known_text) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in KNOWN.items())}),
known_digests (license_id, license_digest) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in KNOWN_DIGESTS.items())}),
known AS (
  SELECT license_digest, min(license_id) AS license_id
  FROM (SELECT sha256({canonical_sql('known_text')}) AS license_digest, license_id FROM known_texts UNION ALL SELECT license_digest, license_id FROM known_digests)
  GROUP BY 1
),
forms AS (SELECT doc_id, {canonical_sql('text')} AS form FROM documents),
found AS (SELECT doc_id, length(form) AS n_canonical, sha256(form) AS license_digest FROM forms)
SELECT doc_id, n_canonical, license_digest, CASE WHEN n_canonical > 0 THEN license_id END AS license_id
FROM found LEFT JOIN known USING (license_digest)
"""
