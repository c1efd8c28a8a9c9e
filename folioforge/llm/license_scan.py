"""Canonical digest lookup of licences.

A text is brought to a canonical form (case, copyright lines, punctuation and white space, equivalent spellings)
and its SHA-256 looked up among the digests of known licences by a hash join over entire texts. The package's own
known table is a constant of a few dozen rows and is broadcast for that reason; a caller's may have any size, and
Spark decides by its size.

Only DataFrame expressions; the steps are data, from which the SQL of the same form is made too.

Defined cases: a null text is empty; a canonical form without words has no licence; texts of any length are
digested whole; a null name of a known licence finds nothing; repeated rows give repeated results; of known licences with one digest the first name is given;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.license_texts import KNOWN, KNOWN_DIGESTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (pattern, replacement) with {n} for group n, in order; the patterns mean the same in Java's and RE2's syntax.
COPYRIGHT_LINE = r"(\A|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F«»“”‘’–—…•·]+"
PATTERNS = (
    (COPYRIGHT_LINE, "{1}"),
    (PUNCTUATION, " "),
    (r"is(e|ed|er|es|ing|ation|ations)( |\z)", "iz{1}{2}"),
    (r"([a-z])our(s|ed|ing|able|ite|ites)?( |\z)", "{1}or{2}{3}"),
    (r"(lic|off|def)ence", "{1}ense"),
    (r"(acknowled|jud)gement", "{1}gment"),
    (r"(fulfil|enrol)( |\z)", "{1}l{2}"),
)
#: Literal spellings, after the patterns.
SPELLINGS = (
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("programme ", "program "),
    ("centre", "center"),
    ("catalogue", "catalog"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
)


def canonical(text: Column) -> Column:
    form = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, to in PATTERNS:
        form = F.regexp_replace(form, pattern, to.replace("{", "$").replace("}", ""))
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    return F.trim(form)


def digests_of(texts: DataFrame, license_id: str = "license_id", text: str = "text") -> DataFrame:
    """(license_digest, license_id) of a table of known texts, to be given to ``scan_licenses``."""
    return texts.select(F.sha2(canonical(F.col(text)), 256).alias("license_digest"), F.col(license_id).alias("license_id"))


def known_licenses(spark) -> DataFrame:
    """(license_digest, license_id) of the licences that the package knows."""
    short = spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")
    long = spark.createDataFrame([(digest, name) for name, digest in KNOWN_DIGESTS.items()], "license_digest string, license_id string")
    return digests_of(short).unionByName(long)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(key, n_canonical, license_digest, license_id) of every row of ``docs``; ``known``: (license_digest, license_id)."""
    own = known is None
    known = known_licenses(docs.sparkSession) if own else known
    known = known.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))
    form = docs.select(key, canonical(F.col(text)).alias("form"))
    found = form.select(key, F.length("form").cast("long").alias("n_canonical"), F.sha2("form", 256).alias("license_digest"))
    found = found.join(F.broadcast(known) if own else known, "license_digest", "left")
    return found.select(key, "n_canonical", "license_digest", F.when(F.col("n_canonical") > 0, F.col("license_id")).alias("license_id"))
