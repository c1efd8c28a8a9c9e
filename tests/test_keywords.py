"""Keywords by automaton against a search for each, and the domains' hints."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import hints
from folioforge.functions.keywords import found_keywords, keyword_counts


def test_counts(spark):
    rng = random.Random(4)
    groups = {"x": ["ab", "abc", "DNA", "b c", "é"], "y": ["abc", "ca", "RNA"], "none": []}
    texts = ["".join(rng.choices("abcDNARé ", k=40)) for _ in range(200)] + [None, "", "ABC dna DNARNA É"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    held = lambda k, t: k in t if k.isupper() else k in t.lower()
    got = [r[0] for r in df.select(keyword_counts(groups)(F.col("t"))).collect()]
    assert got == [[sum(held(k, t or "") for k in words) for words in groups.values()] for t in texts]
    found = [r[0] for r in df.select(found_keywords(groups["x"])(F.col("t"))).collect()]
    assert found == [[i for i, k in enumerate(groups["x"]) if k in (t or "").lower()] for t in texts]
    assert df.select(found_keywords([])(F.col("t")).alias("f")).where("size(f) > 0").count() == 0


def test_hints(spark):
    got = {r.d: r.h for r in spark.createDataFrame([("photonics",), ("qubit",), ("other",), (None,)], "d string").select("d", hints.domain_hint(F.col("d")).alias("h")).collect()}
    assert got["photonics"].startswith("DOMAIN-SPECIFIC PARAMETERS (Optics/Photonics)") and "Rabi_frequency (MHz)" in got["qubit"]
    assert got["other"] == got[None] == hints.ANY_HINT
    assert hints.parameter_words("a_b (x, y), C_d")  == {"a b": "a_b", "c d": "C_d"}


@pytest.mark.parametrize("domain, want", [("optics", ["wavelength", "resolution"]), ("bio", ["resolution"]), ("other", []), (None, [])])
def test_mentioned(spark, domain, want):
    df = spark.createDataFrame([("The Resolution at a WAVELENGTH, with qubit type", domain)], "text string, domain string")
    assert hints.mentioned_parameters(df).first().parameters == want
