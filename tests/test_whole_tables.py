"""Queries of model calls answer every row of their table, once."""

import pytest

from folioforge.plans import registry
from folioforge.plans.library import papers
from folioforge.session import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, key", [("udf01_phase_calls", "paper_id"), ("udf03_model_fallback", "paper_id"), ("udf08_cached_explanations", "id")])
def test_every_row(spark, name, key):
    rows = table(spark, SF, "part").select("p_partkey") if key == "id" else papers(spark, SF).select("id")
    got = registry.queries()[name](spark, SF)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in rows.collect())
    if name == "udf03_model_fallback":
        assert all(r.failed == (r.paper_id % 5 == 0) for r in got.collect())
    if name == "udf08_cached_explanations":
        assert all(r.source == ("cached" if r.id % 2 == 0 else "model") for r in got.collect())
