"""The filter audit against its SQL, against all orders applied one by one, and its defined cases."""

from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from folioforge.llm.filter_audit import audit_filters, swaps, walk
from folioforge.llm.queries_audit import OP13_SQL

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def test_swaps_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for i in swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_walk_against_each_order():
    cells = np.random.default_rng(2).integers(0, 9, (3, 16, 2))
    orders, removed, shapley = walk(cells, 4)
    assert sorted(orders) == sorted(permutations(range(4)))
    for o, steps in zip(orders, removed):
        left = cells.copy()
        for step, f in enumerate(o):
            gone = [m for m in range(16) if m >> f & 1]
            assert (steps[:, step] == left[:, gone].sum(1)).all()
            left[:, gone] = 0
    assert (shapley.sum(1) == 24 * cells[:, 1:, 0].sum(1)).all()


def checked(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], DOCS + ", n int, mask string")
    got = audit_filters(docs.repartition(3), spark.createDataFrame([(*x, 1) for x in labels], LABELS + ", good int")).select(*COLUMNS).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    cursor = con.execute(OP13_SQL)
    at = [[d[0] for d in cursor.description].index(c) for c in COLUMNS]
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in at) for r in cursor.fetchall())
    return {(r.part, r.filter_order, r.step): r for r in got}


def test_defined_cases(spark):
    varied = " ".join(f"w{i}" for i in range(150))
    texts = ["", None, "short", varied, varied, "same " * 120, "SHOUT " * 5, "a|b", varied + " 50%", varied + " x\u0085y", "é" * 20_000, "x\x0by\x0cz"]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(3, varied, "en"), (3, "another", "fr"), (None, varied, "en"), (None, "alone", "en"), (None, "alone", "en"), (50, "alone", "de"), (-4, varied, "de")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, None)]
    got = checked(spark, rows, labels)
    assert len(got) == 4 * 120 * 5 and {k[0] for k in got} == {"", "en", "de", "fr"}
    assert got["de", "EABCD", 1].removed == 1 and got["en", "EABCD", 1].removed == 5


def test_no_documents(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit_filters(spark.createDataFrame([], DOCS), labels).count() == 0
    one = audit_filters(spark.createDataFrame([(1, "x", None)], DOCS), labels)
    assert one.where("part = '' AND removed > 0").agg(F.count("*"), F.sum("removed")).first() == (120, 120)
