"""Changes to stored tables: counts, rows, and files that stay as they are."""

import glob

from pyspark.sql import functions as F

from folioforge.sources.tables import StoredTable

SCHEMA = "id long, status string, n int"


def test_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    table = StoredTable(spark, path, buckets=16)
    rows = {i: (i, "new" if i % 3 else None, i % 5) for i in range(200)}
    table.create(spark.createDataFrame([*rows.values(), (None, "none", 0)], SCHEMA))
    files = lambda: set(glob.glob(f"{path}/_bucket=*/*.parquet"))
    buckets = lambda names: {f.split("_bucket=")[1].split("/")[0] for f in names}
    stored = lambda: {r.id: tuple(r) for r in table.rows().select("id", "status", "n").collect()}

    before = files()
    assert table.update(F.col("id") == 7, status=F.lit("done"), n=F.col("n") + 10) == 1
    assert len(buckets(before - files())) == 1 and len(before & files()) >= len(before) - 1
    rows[7] = (7, "done", 12)
    assert stored() == {**rows, None: (None, "none", 0)}

    before = files()
    assert table.update(F.col("status") == "nothing", n=F.lit(1)) == 0 == table.delete(F.col("n") > 99) and files() == before
    assert table.update(F.col("status") == "new", status=F.lit("seen")) == sum(r[1] == "new" for r in rows.values())
    rows = {i: (i, "seen" if r[1] == "new" else r[1], r[2]) for i, r in rows.items()}
    assert stored() == {**rows, None: (None, "none", 0)}

    assert table.delete(F.col("id").isNull()) == 1
    assert table.upsert(spark.createDataFrame([(1, "up", 1), (999, "up", 2), (None, "up", 3)], SCHEMA)) == (1, 2)
    rows |= {1: (1, "up", 1), 999: (999, "up", 2), None: (None, "up", 3)}
    assert stored() == rows
    assert table.insert(spark.createDataFrame([(1000, "in", 0)], SCHEMA)) == 1
    assert table.delete(F.lit(True)) == 203
    assert not files()
