"""The sink of files: read back, nothing left of a failed write, overwriting, names that are none."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from folioforge.sources import text_files


def written(df, path, mode="append"):
    text_files.register(df.sparkSession)
    df.write.format("text_files").option("path", path).mode(mode).save()


def files_of(path):
    time.sleep(1)  # tasks that were running when another failed
    return {os.path.relpath(f, path): open(f, encoding="utf-8").read() for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f)}


def test_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a/analysis.md", "é\n"), ("a/recipe_card.md", None), ("b.md", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file string, content string, other int").repartition(3)
    written(df, path)
    assert files_of(path) == {name: text or "" for name, text in rows}
    assert not os.path.exists(f"{path}/_staging")
    written(spark.createDataFrame([("c/d.md", "new")], "file string, content string"), path)
    assert set(files_of(path)) == {"a/analysis.md", "a/recipe_card.md", "b.md", "c/d.md"}
    written(spark.createDataFrame([("c/d.md", "last")], "file string, content string"), path, "overwrite")
    assert files_of(path) == {"c/d.md": "last"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(40).repartition(4).select(F.concat(F.lit("p/"), F.col("id").cast("string")).alias("file"), F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise("text").alias("content"))
    with pytest.raises(Exception, match="broken"):
        written(df, path)
    assert files_of(path) == {}
    for bad in ("../up.md", "/etc/x", "", None):
        with pytest.raises(Exception, match="no file name"):
            written(spark.createDataFrame([("fine", "x"), (bad, "x")], "file string, content string"), path)
    with pytest.raises(Exception, match="one file name"):
        written(spark.createDataFrame([("a", "x"), ("./a", "y")], "file string, content string"), path)
    assert files_of(path) == {}


def test_written_reports_show_costs_as_their_sql(spark, tmp_path):
    """Files of papers whose costs lie half-way between two texts, and of one whose cost does not."""
    duckdb = pytest.importorskip("duckdb")
    from folioforge.plans import registry

    con = duckdb.connect()
    for name, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '/root/testdata/sf0.1/{name}.parquet' WHERE {key} IN (7, 1024, 3872, 9193)")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = registry.queries()["snk01_written_reports"](spark, str(tmp_path)).collect()
    want = con.execute("SELECT file, digest FROM (" + registry.oracles()["snk01_written_reports"] + ")").fetchall()
    assert sorted((r.file, r.digest) for r in got) == sorted(want)
