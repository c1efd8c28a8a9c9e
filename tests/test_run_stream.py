"""Streams of runs: cancelling, restarting, expiry by event time in any batches, and by the clock with a time to live."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioforge.streaming import run_state

START = datetime(2024, 1, 1)
EVENTS = [
    (1, "screening", 0), (1, "recipe", 5), (1, "visual", 6), (1, "visualization", 10), (1, "screening", 20),
    (1, "screening", 75),  # an hour after the end: a new run
    (2, "screening", 1), (2, "cancel", 2), (2, "recipe", 8), (2, "deep_dive", 9),
    (3, "visualization", 3), (3, "start", 30), (3, "screening", 31),  # started anew before it is forgotten
    (4, "cancel", 4), (4, "start", 5), (4, "other", 6),  # asked to stop, never ran
    (5, "deep_dive", 190),
]
WANT = [
    (1, 20, "running", 0), (1, 60, "running", 5), (1, 60, "running", 6), (1, 100, "completed", 10), (1, 100, "expired", 70), (1, 20, "running", 75),
    (2, 20, "running", 1), (2, 20, "cancelled", 8), (2, 20, "expired", 68), (3, 100, "completed", 3), (3, 20, "running", 31), (5, 80, "running", 190),
]


def written(spark, path, name, events):
    rows = [(i, p, START + timedelta(minutes=m)) for i, p, m in events]
    spark.createDataFrame(rows, "paper_id long, phase string, ts timestamp").coalesce(1).write.mode("append").parquet(str(path / name))


@pytest.mark.parametrize("batches", [1, 4])
def test_runs_by_event_time(spark, tmp_path, batches):
    events = sorted(EVENTS, key=lambda e: e[2])
    for b in range(batches):
        written(spark, tmp_path, "in", [e for k, e in enumerate(events) if k * batches // len(events) == b] + [(None, "screening", 0)])
        time.sleep(0.01)
    stream = spark.readStream.schema("paper_id long, phase string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_state.drained(run_state.live_runs(stream, 3600, "30 minutes"), str(tmp_path / "out")).collect()
    assert sorted((r.paper_id, r.progress, r.state, int((r.at - START).total_seconds() // 60)) for r in got) == sorted(WANT)


def test_runs_by_the_clock(spark, tmp_path):
    written(spark, tmp_path, "in", [(1, "visualization", 0), (2, "screening", 0), (3, "cancel", 0)])
    stream = spark.readStream.schema("paper_id long, phase string, ts timestamp").parquet(str(tmp_path / "in"))
    run = run_state.live_runs(stream, 1, None).writeStream.format("memory").queryName("clock").outputMode("append").trigger(processingTime="500 milliseconds").start()

    def shows(want):
        for _ in range(240):
            got = sorted((r.paper_id, r.progress, r.state) for r in spark.table("clock").collect())
            if got == want:
                return True
            time.sleep(0.25)
        return False

    try:
        done = [(1, 100, "completed"), (1, 100, "expired"), (2, 20, "running")]
        assert shows(done)
        time.sleep(1)
        written(spark, tmp_path, "in", [(2, "recipe", 1), (3, "screening", 1)])  # the request of 3 has outlived its time
        assert shows([*done, (2, 60, "running"), (3, 20, "running")])
    finally:
        run.stop()


def test_seconds_are_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    micros = [b + d for b in (0, 1706086162_000000, -5_000000) for d in (0, 1, 499_999, 999_499, 999_500, 999_999, -1, -499, -500, -501, -1_499, -1_500)]
    got = spark.createDataFrame([(m,) for m in micros], "m long").select("m", run_state.shown_second(F.timestamp_micros("m")).alias("s")).collect()
    want = duckdb.connect().execute("SELECT m, epoch_ms(make_timestamp(m)) // 1000 FROM (SELECT unnest(?::BIGINT[]) AS m)", [micros]).fetchall()
    assert sorted((r.m, r.s) for r in got) == sorted(want)
