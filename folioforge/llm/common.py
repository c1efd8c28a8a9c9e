"""What the corpus operators share: table access, the shared scratch folder, iterative components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: While a phase is written, Spark deletes its shuffle files when it ends, not when the driver's garbage is next
#: collected, and a Python worker is sent few bytes at a time, however long the rows.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH: "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset (tests, one machine) a folder below the warehouse is set in its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.corpus-scratch"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpus-{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            drop_path(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


@contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    """Inside, the settings of WRITING hold, for tables written and for results collected."""
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _give_back() -> None:
    """Return what this process has freed to the system: Python workers wait for later tasks, with all that they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with workers that are sent few bytes at a time and give back their memory after each task.

    The result may be written long after this call and by others, so the session keeps the size of batches that WRITING
    has, unless its own is smaller.
    """
    spark = df.sparkSession
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(BATCH)) > size(WRITING[BATCH]):
        spark.conf.set(BATCH, WRITING[BATCH])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def dropped_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, to be deleted when the program ends."""
    atexit.register(_drop_at_exit, spark, path)
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, losing an executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with while_writing(spark):
        df.write.parquet(path)
    dropped_at_exit(spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    again.stash_path = path
    return again


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing lazy still reads."""
    for df in frames:
        drop_path(df.sparkSession, df.stash_path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` (one row a key) dealt by another hash of its key, so that a join on the key deals both sides anew.

    Only such joins are split by AQE where one key is hot; a join in the stage of the grouping is not.
    """
    return df.repartition(F.hash(F.lit("spread"), F.col(key)))


def row_key(*columns: str) -> Column:
    """A key of a row's content; rows with equal content share it."""
    return F.xxhash64(*columns)


def bucket_keys(spark: SparkSession) -> list[int]:
    """An int key for each shuffle partition, such that a repartition by the key deals one key to each partition."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = {r["place"]: r["key"] for r in spark.range(16 * n + 1000).groupBy(place.alias("place")).agg(F.min("id").alias("key")).collect()}
    return [found.get(i, i) for i in range(n)]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges``; component is the smallest id reachable.

    Alternating large-star and small-star steps (a logarithmic number of rounds). Each step is a grouped
    minimum and an equi-join, so a hub's edges are never gathered in a task; each round's edges are a
    written table. A round that changes nothing ends the loop, found by comparing two aggregates.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = stash(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        # large star: neighbours above u move to the smallest id around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(spread(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u's lower neighbours (v) move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(spread(least, "u"), "u")
        small = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(moved.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        after = stash(small, "edges")
        unstash(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return ends.union(roots).groupBy("id").agg(F.min("component").alias("component"))


Query = Callable[[SparkSession, str], DataFrame]
