"""Session construction and table access shared by the queries, the bench and the tests."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with the engine's defaults; a cluster passes its own session instead."""
    builder = SparkSession.builder.master(master).appName("folioforge")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory}
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set at ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` as a stream of its files. As a pattern, the path may be that of one file."""
    source = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[t]")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            drop_path(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def dropped_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, to be deleted when the program ends."""
    atexit.register(_drop_at_exit, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read back: its lineage ends there."""
    path = dropped_at_exit(df.sparkSession, shared_path(df.sparkSession, label))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
