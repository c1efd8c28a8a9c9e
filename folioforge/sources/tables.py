"""Tables as folders of Parquet, changed in place with the number of rows that a change touches.

Rows lie in buckets by a hash of their key. A change finds the buckets that it touches (a scan of the columns of its
condition), rewrites these from themselves by dynamic partition overwrite, and counts what it changes in one of these
passes; files of other buckets stay as they are. A bucket that is left without rows is deleted. Spark replaces buckets
one after the other when the write commits: one writer at a time, and readers that must not see a change in part take
a path of their own.

Defined cases: a condition that is null for a row does not touch it; a null key lies in a bucket like any other and
equals no key of an upsert; a change that touches nothing writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioforge.session import drop_path

BUCKETS = 64
BUCKET = "_bucket"


class StoredTable:
    """The table at ``path``, with the key column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Rows with their buckets; ``overwrite`` replaces the buckets that have rows."""
        dealt = rows.repartition(BUCKET) if mode == "overwrite" else rows.repartition(self.buckets, BUCKET)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(self._bucketed(rows), "errorifexists")

    def rows(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def insert(self, rows: DataFrame) -> int:
        """Appends; the number of rows."""
        seen = Observation()
        self._write(self._bucketed(rows.select(self.rows().columns)).observe(seen, F.count("*").alias("n")), "append")
        return seen.get["n"]

    def _touched(self, condition: Column) -> list[int]:
        return [r[0] for r in self._stored().where(condition).select(BUCKET).distinct().collect()]  # at most one a bucket

    def update(self, condition: Column, **new: Column) -> int:
        """New values for the rows of the condition; how many they are."""
        touched = self._touched(condition)
        if not touched:
            return 0
        hit, seen = F.coalesce(condition, F.lit(False)), Observation()
        stored = self._stored()
        kinds = {f.name: f.dataType for f in stored.schema}
        rows = stored.where(F.col(BUCKET).isin(touched)).withColumn("_hit", hit)
        rows = rows.withColumns({c: F.when(F.col("_hit"), v.cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items()})
        self._write(rows.observe(seen, F.count_if("_hit").alias("n")).drop("_hit"), "overwrite")
        return seen.get["n"]

    def delete(self, condition: Column) -> int:
        """Removes the rows of the condition; how many they are."""
        hit = F.coalesce(condition, F.lit(False))
        counts = self._stored().groupBy(BUCKET).agg(F.count_if(hit).alias("n"), F.count_if(~hit).alias("left")).where("n > 0").collect()  # at most one a bucket
        kept = [r[BUCKET] for r in counts if r["left"]]
        if kept:
            self._write(self._stored().where(F.col(BUCKET).isin(kept)).where(~hit), "overwrite")
        for r in counts:
            if not r["left"]:
                drop_path(self.spark, f"{self.path}/{BUCKET}={r[BUCKET]}")
        return sum(r["n"] for r in counts)

    def upsert(self, rows: DataFrame) -> tuple[int, int]:
        """Rows replace those of their key, of which ``rows`` has one each; (rows replaced, rows new)."""
        fresh = self._bucketed(rows.select(self.rows().columns))
        touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
        if not touched:
            return 0, 0
        keys = fresh.select(F.col(self.key).alias("_key"), F.lit(True).alias("_there"))
        stored = self._stored().where(F.col(BUCKET).isin(touched))
        marked = stored.join(keys, F.col(self.key) == F.col("_key"), "left").drop("_key").withColumn("_old", F.lit(True))
        seen = Observation()
        both = marked.unionByName(fresh.withColumns({"_there": F.lit(False), "_old": F.lit(False)}))
        counted = both.observe(seen, F.count_if(F.col("_old") & F.coalesce("_there", F.lit(False))).alias("replaced"), F.count_if(~F.col("_old")).alias("n"))
        self._write(counted.where(~(F.col("_old") & F.coalesce("_there", F.lit(False)))).drop("_there", "_old"), "overwrite")
        return seen.get["replaced"], seen.get["n"] - seen.get["replaced"]
