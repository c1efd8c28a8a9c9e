"""File sources: documents as binary files, hashes that tell changed ones, profiles and media types."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LARGEST = 50 * 1024 * 1024
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf"}


def documents(spark: SparkSession, folder: str, largest: int = LARGEST) -> DataFrame:
    """PDF files below a folder that are neither empty nor too large: path, length, content. The size filter is pushed to the listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    return found.where((F.col("length") > 0) & (F.col("length") <= largest)).select("path", "length", "modificationTime", "content")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def changed(files: DataFrame, cached: DataFrame, key: str = "doc_id") -> DataFrame:
    """Files whose hash is not in the cache under their key: only these are read anew."""
    hashed = files.withColumn("hash", content_hash(F.col("content")))
    return hashed.join(cached.select(key, "hash"), [key, "hash"], "left_anti")


def cache_rows(texts: DataFrame, at: str, key: str = "doc_id") -> DataFrame:
    """What the text cache holds of each document."""
    return texts.select(key, "hash", F.lit(at).cast("timestamp_ntz").alias("extracted_at"), F.length("text").cast("long").alias("char_count"), "text")


def media_type(path: Column) -> Column:
    types = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.coalesce(types[F.lower(F.substring_index(path, ".", -1))], F.lit("application/octet-stream"))


def shadowed(*sources: DataFrame, key: str = "name") -> DataFrame:
    """The union of sources in which an earlier source hides rows of the same key in later ones."""
    ranked = [df.withColumn("_rank", F.lit(i)) for i, df in enumerate(sources)]
    both = ranked[0]
    for df in ranked[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_rank")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_rank")


def profiles(spark: SparkSession, *folders: str) -> DataFrame:
    """Agent profiles (YAML) of folders of which earlier ones shadow later ones: name, fields as JSON. Files are read in tasks."""
    import json

    import yaml

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [path.rsplit("/", 1)[-1].rsplit(".", 1)[0] for path in batch.column("path").to_pylist()]
            texts = [json.dumps(yaml.safe_load(content), ensure_ascii=False) for content in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "profile"])

    read = lambda folder: spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").load(folder).select("path", "content")
    return shadowed(*(read(folder).mapInArrow(parsed, "name string, profile string") for folder in folders))


def missing_fields(profile: Column, required: list[str]) -> Column:
    """Required fields that a profile lacks."""
    return F.filter(F.array(*(F.when(F.get_json_object(profile, f"$.{r}").isNull(), F.lit(r)) for r in required)), lambda x: x.isNotNull())
