"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.ngram_join import Join


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join(table(spark, sf_dir, "documents")).labelled().select("doc_id", "n_shingles", "component_id")
