"""From raw documents to token ids: quality rules, near-duplicate removal, repeated passages, source mix, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the
last with the columns of ``documents``. ``run`` applies them, each result a written table. A document of the
result is a run of blocks of a document that the mix takes, so a doc_id may come more than once.

Each stage handles nulls, empty texts and repeated rows as its operator says; rows without a doc_id, and rows of
different texts that share one, are documents like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.byte_bpe import encode_and_decode
from folioforge.llm.common import row_key, stash, table, unstash
from folioforge.llm.mixing import mixed_texts
from folioforge.llm.ngram_join import Join
from folioforge.llm.quality import judge
from folioforge.llm.queries_bpe import RANKS
from folioforge.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the weakly supervised rules keep."""
    return judge(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one of least id; equal rows count as one."""
    kept = Join(docs).labelled().where("kept").select(F.col("doc_id").alias("kept_id"), "row")
    keyed = docs.withColumn("row", row_key("doc_id", "text"))
    same = (keyed["row"] == kept["row"]) & keyed["doc_id"].eqNullSafe(F.col("kept_id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["row", "doc_id"]).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents; characters cut apart and texts that are used up go too."""
    cut = remove_repeats(docs, carry=("doc_id", "lang", "source"), as_text=True).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).where("n_chars > 0").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and parts of documents that the mix takes, as often as it takes them."""
    return mixed_texts(docs).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and the digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path(RANKS)
    both = encode_and_decode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("suffix-array dedup", suffix_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: Shingle joins and byte passages over whole tables are out of SQL's reach; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = None
    for name, stage in STAGES:
        docs = stash(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir), "stage")
        if before is not None:
            unstash(before)
        before = docs
    return docs
