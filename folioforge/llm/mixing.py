"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a digest of their id, form a stream of words that is cut into blocks of equal
size, many whatever the source's size: an eighth of the root of its words, and no more than a 64th of its target. A
source has as many slots as its target holds blocks. Slot k of the mix takes the golden-ratio point of k, looks it up
in the cumulative slots and so belongs to a source; the slot's rank among its source's slots names the block. Blocks
come round again once a source is used up, twice at most.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share ``share`` of all words; none
exceeds ``most`` times its source, and what that frees goes to the others by weight, until none is above.

Only DataFrame expressions. Ranks and offsets are found in two levels (sums of ranges or bins, then rows of one), so
neither the sources nor a source that holds most of the rows are ever one task.

Defined cases: a null text has size 0 and takes nothing; null is a source of its own; rows that repeat a doc_id
are separate documents; of documents with equal digests the order is that of id, size and content; texts of any
length count whole; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, row_key, stash

WEIGHTS = (5, 2, 1)
#: Multiplier and modulus of the golden-ratio sequence in integers: frac(k / phi) * 2**32.
GOLDEN, SPAN = 2654435769, 1 << 32
#: Points of 2**20 neighbouring values look up their source together.
CELL_BITS = 20
#: Slots of a chunk, when slots are ranked.
CHUNK = 1 << 16
#: Documents of a bin of a source's stream, about, when offsets are found; a bin is a prefix of the digest.
BIN_ROWS = 1 << 18


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def running(df: DataFrame, order: Column, **values: Column) -> DataFrame:
    """``df`` with, for each name of ``values``, the sum of its value over the rows before this one in ``order`` (unique).

    Rows are dealt by ranges; a range's start is the sum of the ranges before it, of which there are as many as partitions.
    """
    ranged = stash(df.repartitionByRange(order).select("*", *(v.cast("long").alias(f"__{name}") for name, v in values.items())).withColumn("__range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__range").agg(*(F.sum(f"__{name}").alias(f"__{name}") for name in values))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    starts = sums.select("__range", *(F.coalesce(F.sum(f"__{name}").over(before), none).alias(f"__from_{name}") for name in values))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(starts), "__range")  # a row a partition
    return placed.select(*df.columns, *((F.col(f"__from_{name}") + F.coalesce(F.sum(f"__{name}").over(within), none)).alias(name) for name in values))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, sidx, source_size, target, block, blocks, slots) of each source; a row each, none of them in one task."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(by, F.col("source").asc_nulls_last(), before=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("before") % len(WEIGHTS) + 1).cast("int")).cast("long")
    share = stash(ranked.select("source", "source_size", (F.col("before") + 1).alias("sidx"), weight.alias("weight")), "shares")
    total = share.agg(F.sum("source_size"), F.sum("weight")).first()
    full_size, full_weight = 0, 0
    while True:
        # full: an even share of what the full sources leave would be more than twice the source
        left, weights = 3 * (total[0] or 0) - 4 * full_size, (total[1] or 0) - full_weight
        full = F.col("weight") * F.lit(left).cast("double") > 4.0 * F.col("source_size") * F.lit(weights)
        now = share.where(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if tuple(now) == (full_size, full_weight) or not weights:
            break
        full_size, full_weight = now
    even = (F.col("weight") * left).cast("double") / F.lit(2 * weights).cast("double")
    target = share.withColumn("target", F.when(full if weights else F.lit(True), 2.0 * F.col("source_size")).otherwise(even))
    block = F.greatest(F.lit(1), F.least(F.floor(F.sqrt("source_size") / 8), F.floor(F.col("target") / 64)))
    cut = target.withColumn("block", block.cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = F.when(F.col("blocks") > 0, F.ceil(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0)
    return cut.select("source", "sidx", "source_size", "target", "block", "blocks", slots.cast("long").alias("slots"))


def slots_per_block(sources: DataFrame) -> DataFrame:
    """(sidx, block, times) for every block that the schedule takes."""
    spark = sources.sparkSession
    n_slots = sources.agg(F.sum("slots")).first()[0] or 0
    edge = lambda upto: F.floor(upto.cast("double") / F.lit(float(max(n_slots, 1))) * float(SPAN)).cast("long")
    upto = running(sources.select("sidx", "blocks", "slots"), F.col("sidx").asc(), before=F.col("slots"))
    parts = upto.select("sidx", "blocks", edge(F.col("before")).alias("lo"), edge(F.col("before") + F.col("slots")).alias("hi")).where("hi > lo")
    cells = parts.select("sidx", "blocks", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("k"), ((F.col("id") * F.lit(GOLDEN)) % F.lit(SPAN)).alias("u"))
    slots = slots.withColumn("cell", F.shiftright("u", CELL_BITS))
    dealt = slots.join(cells, (slots["cell"] == cells["cell"]) & (slots["u"] >= F.col("lo")) & (slots["u"] < F.col("hi"))).select("k", "sidx", "blocks", F.floor(F.col("k") / CHUNK).alias("chunk"))
    before = Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("sidx", "chunk").count().select("sidx", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("sidx", "chunk").orderBy("k")
    ranked = dealt.withColumn("n", F.row_number().over(within) - 1).join(starts, ["sidx", "chunk"]).select("sidx", "blocks", (F.col("first") + F.col("n")).alias("rank"))
    used = ranked.where(F.col("rank") < 2 * F.col("blocks"))
    return used.groupBy("sidx", (F.col("rank") % F.col("blocks")).alias("block_no")).agg(F.count("*").alias("times"))


def stream_offsets(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with sidx, block and each document's first word in its source's shuffled stream; documents of size 0 are left out."""
    digits = max(3, math.ceil(math.log(max(1, sizes.count()) / BIN_ROWS, 16)))
    rows = sizes.where("size > 0").join(sources.select("source", "sidx", "block"), sizes["source"].eqNullSafe(sources["source"])).select(sizes["doc_id"], sizes["row"], sizes["size"], "sidx", "block")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = rows.withColumn("digest", digest).withColumn("bin", F.substring("digest", 1, digits))
    before = Window.partitionBy("sidx").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("sidx", "bin").agg(F.sum("size").alias("n")).select("sidx", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("sidx", "bin").orderBy("digest", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["sidx", "bin"]).select("doc_id", "row", "size", "sidx", "block", (F.col("first") + F.col("n")).alias("start"))


class Mix:
    """The mix of ``docs`` (doc_id, source, text). ``sizes`` and ``sources`` are written tables: texts are scanned once."""

    def __init__(self, docs: DataFrame):
        self.sizes = stash(docs.select("doc_id", "source", row_key("doc_id", "source", "text").alias("row"), word_count(F.col("text")).alias("size")), "sizes")
        self.sources = stash(source_targets(self.sizes), "sources")

    def pieces(self) -> DataFrame:
        """(doc_id, row, sidx, size, start, block_no, word, n_words, times): where each document's stream meets each block."""
        docs = stream_offsets(self.sizes, self.sources)
        b = F.col("block")
        first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
        met = docs.select("*", F.explode(F.sequence(first, last)).alias("block_no"))
        begin = F.greatest(F.col("block_no") * b, F.col("start"))
        met = met.select("doc_id", "row", "sidx", "size", "start", "block_no", (begin - F.col("start")).alias("word"), (F.least((F.col("block_no") + 1) * b, F.col("start") + F.col("size")) - begin).alias("n_words"))
        return met.join(slots_per_block(self.sources), ["sidx", "block_no"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """(doc_id, size, source, source_size, target, taken), a row for each document."""
        used = self.pieces().groupBy("sidx", "start", "doc_id", "size").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        some = used.join(self.sources, "sidx").select("doc_id", "size", "source", "source_size", "target", "taken")
        none = self.sizes.where("size = 0").alias("d").join(self.sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        return some.unionByName(none.select("doc_id", "size", "s.source", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs`` (doc_id, text, lang, source, n_chars).

    A row for each run of neighbouring blocks of a document that the same pass takes: mostly whole documents.
    """
    takes = Mix(docs).pieces().where("times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("take"))
    one = Window.partitionBy("sidx", "start", "take").orderBy("block_no")
    runs_of = takes.withColumn("run", F.col("block_no") - F.row_number().over(one)).groupBy("sidx", "start", "take", "run", "row", "size")
    pieces = runs_of.agg(F.min("word").alias("word"), F.sum("n_words").alias("n_words")).select("row", F.col("size").alias("of_size"), "word", "n_words")
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.slice(runs, (F.col("word") + 1).cast("int"), F.col("n_words").cast("int")), "")
    # equal rows share a key: each has pieces of its own, so one of them is enough to cut the pieces from
    keyed = docs.withColumn("row", row_key("doc_id", "source", "text"))
    repeated = keyed.groupBy("row").count().where("count > 1").select("row")
    single = keyed.join(repeated, "row", "left_anti").unionByName(keyed.join(repeated, "row", "left_semi").dropDuplicates(["row"]))
    both = single.join(pieces, "row")
    both = both.withColumn("text", F.when(F.col("n_words") == F.col("of_size"), text).otherwise(part))
    return both.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
