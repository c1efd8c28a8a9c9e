"""Library operators: filters, pages, changes to tables, joins and window picks. All take and return DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioforge.schemas import ERROR_PHASE, SORTABLE
from folioforge.session import dropped_at_exit, shared_path, written

# --- filters -------------------------------------------------------------------------------------------------


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of equalities; None and '' mean no filter."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def like_any(columns: list[str], text: str, escape: bool = True) -> Column:
    """Case-insensitive substring over any of the columns; wildcards of the text count as characters if ``escape``."""
    if escape:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns))


def search_text(df: DataFrame, text: str | None, columns: list[str], newest_by: str | None = None) -> DataFrame:
    found = df.where(like_any(columns, text)) if text else df
    return found.orderBy(F.col(newest_by).desc(), F.col("id").desc()) if newest_by else found


def has_tag(tags: Column, tag: str, strict: bool = False) -> Column:
    """``strict``: a member of the parsed list; otherwise a substring of the stored text."""
    return F.array_contains(tags, tag) if strict else F.coalesce(tags.ilike(f"%{tag}%"), F.lit(False))


def not_errors(results: DataFrame) -> DataFrame:
    return results.where(F.col("phase") != ERROR_PHASE)


def month_range(ts: str, month: str) -> Column:
    """Half-open range of the month ``YYYY-MM``; the year's end rolls over by calendar arithmetic."""
    first = F.to_date(F.lit(f"{month}-01"))
    return (F.col(ts) >= first.cast("timestamp_ntz")) & (F.col(ts) < F.add_months(first, 1).cast("timestamp_ntz"))


def large_enough(width: str, height: str, least: float) -> Column:
    return (F.col(width) >= least) & (F.col(height) >= least)


def sort_column(name: str | None, ascending: bool = False) -> tuple[str, bool]:
    """An allowed sort column; anything else falls back to the newest first."""
    return (name, ascending) if name in SORTABLE else ("created_at", False)


# --- sorts and pages -----------------------------------------------------------------------------------------


def page(df: DataFrame, sort: str | None = None, ascending: bool = False, number: int = 1, size: int = 20, key: str = "id") -> DataFrame:
    """One page; nulls are smallest, ties go by key. A top-k plan: nothing is sorted as a whole."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page numbers start at 1, sizes lie between 1 and 100")
    name, ascending = sort_column(sort, ascending)
    order = [F.col(name).asc_nulls_first() if ascending else F.col(name).desc_nulls_last(), F.col(key).asc()]
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def counted(df: DataFrame, size: int = 20) -> DataFrame:
    """Total of the rows that ``page`` pages through, and the number of pages."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


# --- changes: each returns the table as it is after the change ------------------------------------------------


def insert_rows(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Append with new keys from the largest on. Keys are dealt by ordered partitions, without one global window.

    The rows are written once with their places in their partitions, in the shared folder: a task that runs again
    cannot deal them other keys.
    """
    spark = rows.sparkSession
    path = dropped_at_exit(spark, shared_path(spark, "insert"))
    rows.drop(key).withColumn("_slot", F.monotonically_increasing_id()).write.parquet(path)
    part = F.shiftright("_slot", 33)
    placed = spark.read.parquet(path).withColumn("_part", part)
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    counts = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # a row a partition
    low = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    new = placed.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(top))  # one row
    new = new.withColumn(key, F.col("_top") + F.col("_first") + low + 1)
    return base.unionByName(new.select(*base.columns))


def numbered_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 1 on in an order, without one global window: rows are dealt by ranges and written, and a
    range's first number is the number of rows in the ranges before it."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_first") + place).drop("_range", "_first")


def last_changes(changes: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row a key: of several the last by ``order``, which is no field of the table.

    Without an order a key may have one row only; more are an error when the result is read, not any one of them.
    """
    fields = [c for c in changes.columns if c not in (key, order)]
    held = changes.groupBy(key)
    if order is None:
        one = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit(f"several changes without an order of {key} "), F.col(key).cast("string")))).otherwise(F.first(F.struct(*fields)))
        held = held.agg(one.alias("_last")) if fields else held.agg(F.first(key).alias("_last"))
    else:
        held = held.agg(F.max_by(F.struct(*fields), F.col(order)).alias("_last"))
    return held.select(key, *(F.col("_last")[c].alias(c) for c in fields))


def patch_rows(base: DataFrame, patch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Fields of ``patch`` that are not null replace those of the row with the same key; of several patches the last by ``order`` counts."""
    fields = [c for c in patch.columns if c not in (key, order)]
    if not fields:
        raise ValueError("nothing to update")
    new = last_changes(patch, key, order).select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    both = base.join(new, key, "left")
    return both.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose key column is among ``gone`` (a column ``key``)."""
    return {name: df.join(gone.select(F.col("key").alias(column)), column, "left_anti") for name, (df, column) in tables.items()}


def upsert(base: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows replace those of the same key; of several rows of a key the last by ``order`` counts."""
    rows = last_changes(rows, key, order)
    return base.join(rows.select(key), key, "left_anti").unionByName(rows)


def fill_missing(base: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Defaults for the keys that have no row."""
    return base.unionByName(defaults.join(base.select(key), key, "left_anti"))


def set_status(papers: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """``changes`` (id, status); completed rows get the time ``at`` too."""
    both = papers.join(changes.select("id", F.col("status").alias("_status")), "id", "left")
    done = F.col("_status") == "completed"
    both = both.withColumn("analyzed_at", F.when(done, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("analyzed_at")))
    return both.withColumn("status", F.coalesce("_status", "status")).select(*papers.columns)


def free_names(df: DataFrame, name: str, within: list[str], order: str, first: int = 1) -> DataFrame:
    """``df`` with distinct names in each group: the first row of a name, by ``order``, keeps it, and later ones get the
    suffixes _1, _2, ... (``first`` on) in order, those left out that are names of other rows already.

    Names with suffixes of different names differ, so they can only meet whole names: one look at these is enough.
    """
    numbered = df.withColumn("_k", (F.row_number().over(Window.partitionBy(*within, name).orderBy(order)) - 1).cast("long"))
    counted = F.regexp_extract(name, r"(?s)^(.*)_([1-9][0-9]{0,17})$", 2)
    taken = df.where(counted != "").select(*within, F.regexp_extract(name, r"(?s)^(.*)_([1-9][0-9]{0,17})$", 1).alias("_base"), counted.cast("long").alias("_n")).distinct().where(F.col("_n") >= first)
    # the i-th taken number stands in the way of all rows from the (number - i)-th on
    nth = F.row_number().over(Window.partitionBy(*within, "_base").orderBy("_n"))
    walls = taken.select(*within, F.col("_base").alias(name), (F.col("_n") - first + 2 - nth).cast("long").alias("_k"), F.lit(1).alias("_wall"))
    repeated = numbered.where("_k > 0")
    both = repeated.withColumn("_wall", F.lit(0)).unionByName(walls, allowMissingColumns=True)
    skipped = F.sum("_wall").over(Window.partitionBy(*within, name).orderBy("_k", F.desc("_wall")).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_skipped", skipped).where("_wall = 0").withColumn(name, F.concat(name, F.lit("_"), (F.col("_k") + F.col("_skipped") + (first - 1)).cast("string")))
    return numbered.where("_k = 0").select(df.columns).unionByName(placed.select(df.columns))


def without_collisions(df: DataFrame, name: str, key: str = "id", first: int = 2) -> DataFrame:
    """Later rows of the same name, by key, get the first free suffixes of _2, _3, ... (``first`` on)."""
    return free_names(df, name, [], key, first)


# --- joins ---------------------------------------------------------------------------------------------------


def with_titles(results: DataFrame, papers: DataFrame) -> DataFrame:
    """Left join for titles; results without a paper are called by their id."""
    titles = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("_title"))
    both = results.join(titles, "paper_id", "left")
    return both.withColumn("title", F.coalesce("_title", F.concat(F.lit("Paper "), F.col("paper_id")))).drop("_title")


def lookup(df: DataFrame, dimension: dict, column: str, to: str, default) -> DataFrame:
    """A small constant dimension as an expression: no join, no shuffle."""
    found = F.lit(default)
    for key, value in reversed(list(dimension.items())):
        found = F.when(F.col(column) == key, F.lit(value)).otherwise(found)
    return df.withColumn(to, found)


def ordinal_match(items: DataFrame, captions: DataFrame, by: list[str], order: str) -> DataFrame:
    """The i-th caption of a document belongs to its i-th item."""
    w = Window.partitionBy(*by).orderBy(order)
    left = items.withColumn("_i", F.row_number().over(w))
    right = captions.withColumn("_i", F.row_number().over(w)).select(*by, "_i", "caption")
    return left.join(right, [*by, "_i"], "left").drop("_i")


# --- window picks --------------------------------------------------------------------------------------------


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group; the plan keeps one row a group before it shuffles (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_by_phase(results: DataFrame, phases: list[str], key: str = "paper_id") -> DataFrame:
    """A column for each phase with its last result: one aggregation, no sort."""
    last = [F.max_by(F.when(F.col("phase") == p, F.col("result")), F.when(F.col("phase") == p, F.struct("created_at", "id"))).alias(p) for p in phases]
    return results.groupBy(key).agg(*last)


def chain_edges(nodes: DataFrame, by: list[str], order: str, node: str) -> DataFrame:
    """An edge from each node to the next of its group."""
    w = Window.partitionBy(*by).orderBy(order)
    return nodes.withColumn("source", F.lag(node).over(w)).where("source IS NOT NULL").select(*by, "source", F.col(node).alias("target"))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, prefix: str = "") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.concat(F.lit(prefix), n) if prefix else n)


def met(first: DataFrame, second: DataFrame, by: list[str], order: list[str], columns: list[str], match: Callable[[list[tuple], list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``match`` makes of each key's rows of both tables, in order, as tuples of ``columns`` (null where a table has none).

    Keys come sorted inside partitions and are taken one after the other: a call for each batch of rows, not for each key.
    """
    both = first.withColumn("_second", F.lit(False)).unionByName(second.withColumn("_second", F.lit(True)), allowMissingColumns=True)
    made = to_arrow_schema(StructType.fromDDL(schema))
    places, side = [columns.index(c) for c in by], len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def done() -> list[tuple]:
            return match(*held) if held[0] or held[1] else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            parts = zip(*rows) if rows else [()] * len(made)
            return pa.RecordBatch.from_arrays([pa.array(list(part), f.type) for part, f in zip(parts, made)], schema=made)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (now := tuple(row[i] for i in places)) != key:
                    out += done()
                    key, held = now, ([], [])
                held[row[side]].append(row[:side])
            yield batch_of(out)
        yield batch_of(done())

    return both.select(*columns, "_second").repartition(*by).sortWithinPartitions(*by, "_second", *order).mapInArrow(run, schema)
