"""How filters act on each other: what every order of them keeps, removes and loses, for each part of a corpus.

A document's failures are a mask of bits. All that any order does follows from the cells (part, mask) -> documents,
good ones, toxic ones: 2 ** filters rows a part, whatever the corpus size. The orders are visited by adjacent
transpositions, so each differs from the one before by one swap, and only the two swapped steps are summed anew from
the cells; what each filter removes is added up along the walk for its Shapley value (times the number of orders).

Copies of a text are found without a join of texts: rows are counted by (text digest, part, mask, labels, doc_id),
then by digest, where the rows of the least doc_id are told from the others.

Defined cases: a null text is an empty one (no words; it passes the word and capital filters' ratios and equals other
empty texts); a text of any length is measured whole; a null part value is the empty string; rows that share a doc_id
are rows of their own, and none of them is a copy of the other by that id; rows without a doc_id come after all ids
and have no labels; several labels of a doc_id count as 1 if any is 1; an empty table gives no rows; only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.quality import let

SPACES = r"[\x20\x09-\x0D]+"
#: Letter -> failure of a text and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that fails copies of a text with a smaller doc_id.
COPIES = "E"
#: Parts whose walks are summed together.
PARTS = 64
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def swaps(n: int) -> Iterator[int]:
    """The places i of the swaps (i, i + 1) that lead through all orders of n things, the last thing sweeping to and fro."""
    if n < 2:
        return
    down, inner = True, swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if (place := next(inner, None)) is None:
            return
        yield place + down
        down = not down


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """(orders, (order, part, step, measure) removed, (part, filter) Shapley sums) of cells (part, mask, measure)."""
    masks = np.arange(1 << n)

    def removed(order: list[int], step: int) -> np.ndarray:
        before = sum(1 << f for f in order[:step])
        return cells[:, (masks >> order[step] & 1 == 1) & (masks & before == 0)].sum(1)

    order = list(range(n))
    steps = np.stack([removed(order, i) for i in range(n)], 1)
    orders, found = [tuple(order)], [steps]
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        steps = steps.copy()
        steps[:, i], steps[:, i + 1] = removed(order, i), removed(order, i + 1)
        orders.append(tuple(order))
        found.append(steps)
    shapley = np.zeros((len(cells), n), np.int64)
    for o, steps in zip(orders, found):
        shapley[:, o] += steps[:, :, 0]
    return orders, np.stack(found), shapley


def _walked(letters: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n = len(letters)
    masks = np.arange(1 << n)

    def report(parts: list[str], rows: list[list[dict]]) -> pa.RecordBatch:
        cells = np.zeros((len(parts), 1 << n, 3), np.int64)
        for p, found in enumerate(rows):
            for cell in found:
                cells[p, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
        orders, removed, shapley = walk(cells, n)
        total = cells[:, :, 0].sum(1)
        fails = np.stack([cells[:, masks >> f & 1 == 1, 0].sum(1) for f in range(n)], 1)
        alone = cells[:, 1 << np.arange(n), 0]
        by_step = np.array(orders)
        n_removed = removed[..., 0]
        long = {
            "kept": total[None, :, None] - n_removed.cumsum(2),
            "removed": n_removed,
            "redundant": fails[:, by_step].transpose(1, 0, 2) - n_removed,
            "unique_fails": alone[:, by_step].transpose(1, 0, 2),
            "good_lost": removed[..., 1],
            "toxic_lost": removed[..., 2],
            "shapley": shapley[:, by_step].transpose(1, 0, 2),
        }
        names = ["".join(letters[f] for f in o) for o in orders]
        each = len(parts) * n
        first = [
            pa.array(np.tile(np.repeat(np.array(parts, object), n), len(orders)), pa.string()),
            pa.array(np.repeat(np.array(names, object), each), pa.string()),
            pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders) * len(parts))),
        ]
        return pa.RecordBatch.from_arrays([*first, *(pa.array(v.reshape(-1)) for v in long.values())], ["part", "filter_order", "step", *long])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                yield report(some.column(0).to_pylist(), some.column(1).to_pylist())

    return run


def failure_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): bit i of the mask is the i-th filter's failure, the next bit that of a copy."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = F.array_remove(F.split(whole, SPACES), "")
    mask = let(F.struct(whole.alias("t"), split.alias("w")), lambda x: sum((fails(x["t"], x["w"]).cast("int") * (1 << i) for i, fails in enumerate(filters.values())), F.lit(0)))
    seen = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), mask.alias("mask"))
    # rows without a doc_id have no labels: a spread of their own keeps them out of one hot partition
    seen = seen.withColumn("spread", F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0))
    judged = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("spread", F.lit(0))
    labelled = seen.join(judged, ["doc_id", "spread"], "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    place = [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")]
    by_id = labelled.groupBy("doc_id", "spread", *kind).agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct(*place, "n")).alias("first"))
    least = F.min(F.struct("first.no_id", "first.doc_id")).over(Window.partitionBy("digest"))
    first = F.when(F.struct("first.no_id", "first.doc_id").eqNullSafe(F.col("least")), F.col("first.n")).otherwise(0)
    copy = 1 << len(filters)
    both = by_kind.withColumn("least", least).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", first.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - first).alias("n")))).alias("x"))
    count = lambda weight: F.sum(F.col("x.n") * weight)
    return both.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(count(F.lit(1)).alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, text: str = "text", part: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells = failure_cells(docs, labels, filters, text, part)
    of_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** filters cells
    return of_part.mapInArrow(_walked("".join(filters) + COPIES), OUT)
