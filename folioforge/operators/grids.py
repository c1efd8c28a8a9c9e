"""Tables in texts and web pages as grids of cells, numbered through a whole corpus."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.relational import numbered_in_order

TABLE = re.compile(r"<table\b[^>]*>(.*?)</table\s*>", re.I | re.S)
ROW = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|\Z)", re.I | re.S)
CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]\s*>|\Z)", re.I | re.S)
SPAN = {side: re.compile(rf"\b{side}span\s*=\s*[\"']?\s*(\d+)", re.I) for side in ("row", "col")}
#: Widest span that is believed, as in browsers.
WIDEST = 1000


def text_grids(docs: DataFrame, key: str = "doc_id", text: str = "text", least_rows: int = 2) -> DataFrame:
    """(key, table_id, first_line, grid) of the runs of lines that hold cells between bars; cells are trimmed, short rows
    filled with nulls, rulers (---|---) left out. Tables are numbered by key and place: table_1, table_2, ...

    Only lines with bars leave the scan. A null text has no tables.
    """
    ruler = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line")).where(F.col("line").contains("|"))
    run = F.col("at") - F.row_number().over(Window.partitionBy(key).orderBy("at"))
    bare = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = F.transform(F.split(bare, r"\|", -1), lambda c: F.trim(c))
    rows = lines.withColumn("run", run).where(~F.col("line").rlike(ruler)).select(key, "run", F.struct("at", cells.alias("cells")).alias("row"))
    held = rows.groupBy(key, "run").agg(F.sort_array(F.collect_list("row")).alias("rows")).where(F.size("rows") >= least_rows)
    width = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    filled = held.withColumn("width", width).withColumn("grid", F.transform("rows", lambda r: F.concat(r["cells"], F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size(r["cells"])))))
    tables = filled.where("width > 1").select(key, F.col("rows")[0]["at"].alias("first_line"), "grid")
    return numbered_in_order(tables, [key, "first_line"], "n").select(key, F.concat(F.lit("table_"), F.col("n").cast("string")).alias("table_id"), "first_line", "grid")


def spread_cells(table: str) -> list[list[str | None]]:
    """The cells of an HTML table in a grid: a cell that spans rows or columns stands in its first place, null in the others."""
    grid: list[list[str | None]] = []
    open_: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in ROW.findall(table):
        out: list[str | None] = []

        def covered() -> None:
            while open_.get(len(out), 0):
                open_[len(out)] -= 1
                out.append(None)

        for attributes, body in CELL.findall(row):
            covered()
            rows, columns = (min(WIDEST, max(1, int(m.group(1)) if (m := SPAN[side].search(attributes)) else 1)) for side in ("row", "col"))
            content = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
            for k in range(columns):
                open_[len(out)] = rows - 1
                out.append(content if k == 0 else None)
        covered()
        for column in [c for c, left in open_.items() if left and c >= len(out)]:
            out += [None] * (column + 1 - len(out))
            open_[column] -= 1
        if out:
            grid.append(out)
    width = max(map(len, grid), default=0)
    return [row + [None] * (width - len(row)) for row in grid]


def page_grids(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, table_id, table_no, grid) of the tables in HTML pages, numbered by page and place; nested tables count as part of the outer one's first cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, grid) for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, found in enumerate(TABLE.findall(source or "")) if (grid := spread_cells(found))]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [key, "table_no", "grid"])

    kind = pages.schema[key].dataType.simpleString()
    tables = pages.select(key, page).where(F.col(page).contains("<")).mapInArrow(run, f"`{key}` {kind}, table_no int, grid array<array<string>>")
    return numbered_in_order(tables, [key, "table_no"], "n").select(key, F.concat(F.lit("table_"), F.col("n").cast("string")).alias("table_id"), "table_no", "grid")
