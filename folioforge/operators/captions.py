"""Figure captions: definitions, structure, references, and their match to figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import cut_at_sentence
from folioforge.operators.relational import first_of, met

DEFINITION = r"(?:Fig\.|Figure)\s*(\d+)\s*[.:][ \t]*"
MARK = "\u0001"


def definitions(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, fig_num, caption): the first definition of each figure. A short rest takes the next line too.

    A page is cut at its definitions; what follows a cut starts with the figure's number.
    """
    marked = F.split(F.regexp_replace("text", DEFINITION, f"{MARK}$1{MARK}"), MARK)
    cut = pages.select("doc_id", "page_no", F.posexplode(marked).alias("i", "number"), marked.alias("cuts"))
    cut = cut.where("i % 2 = 1").select("doc_id", "page_no", "i", F.col("number").cast("int").alias("fig_num"), F.get("cuts", F.col("i") + 1).alias("rest"))
    first = F.trim(F.regexp_extract("rest", r"^([^\n]*)", 1))
    after = F.trim(F.regexp_extract("rest", r"^[^\n]*\n\s*([^\n]+)", 1))
    text = F.when(F.length(first) < 5, F.trim(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(after, F.lit(""))))).otherwise(first)
    found = cut.withColumn("caption", cut_at_sentence(text)).where("caption <> ''")
    return first_of(found, ["doc_id", "fig_num"], ["page_no", "i"]).select("doc_id", "page_no", "fig_num", "caption")


def _near(found: list[tuple], figures: list[tuple]) -> list[tuple]:
    """The captions (doc_id, page_no, fig_num, caption, ...) of a document's figures (doc_id, page_no, ..., figure_num, seq), both in order."""
    by_page: dict[int, list[tuple]] = {}
    for c in found:
        by_page.setdefault(c[1], []).append(c)
    next_of = dict.fromkeys(by_page, 0)
    used: set[int] = set()
    rows = []
    for f in figures:
        for page in (f[1], f[1] + 1, f[1] - 1):
            here, i = by_page.get(page, []), next_of.get(page, 0)
            while i < len(here) and here[i][2] in used:  # used ones stay used
                i += 1
            next_of[page] = i
            if i < len(here):
                used.add(here[i][2])
                rows.append((f[0], f[4], f"Fig. {here[i][2]}. {here[i][3]}"))
                break
    return rows


def match_near_pages(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc_id, figure_num, caption): in figure order the first free caption of the page, the next, the one before.

    Greedy and in order, so documents are taken one after the other.
    """
    pages = figures.withColumn("page_no", F.regexp_extract("figure_num", r"^p(\d+)_(?:fig|img)\d+", 1)).where("page_no <> ''").withColumn("page_no", F.col("page_no").cast("int"))
    columns = ["doc_id", "page_no", "fig_num", "caption", "figure_num", "seq"]
    order = ["seq", "page_no", "fig_num"]  # seq of the figures; captions have none
    return met(captions.select(*columns[:4]), pages.select("doc_id", "page_no", "figure_num", "seq"), ["doc_id"], order, columns, _near, "doc_id long, figure_num string, caption string")


def match_by_number(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """The last caption of a figure's number, else that of its part ``a``."""
    last = captions.groupBy("doc_id", "number").agg(F.max_by("caption", "pos").alias("caption"))
    own = last.withColumnRenamed("caption", "_own")
    part = last.select("doc_id", F.col("number").alias("_part"), F.col("caption").alias("_first"))
    both = figures.join(own, ["doc_id", "number"], "left").join(part, (figures["doc_id"] == part["doc_id"]) & (F.concat(figures["number"], F.lit("a")) == F.col("_part")), "left").drop(part["doc_id"])
    return both.withColumn("caption", F.coalesce("_own", "_first")).drop("_own", "_part", "_first")


def structured(caption: Column) -> Column:
    """struct(title, sub_captions[label, text]) of a caption with parts (A), (b) or ``a, Text``."""
    text = F.trim(F.regexp_replace(F.coalesce(caption, F.lit("")), r"\s+", " "))
    marked = F.regexp_replace(text, r"[(|]\s*([A-Za-z])\s*[).,|]", f"{MARK}$1{MARK}")
    marked = F.regexp_replace(marked, r"\b([a-z])\s*[,;]\s+(?=[A-Z])", f"{MARK}$1{MARK}")
    parts = F.split(marked, MARK)
    ends = lambda x, chars: F.trim(F.regexp_replace(F.trim(x), rf"[{chars}]+$", ""))
    n = F.size(parts)
    places = F.when(n > 2, F.sequence(F.lit(1), n - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    subs = F.transform(places, lambda i: F.struct(F.upper(F.get(parts, i)).alias("label"), ends(F.get(parts, i + 1), r".;,|").alias("text")))
    title = F.when(n > 2, ends(F.get(parts, F.lit(0)), r".:|\-")).otherwise(text)
    return F.struct(title.alias("title"), F.filter(subs, lambda s: s["text"] != "").alias("sub_captions"))


def full_text(structure: Column) -> Column:
    return F.concat_ws(" ", structure["title"], F.array_join(F.transform(structure["sub_captions"], lambda s: F.concat(F.lit("("), s["label"], F.lit(") "), s["text"])), " "))


def references(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, sentence, number, label): sentences that name a figure, with its number and part."""
    pattern = r"[^.]*\b(?:Fig(?:ure|s)?\.?)\s*(\d+)\s*\(?([A-Za-z])?\)?(?![A-Za-z])[^.]*\."
    texts = F.regexp_replace("text", r"(?i)\bFig\.", "Fig")
    groups = [F.regexp_extract_all(texts, F.lit(pattern), F.lit(g)) for g in range(3)]
    found = pages.select("doc_id", "page_no", F.explode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("sentence", "number", "label"))))).alias("r"))
    return found.select("doc_id", "page_no", F.trim("r.sentence").alias("sentence"), F.col("r.number").cast("int").alias("number"), F.upper("r.label").alias("label"))


#: A caption at the start of a line, and what ends a running caption in a whole text.
BLOCK_START = r"(?im)^(?:Figure|Fig\.?)\s+(\d+[a-zA-Z]?)\s*[|.:\-]"
RUNNING = r"(?is)(?:{kind}|{short}\.?)\s+(\d+[a-zA-Z]?)[:.\s]+(.+?)(?=\n\n|{kind}|{short}\.|{other}|\n[A-Z][a-z]+\s+\d+|\z)"
FIGURES = RUNNING.format(kind="Figure", short="Fig", other="Table")
TABLES = RUNNING.format(kind="Table", short="Tbl", other="Figure")


def block_number(block: Column) -> Column:
    """The number of the figure whose caption starts a line of the block; null if none does."""
    return F.nullif(F.regexp_extract(block, BLOCK_START, 1), F.lit(""))


def sql_classes(pattern: str) -> str:
    """``pattern`` with white space and, under (?i), letters as SQL's regular expressions read them (no vertical tab; ſ and K are letters)."""
    return pattern.replace(r"\s]", r" \t\n\f\r]").replace(r"\s", r"[ \t\n\f\r]").replace("[A-Z][a-z]", "[A-Za-z\u017f\u212a][A-Za-z\u017f\u212a]")


def running_captions(texts: DataFrame, pattern: str = FIGURES, space: str = r"\s+") -> DataFrame:
    """(doc_id, number, pos, caption): each caption of a whole text with its white space squeezed."""
    groups = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "number"), (2, "caption"))))
    found = texts.select("doc_id", F.posexplode(groups).alias("pos", "c"))
    return found.select("doc_id", F.col("c.number").alias("number"), "pos", F.trim(F.regexp_replace("c.caption", space, " ")).alias("caption"))


def with_references(figures: DataFrame, refs: DataFrame) -> DataFrame:
    """``figures`` (doc_id, number, labels) as a row for each figure (label null) and each of its parts, with references.

    A part takes the sentences that name it, a figure those that name no part; both in page order.
    """
    one = refs.select("doc_id", F.col("number").cast("string").alias("number"), F.coalesce(F.nullif("label", F.lit("")), F.lit("")).alias("_part"), F.struct("page_no", "sentence").alias("r"))
    named = one.groupBy("doc_id", "number", "_part").agg(F.sort_array(F.collect_list("r")).alias("references"))
    parts = F.concat(F.array(F.lit("")), F.transform("labels", lambda x: F.upper(x)))
    rows = figures.select("doc_id", F.col("number").cast("string").alias("number"), F.explode(parts).alias("_part"))
    both = rows.join(named, ["doc_id", "number", "_part"], "left")
    return both.select("doc_id", "number", F.nullif("_part", F.lit("")).alias("label"), F.coalesce("references", F.array().cast("array<struct<page_no:int,sentence:string>>")).alias("references"))


def filled_structure(caption: Column, stored: Column) -> Column:
    """The stored structure, else that of the caption; null without a caption."""
    return F.coalesce(stored, F.when(F.coalesce(caption, F.lit("")) != "", structured(caption)))


def backfilled(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """``figures`` (doc_id, number, caption) with empty captions filled from the captions that the pages define; ``filled`` marks them."""
    found = definitions(pages).select("doc_id", F.col("fig_num").alias("number"), F.col("caption").alias("_found"))
    both = figures.join(found, ["doc_id", "number"], "left")
    empty = F.coalesce("caption", F.lit("")) == ""
    return both.select("doc_id", "number", F.when(empty, F.coalesce("_found", F.lit(""))).otherwise(F.col("caption")).alias("caption"), (empty & F.col("_found").isNotNull()).alias("filled"))


def sub_captions(wanted: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, text) of the parts (key, pos, label, text) whose labels are wanted (key, label), whatever their case: of several the first."""
    first = parts.groupBy(key, F.upper("label").alias("label")).agg(F.min_by("text", "pos").alias("text"))
    return wanted.select(key, F.upper("label").alias("label")).join(first, [key, "label"])
