"""Metadata and excerpts of paper texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.vocabulary import JOURNAL_PATTERNS, METHOD_MARKERS


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def shorten(text: Column, length: int, keep: int, mark: str = "...") -> Column:
    """Texts above ``length`` are cut to ``keep`` characters and a mark."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def title(metadata: Column, text: Column) -> Column:
    first = shorten(F.get(lines(text), F.lit(0)), 200, 200)
    return F.coalesce(F.nullif(F.trim(metadata), F.lit("")), first, F.lit("Untitled Paper"))


def title_of_lines(text: Column) -> Column:
    """The first of ten lines that looks like a title: long, no digits only, no page mark, not all capitals."""
    candidates = F.filter(F.slice(lines(text), 1, 10), lambda x: (F.length(x) > 20) & ~x.rlike(r"^\d+$") & ~x.rlike(r"(?i)^page\s+\d+") & ((F.upper(x) != x) | (F.lower(x) == x)))
    return F.coalesce(F.get(candidates, F.lit(0)), F.get(lines(text), F.lit(0)), F.lit("Unknown Title"))


def doi(text: Column, strip: bool = True) -> Column:
    found = F.regexp_extract(text, r"10\.\d{4,}/[^\s]+", 0)
    return F.nullif(F.regexp_replace(found, r"[.,;)]+$", "") if strip else found, F.lit(""))


def common_year(text: Column) -> Column:
    """The most common year 1990-2100 of the first 3000 characters; of ties the first seen."""
    years = F.filter(F.transform(F.regexp_extract_all(F.substring(text, 1, 3000), F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), lambda y: y.cast("int")), lambda y: (y >= 1990) & (y <= 2100))
    best = F.aggregate(
        F.array_distinct(years),
        F.struct(F.lit(None).cast("int").alias("year"), F.lit(0).alias("n")),
        lambda top, y: F.when(F.size(F.filter(years, lambda z: z == y)) > top["n"], F.struct(y.alias("year"), F.size(F.filter(years, lambda z: z == y)).alias("n"))).otherwise(top),
    )
    return best["year"]


def year(created: Column, text: Column) -> Column:
    """Of the document's creation date where that is sensible, else the text's."""
    stamp = F.try_to_number(F.nullif(F.regexp_extract(created, r"(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")
    return F.coalesce(F.when(stamp.between(1900, 2100), stamp), common_year(text))


def latest_year(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), lambda y: y.cast("int")))


def journal(text: Column) -> Column:
    head = F.substring(text, 1, 2000)
    return F.coalesce(*(F.nullif(F.substring(F.trim(F.regexp_extract(head, p, 0)), 1, 100), F.lit("")) for p in JOURNAL_PATTERNS))


def authors(text: Column) -> Column:
    """Names in the first 20 lines, up to the line of the abstract; distinct, ten at most."""
    top = F.slice(F.split(text, "\n"), 1, 20)
    stop = F.array_position(F.transform(top, lambda x: x.rlike(r"(?i)\b(?:abstract|introduction)\b")), True)
    used = F.when(stop > 0, F.slice(top, F.lit(1), stop.cast("int"))).otherwise(top)
    names = F.flatten(F.transform(used, lambda x: F.regexp_extract_all(x, F.lit(r"[A-Z][a-z]+\s+(?:[A-Z]\.\s*)?[A-Z][a-z]+"), F.lit(0))))
    return F.slice(F.array_distinct(F.transform(names, lambda x: F.trim(x))), 1, 10)


def cut_at_sentence(text: Column, length: int = 200, least: int = 50) -> Column:
    """Cut to ``length``, at the last full stop where that is beyond ``least``."""
    head = F.substring(text, 1, length)
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    return F.when(F.length(text) <= length, text).when(head.contains(".") & (stop > least + 1), F.substring(head, F.lit(1), stop)).otherwise(head)


def method_excerpt(text: Column) -> Column:
    """The head and what follows the earliest methods marker, else the first 20,000 characters."""
    low = F.lower(text)
    starts = F.filter(F.array(*(F.locate(m, low) for m in METHOD_MARKERS)), lambda i: i > 1)
    start = F.array_min(starts)
    begin = F.greatest(F.lit(1), start - 500)
    return F.when(F.size(starts) == 0, F.substring(text, 1, 20000)).otherwise(F.concat(F.substring(text, 1, 3000), F.lit("\n\n...\n\n"), F.substring(text, begin, F.lit(18000))))


def window(text: Column, head: int, tail: int = 0) -> Column:
    """The first characters and, of longer texts, the last ones."""
    if not tail:
        return F.substring(text, 1, head)
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n\n...\n\n"), F.right(text, F.lit(tail))))


def safe_name(text: Column, length: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\-.]", "_"), "_+", "_"), 1, length)


def folder_name(year_: Column, title_: Column, key: Column) -> Column:
    return F.concat_ws("_", F.coalesce(year_.cast("string"), F.lit("unknown")), safe_name(title_, 40), F.substring(F.md5(key.cast("string").cast("binary")), 1, 8))


def renamed(names: Column, wanted: Column) -> Column:
    """New names where there is one for each, else the old ones."""
    clean = F.transform(wanted, lambda x: safe_name(x))
    return F.when(F.size(wanted) == F.size(names), F.zip_with(names, clean, lambda a, b: F.coalesce(F.nullif(b, F.lit("")), a))).otherwise(names)


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def wrapped(text: Column, width: int, unit: int = 8) -> Column:
    """Lines of whole words up to a pixel width, at a fixed width a character."""
    step = lambda done, w: F.when((F.size(done) > 0) & ((F.length(F.concat(F.element_at(done, -1), F.lit(" "), w)) * unit) <= width), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), w)))).otherwise(F.array_append(done, w))
    return F.aggregate(words(text), F.array().cast("array<string>"), step)


def pretty_key(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def saved_percent(full: Column, part: Column) -> Column:
    """Share of tokens that a part saves, in percent; null for empty texts."""
    tokens = lambda t: word_count(t) * 1.3
    return F.round(F.try_divide(tokens(full) - tokens(part), tokens(full)) * 100, 1)


def keyword_hits(text: Column, keywords: list[str], acronyms: bool = True) -> Column:
    """Keywords that the text holds, each once. Capitals are acronyms and must match as they are."""
    low = F.lower(text)
    hit = lambda k: F.contains(text if acronyms and k.isupper() else low, F.lit(k))
    return reduce(lambda a, b: a + b, (hit(k).cast("int") for k in keywords))


def pages_text(pages: DataFrame, marks: bool = False) -> DataFrame:
    """(doc_id, text) of (doc_id, page_no, text): pages in order, joined by line feeds or page marks."""
    body = F.concat(F.lit("\n--- Page "), "page_no", F.lit(" ---\n"), "text") if marks else F.col("text")
    held = pages.select("doc_id", "page_no", body.alias("body")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "body"))).alias("p"))
    return held.select("doc_id", F.array_join(F.col("p.body"), "" if marks else "\n").alias("text"))
