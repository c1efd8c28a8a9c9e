"""Sections of papers. Texts become arrays of lines, lines get the section they start, sections carry on to the next start.

A document is split inside its row, in one scan of the table and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import word_count
from folioforge.functions.vocabulary import HEADING_PATTERNS, SECTION_PATTERNS

LONGEST_HEADER = 100


def section_of(line: Column, patterns: dict[str, str]) -> Column:
    """The last type whose pattern a short line matches, else null."""
    found = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        found = F.when(line.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(found)
    return F.when(F.length(F.trim(line)) <= LONGEST_HEADER, found)


def snake_name(heading: Column, patterns: dict[str, str] = SECTION_PATTERNS) -> Column:
    """A known type's name, else the heading without its number in snake case."""
    known = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        known = F.when(heading.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(known)
    clean = F.regexp_replace(F.regexp_replace(heading, r"^[\dIVX]+(?:\.\s*|\s+)", ""), r"^\([^)]+\)\s*", "")
    clean = F.regexp_replace(F.trim(F.lower(clean)), r"(?U)[^\w\s-]", "")
    return F.coalesce(known, F.regexp_replace(clean, r"[-\s]+", "_"))


def heading_of(line: Column) -> Column:
    """The words of a numbered heading or a line of capitals, else null."""
    text = F.trim(line)
    found = F.when((F.length(text) > 3) & (F.length(text) < 60) & (F.upper(text) == text) & (F.lower(text) != text), text)
    for pattern in reversed(HEADING_PATTERNS):
        found = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(found)
    return found


PARTS = "array<struct<seq:int,section:string,text:string>>"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _segments(lines: Column, header: Callable[[Column], Column]) -> Column:
    """(seq, section, text) of each header line: the lines up to the next header, without blank lines around them."""
    heads = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), header(line).alias("name"))), lambda h: h["name"].isNotNull())

    def bodies(found: Column) -> Column:
        stop = lambda j: F.coalesce(F.get(found, j + 1)["i"], F.size(lines))
        body = lambda h, j: F.array_join(F.slice(lines, h["i"] + 2, stop(j) - h["i"] - 1), "\n")
        each = F.transform(found, lambda h, j: F.struct(h["i"].alias("seq"), h["name"].alias("section"), F.regexp_replace(body(h, j), r"^\s+|\s+$", "").alias("text")))
        return F.filter(each, lambda part: part["text"] != "")

    return _once(heads, bodies)


def _named(parts: Column, pick: Callable[[Column, Column], Column]) -> Column:
    """One part for each section name, picked from those of that name."""
    return _once(parts, lambda p: F.transform(F.array_distinct(F.transform(p, lambda x: x["section"])), lambda name: pick(name, F.filter(p, lambda x: x["section"] == name))))


def pattern_parts(lines: Column, patterns: dict[str, str] = SECTION_PATTERNS) -> Column:
    """Segments of one type are joined by a blank line, in order."""
    joined = lambda name, same: F.struct(same[0]["seq"].alias("seq"), name.alias("section"), F.array_join(F.transform(same, lambda x: x["text"]), "\n\n").alias("text"))
    return _named(_segments(lines, lambda line: section_of(line, patterns)), joined)


def heading_parts(lines: Column) -> Column:
    """Segments by numbered or capital headings; of equal names the later one counts."""
    header = lambda line: _once(heading_of(line), lambda h: F.when(h.isNotNull(), snake_name(h)))
    return _named(_segments(lines, header), lambda name, same: F.element_at(same, -1))


def parts_of(text: Column, patterns: dict[str, str] = SECTION_PATTERNS) -> Column:
    """Sections by pattern where a text has several, else by heading, else the whole text."""
    whole = F.array(F.struct(F.lit(0).alias("seq"), F.lit("full_text").alias("section"), text.alias("text"))).cast(PARTS)
    by_heading = lambda lines: _once(heading_parts(lines).cast(PARTS), lambda p: F.when(F.size(p) > 1, p).otherwise(whole))
    return _once(F.split(text, "\n"), lambda lines: _once(pattern_parts(lines, patterns).cast(PARTS), lambda p: F.when(F.size(p) > 1, p).otherwise(by_heading(lines))))


def by_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, section, text) by headings alone."""
    return docs.select(key, F.inline(_once(F.split(text, "\n"), heading_parts).cast(PARTS)))


def split_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: dict[str, str] = SECTION_PATTERNS) -> DataFrame:
    """(key, seq, section, text), a row for each section."""
    return docs.select(key, F.inline(parts_of(F.col(text), patterns)))


def section_map(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sections): a map of name to text, at the edge only."""
    entries = F.transform(parts_of(F.col(text)), lambda p: F.struct(p["section"], p["text"]))
    return docs.select(key, F.map_from_entries(entries).alias("sections"))


def first_section(sections: Column, names: list[str]) -> Column:
    return F.coalesce(*(F.when(F.trim(sections[n]) != "", sections[n]) for n in names))


def phase_inputs(sections: Column) -> dict[str, Column]:
    """What each analysis phase reads of the section map."""
    labelled = lambda name, body: F.when(body.isNotNull(), F.concat(F.lit(f"=== {name} ===\n"), body))
    full = F.coalesce(sections["full_text"], F.lit(""))
    tokens = F.filter(F.split(full, r"\s+"), lambda x: x != "")
    ends = F.when(F.size(tokens) > 1000, F.concat(F.lit("=== BEGINNING ===\n"), F.array_join(F.slice(tokens, 1, 500), " "), F.lit("\n\n=== END ===\n"), F.array_join(F.slice(tokens, -500, 500), " "))).otherwise(full)
    screening = F.nullif(F.concat_ws("\n\n", labelled("ABSTRACT", first_section(sections, ["abstract"])), labelled("CONCLUSION", first_section(sections, ["conclusion"]))), F.lit(""))
    deep = F.nullif(F.concat_ws("\n\n", labelled("INTRODUCTION", first_section(sections, ["introduction", "background"])), labelled("RESULTS & DISCUSSION", first_section(sections, ["results_discussion", "results", "discussion"]))), F.lit(""))
    named = F.get(F.filter(F.map_entries(sections), lambda e: e["key"].rlike("method|experimental|procedure|material")), F.lit(0))["value"]
    shown = F.filter(F.array(*map(F.lit, ["results", "results_discussion", "method", "experimental", "materials_methods", "discussion"])), lambda n: F.coalesce(F.trim(F.try_element_at(sections, n)) != "", F.lit(False)))
    return {
        "screening": F.coalesce(screening, ends),
        "visual": F.array_join(F.when(F.size(shown) > 0, shown).otherwise(F.array_sort(F.map_keys(sections))), ","),
        "recipe": F.coalesce(first_section(sections, ["method", "experimental", "materials_methods", "background"]), named, full),
        "deep_dive": F.coalesce(deep, full),
    }


def section_sizes(sections: DataFrame) -> DataFrame:
    return sections.withColumn("n_words", word_count(F.col("text")).cast("long")).drop("text")
