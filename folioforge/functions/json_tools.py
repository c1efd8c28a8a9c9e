"""Schema-on-read helpers: tags, stored phase results, fences around model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(tags: Column) -> Column:
    """A JSON list, else a comma list, else one tag; blank is none. JSON that is no list is text."""
    listed = F.when(F.trim(tags).startswith("["), F.from_json(tags, "array<string>"))
    parts = F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != "")
    plain = F.when(tags.contains(","), parts).otherwise(F.array(F.trim(tags)))
    return F.when(tags.isNull() | (F.trim(tags) == ""), F.array().cast("array<string>")).otherwise(F.coalesce(listed, plain))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def is_error_result(text: Column) -> Column:
    """Blank, or an object with an error key; text that is no JSON is no error."""
    keys = F.json_object_keys(text)
    marked = F.array_contains(keys, "error") | F.array_contains(keys, "_parse_error")
    return (F.trim(text) == "") | F.coalesce(marked, F.lit(False))


def valid_or_wrapped(text: Column) -> Column:
    """JSON as it is; anything else as an object with the raw text."""
    wrapped = F.to_json(F.struct(text.alias("_raw"), F.lit("not JSON").alias("_parse_error")))
    return F.when(is_json(text), text).otherwise(wrapped)


def field(text: Column, *names: str, default: str | None = None) -> Column:
    """The first of the fields that is there."""
    found = [F.get_json_object(text, f"$.{name}") for name in names]
    return F.coalesce(*found, *([F.lit(default)] if default is not None else []))


def without_fence(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))


def fenced(text: Column, language: str) -> Column:
    """The first fenced block of a language, else the text without its fence."""
    block = F.regexp_extract(text, rf"(?s)```{language}\s*\n(.*?)```", 1)
    return F.when(block != "", F.trim(F.regexp_replace(block, r"\s+$", ""))).otherwise(without_fence(text))


def list_of(text: Column, schema: str, wrapper: str = "visualizations") -> Column:
    """A JSON list, an object that wraps one, a list inside other text, or one object as a list of one."""
    inner = F.get_json_object(text, f"$.{wrapper}")
    salvaged = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    as_list = lambda c: F.when(F.trim(c).startswith("[") & is_json(c), F.from_json(c, f"array<{schema}>"))
    single = F.when(F.trim(text).startswith("{") & is_json(text), F.array(F.from_json(text, schema)))
    return F.coalesce(as_list(text), as_list(inner), as_list(salvaged), single)
