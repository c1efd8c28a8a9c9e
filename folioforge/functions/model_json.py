"""What models answer, as JSON of changing shape: defaults, alternative names, nested or flat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBFIGURE = "array<struct<label:string,x:double,y:double,w:double,h:double,confidence:double>>"
PLAN = "array<struct<id:string,title:string,type:string,description:string>>"
#: Pictures of a plan at most, as in the analysis itself.
PLAN_CAP = 5


def one_of(text: Column, *paths: str) -> Column:
    """The first of the JSON paths that is there."""
    return F.coalesce(*(F.get_json_object(text, f"$.{p}") for p in paths))


def nested_or_flat(text: Column, holder: str, name: str) -> Column:
    """A field of the object ``holder``, or of the whole where it has no such object."""
    return one_of(text, f"{holder}.{name}", name)


def token_usage(text: Column) -> tuple[Column, Column]:
    """(tokens in, tokens out) under any of the names that clients use, 0 if there is none."""
    count = lambda *names: F.coalesce(one_of(text, *names).try_cast("bigint"), F.lit(0).cast("bigint"))
    return count("input_tokens", "prompt_token_count", "tokens_in"), count("output_tokens", "candidates_token_count", "tokens_out")


def joined_parts(parts: Column) -> Column:
    """The texts of an array of texts, a line feed between two, empty ones left out."""
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def subfigures(text: Column) -> Column:
    """The sub-figures of an answer: label ?, the whole figure as box and confidence 0.5 where they are missing."""
    raw = F.from_json(text, "array<struct<label:string,bbox:array<double>,confidence:double>>")
    corner = lambda box, i, default: F.coalesce(F.get(box, F.lit(i)), F.lit(default))
    full = lambda r: F.struct(
        F.coalesce(r["label"], F.lit("?")).alias("label"),
        *(corner(r["bbox"], i, d).alias(n) for i, (n, d) in enumerate((("x", 0.0), ("y", 0.0), ("w", 1.0), ("h", 1.0)))),
        F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"),
    )
    return F.coalesce(F.transform(raw, full), F.array().cast(SUBFIGURE))


def picture_plan(text: Column) -> Column:
    """The first pictures of a plan; an answer that is no plan counts as one overview flowchart."""
    default = F.array(F.struct(F.lit("viz_1").alias("id"), F.lit("Overview").alias("title"), F.lit("flowchart").alias("type"), F.lit("").alias("description"))).cast(PLAN)
    plan = F.from_json(text, PLAN)
    return F.when(F.size(plan) > 0, F.slice(plan, 1, PLAN_CAP)).otherwise(default)


def in_plan_order(items: Column, plan: Column) -> Column:
    """Items (id, ...) in the order in which the plan's ids come; items of no planned id last, by id."""
    place = lambda item: F.nullif(F.array_position(plan, item["id"]), F.lit(0))
    keyed = F.transform(items, lambda item: F.struct(F.coalesce(place(item), F.lit(1 << 40)).alias("place"), item["id"].alias("id"), item.alias("item")))
    return F.transform(F.array_sort(keyed), lambda k: k["item"])


def resolved(*sources: Column) -> Column:
    """The first source that gives a value that is not blank: a key's precedence."""
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in sources))


def output_dir(year: Column, author: Column, title: Column) -> Column:
    """{year}_{last name}_{title, 30 characters} of word characters."""
    word = lambda x, n: F.substring(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9]+", "_"), 1, n)
    last = F.element_at(F.split(F.trim(author), r"\s+"), -1)
    return F.concat_ws("_", F.coalesce(year.cast("string"), F.lit("unknown")), word(last, 40), word(title, 30))
