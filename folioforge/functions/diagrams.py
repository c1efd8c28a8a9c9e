"""Diagram targets and their Mermaid text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import shorten
from folioforge.functions.vocabulary import NODE_COLOURS, OTHER_COLOUR


def letter_id(i: Column) -> Column:
    return F.when(i < 26, F.chr(i + 65)).otherwise(F.concat(F.lit("N"), i))


def node_id(text: Column) -> Column:
    clean = F.regexp_replace(text, r"[^a-zA-Z0-9_]", "_")
    return F.when(clean == "", "X").when(clean.rlike(r"^\d"), F.concat(F.lit("N"), clean)).otherwise(clean)


def label_text(text: Column) -> Column:
    return F.translate(text, '";#', "',")


def node_colour(label: Column) -> Column:
    low = F.lower(label)
    found = F.lit(OTHER_COLOUR)
    for word, colour in reversed(list(NODE_COLOURS.items())):
        found = F.when(low.contains(word), F.lit(colour)).otherwise(found)
    return found


def step_nodes(steps: Column) -> Column:
    """A node (id, label) for each step, long labels shortened."""
    return F.transform(steps, lambda s, i: F.struct(letter_id(i).alias("id"), shorten(s, 60, 57).alias("label")))


def chain(nodes: Column) -> Column:
    """Edges from each node to the next."""
    size = F.size(nodes)
    return F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.struct(F.get(nodes, i - 1)["id"].alias("source"), F.get(nodes, i)["id"].alias("target"), F.lit("sequential").alias("label")))).otherwise(F.array().cast("array<struct<source:string,target:string,label:string>>"))


def flowchart(nodes: Column, edges: Column) -> Column:
    """Mermaid text of a flowchart; without edges the nodes make a chain, many nodes go top down."""
    drawn = F.when(F.size(edges) > 0, edges).otherwise(chain(nodes))
    node_lines = F.transform(nodes, lambda n: F.concat(F.lit("    "), node_id(n["id"]), F.lit("["), label_text(n["label"]), F.lit("]")))
    arrow = lambda e: F.when((e["label"] != "") & (e["label"] != "sequential"), F.concat(F.lit(" -->|"), label_text(e["label"]), F.lit("| "))).otherwise(" --> ")
    edge_lines = F.transform(drawn, lambda e: F.concat(F.lit("    "), node_id(e["source"]), arrow(e), node_id(e["target"])))
    styles = F.transform(nodes, lambda n: F.concat(F.lit("    style "), node_id(n["id"]), F.lit(" fill:"), node_colour(n["label"])))
    head = F.array(F.when(F.size(nodes) > 6, "graph TD").otherwise("graph LR"))
    return F.array_join(F.concat(head, node_lines, edge_lines, F.array(F.lit("")), styles), "\n")


def sequence_diagram(nodes: Column, edges: Column) -> Column:
    people = F.transform(nodes, lambda n: F.concat(F.lit("    participant "), node_id(n["id"]), F.lit(" as "), label_text(n["label"])))
    calls = F.transform(edges, lambda e: F.concat(F.lit("    "), node_id(e["source"]), F.lit("->>"), node_id(e["target"]), F.lit(": "), label_text(e["label"])))
    return F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), people, calls), "\n")


def state_diagram(nodes: Column, edges: Column) -> Column:
    states = F.transform(nodes, lambda n: F.concat(F.lit("    "), node_id(n["id"]), F.lit(": "), label_text(n["label"])))
    moves = F.transform(edges, lambda e: F.concat(F.lit("    "), node_id(e["source"]), F.lit(" --> "), node_id(e["target"])))
    return F.array_join(F.concat(F.array(F.lit("stateDiagram-v2")), states, moves), "\n")


def class_diagram(nodes: Column, edges: Column) -> Column:
    classes = F.transform(nodes, lambda n: F.concat(F.lit("    class "), node_id(n["id"]), F.lit("[\""), label_text(n["label"]), F.lit("\"]")))
    links = F.transform(edges, lambda e: F.concat(F.lit("    "), node_id(e["source"]), F.lit(" --> "), node_id(e["target"])))
    return F.array_join(F.concat(F.array(F.lit("classDiagram")), classes, links), "\n")


def clean_mermaid(text: Column) -> Column:
    """Mermaid text without fences, front matter and accessibility lines."""
    body = F.trim(F.regexp_replace(text, r"(?m)^```[^\n]*$", ""))
    body = F.regexp_replace(body, r"(?s)\A\s*---\n.*?\n---\s*\n", "")
    body = F.regexp_replace(body, r"(?s)accDescr\s*\{[^}]*\}", "")
    body = F.regexp_replace(body, r"(?m)^\s*acc(?:Title|Descr)\s*:[^\n]*\n?", "")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def quote_labels(text: pd.Series) -> pd.Series:
    """Labels with special characters in quotes; each match is judged by itself, which no built-in can do."""
    label = re.compile(r"\[([^\[\]\"]*[(){}<>|:][^\[\]\"]*)\]")
    return text.map(lambda t: label.sub(lambda m: f'["{m[1]}"]', t) if t else t)
