"""Which pictures to draw for an analysis, and the inputs of the phases of a batch run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.classify import renderer
from folioforge.operators.relational import free_names

NODES = "array<struct<id:string,label:string,detail:string>>"
EDGES = "array<struct<source:string,target:string,label:string>>"
TARGETS = f"array<struct<type:string,title:string,render_target:string,category:string,description:string,nodes:{NODES},edges:{EDGES}>>"

# The drawing of a paper's argument.
LOGIC_NODES = {"M": "Research Motivation", "A": "Approach / Method", "R": "Key Results", "C": "Conclusions"}
LOGIC_EDGES = [("M", "A", "leads to"), ("A", "R", "produces"), ("R", "C", "supports")]
LOGIC_TEXT = "High-level flow of the research: motivation, approach, results, conclusions."
LONG_ANALYSIS, LONG_COMPARISON, SHOWN, EXCERPT = 100, 50, 3, 200

# The sections that a phase of a batch run reads.
PHASE_SECTIONS = {
    "screening": ["abstract", "conclusion", "conclusions", "summary"],
    "recipe": ["method", "methods", "experimental", "materials and methods", "materials_and_methods", "procedure", "fabrication"],
    "deep_dive": ["introduction", "results", "results and discussion", "results_and_discussion", "discussion"],
}


def _node(i: str, label: str, detail: Column) -> Column:
    return F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), detail.alias("detail"))


def _edge(source: str, target: str, label: str) -> Column:
    return F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(label).alias("label"))


def _target(kind: str, title: str, category: str, description: Column, nodes: Column, edges: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit("mermaid").alias("render_target"), F.lit(category).alias("category"), description.alias("description"), nodes.cast(NODES).alias("nodes"), edges.cast(EDGES).alias("edges"))


def deep_dive_targets(analysis: Column, comparison: Column, strengths: Column, weaknesses: Column) -> Column:
    """The argument's flow for a long analysis, with branches for what it lists, and a comparison for a long one."""
    nodes = F.array(*(_node(i, label, F.lit("")) for i, label in LOGIC_NODES.items()))
    edges = F.array(*(_edge(*e) for e in LOGIC_EDGES))
    for i, label, items in (("S", "Strengths", strengths), ("W", "Weaknesses", weaknesses)):
        there = F.size(items) > 0
        nodes = F.when(there, F.concat(nodes, F.array(_node(i, label, F.array_join(F.slice(items, 1, SHOWN), "; "))))).otherwise(nodes)
        edges = F.when(there, F.concat(edges, F.array(_edge("R", i, "")))).otherwise(edges)
    flow = F.when(F.length(analysis) > LONG_ANALYSIS, _target("flowchart", "Research Logic Flow", "algorithm_flow", F.lit(LOGIC_TEXT), nodes, edges))
    excerpt = F.concat(F.lit("Comparison with prior work: "), F.substring(comparison, 1, EXCERPT))
    compared = F.when(F.length(comparison) > LONG_COMPARISON, _target("conceptual", "Prior Work Comparison", "comparison", excerpt, F.array(), F.array()))
    return F.array_compact(F.array(flow, compared))


def model_targets(text: Column) -> Column:
    """The targets of a model's answer with defaults; another renderer than ours is chosen anew. No JSON: none."""
    raw = F.from_json(text, f"diagrams {TARGETS}")["diagrams"]
    known = lambda value, default: F.coalesce(value, F.lit(default))
    drawn = lambda d: F.when(known(d["render_target"], "mermaid").isin("mermaid", "paperbanana"), known(d["render_target"], "mermaid")).otherwise(renderer(known(d["category"], ""), known(d["description"], "")))
    full = lambda d: F.struct(
        known(d["type"], "flowchart").alias("type"), known(d["title"], "Untitled Diagram").alias("title"), drawn(d).alias("render_target"), known(d["category"], "").alias("category"), known(d["description"], "").alias("description"),
        F.coalesce(d["nodes"], F.array().cast(NODES)).alias("nodes"), F.coalesce(d["edges"], F.array().cast(EDGES)).alias("edges"),
    )
    return F.coalesce(F.transform(raw, full), F.array().cast(TARGETS))


def routed(model: Column, *heuristic: Column) -> Column:
    """The model's targets where it names any, else those of the rules, in order."""
    return F.when(F.size(model) > 0, model).otherwise(F.concat(*heuristic))


def batch_input(phase: str, sections: Column, full: Column) -> Column:
    """What a phase of a batch run reads: its sections (a map by name), else parts of the whole text."""
    titled = lambda title, body: F.concat(F.lit(f"=== {title} ===\n"), body)
    named = F.concat_ws("\n\n", *(F.when(F.coalesce(sections[k], F.lit("")) != "", titled(k.title(), sections[k])) for k in PHASE_SECTIONS[phase]))
    n, half = F.length(full), F.floor(F.length(full) / 2).cast("int")
    if phase == "screening":
        parts = [titled("Beginning (Abstract area)", F.substring(full, 1, 2000)), F.when(n > 4000, titled("End (Conclusion area)", F.right(full, F.lit(2000))))]
    elif phase == "recipe":
        start = F.greatest(half - 3000, F.lit(0))
        parts = [titled("Method/Experimental (estimated)", F.substr(full, start + 1, F.least(n, half + 3000) - start))]
    else:
        parts = [titled("Introduction (estimated)", F.substring(full, 1, 3000)), F.when(n > 6000, titled("Results & Discussion (estimated)", F.substr(full, half + 1)))]
    return F.when(named != "", named).when(n > 0, F.concat_ws("\n\n", *parts)).otherwise("")


def words_joined(title: Column) -> Column:
    """A title as one name: word characters only, blanks and hyphens as one underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[^\w\s-]", "")), r"(?U)[-\s]+", "_")


def diagram_files(diagrams: DataFrame) -> DataFrame:
    """(paper_id, seq, file_name, content) of diagrams (paper_id, seq, title, description, code).

    Diagrams of a paper whose titles give one name get counters in order: name.md, name_1.md and so on; a counter that
    another title's name has already is left out, so no file overwrites another.
    """
    name = F.coalesce(F.nullif(F.lower(words_joined(F.col("title"))), F.lit("")), F.lit("diagram"))
    note = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("> "), "description", F.lit("\n\n"))).otherwise("")
    content = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), note, F.lit("```mermaid\n"), "code", F.lit("\n```\n"))
    named = free_names(diagrams.select("paper_id", "seq", name.alias("file_name"), content.alias("content")), "file_name", ["paper_id"], "seq")
    return named.withColumn("file_name", F.concat("file_name", F.lit(".md")))


def moved_folder(year: Column, title: Column, key: Column) -> Column:
    """The folder of a paper that is moved into the library: {year}_{title, 40 characters}, else paper_{key}."""
    safe = F.substring(words_joined(title), 1, 40)
    return F.when(safe != "", F.concat(F.coalesce(F.concat(year.cast("string"), F.lit("_")), F.lit("")), safe)).otherwise(F.concat(F.lit("paper_"), key.cast("string")))
