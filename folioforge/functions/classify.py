"""Keyword classification in one scan, without join or shuffle: a topic's keywords by one pass of an automaton, others as literal expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.keywords import keyword_counts
from folioforge.functions.text import keyword_hits
from folioforge.functions.vocabulary import MERMAID_WORDS, PICTURE_KINDS, PICTURE_WORDS, RENDERERS, ROUTER_WORDS, TOPIC_AGENTS, TOPIC_WORDS

CONFIDENT, CLEAR = 0.7, 0.15


def _best(scores: dict[str, Column], default: str) -> Column:
    """The name of the highest score above zero; of ties the first declared."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    found = F.lit(default)
    for name in reversed(list(scores)):
        found = F.when((scores[name] == top) & (top > 0), F.lit(name)).otherwise(found)
    return found


def classify_topic(docs: DataFrame, text: str = "text", topics: dict[str, list[str]] = TOPIC_WORDS) -> DataFrame:
    """``docs`` with domain and agent: substring hits, each keyword once; nothing found is general."""
    named = docs.withColumn("_s", keyword_counts(topics)(F.col(text)))
    named = named.withColumn("domain", _best({d: F.col("_s")[i] for i, d in enumerate(topics)}, "general")).drop("_s")
    agents = F.create_map(*(F.lit(x) for pair in TOPIC_AGENTS.items() for x in pair))
    return named.withColumn("agent", F.coalesce(agents[F.col("domain")], F.lit(TOPIC_AGENTS["general"])))


def occurrences(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?iU)\b{re.escape(word)}\b"))


def classify_weighted(docs: DataFrame, title: str = "title", abstract: str = "abstract", domains: dict = ROUTER_WORDS) -> DataFrame:
    """``docs`` with score_<domain>, domain and confidence by counted whole words.

    Title hits count three times, weighted words twice; scores are taken against the best one, and few different
    words bound the confidence.
    """
    body = F.concat_ws("\n", title, abstract)
    scores, kinds = {}, {}
    for domain, (plain, weighted) in domains.items():
        found = [(occurrences(body, w), occurrences(F.col(title), w), factor) for words, factor in ((plain, 1), (weighted, 2)) for w in words]
        scores[domain] = reduce(lambda a, b: a + b, (b * k + t * (2 * k) for b, t, k in found)).cast("double")
        kinds[domain] = reduce(lambda a, b: a + b, ((b > 0).cast("int") for b, _, _ in found))
    held = docs.select("*", F.struct(*(s.alias(d) for d, s in scores.items())).alias("_s"), F.struct(*(k.alias(d) for d, k in kinds.items())).alias("_k"))
    top = F.greatest(*(F.col(f"_s.{d}") for d in domains))
    held = held.select("*", _best({d: F.col(f"_s.{d}") for d in domains}, "unknown").alias("domain"), *(F.round(F.coalesce(F.try_divide(F.col(f"_s.{d}"), top), F.lit(0.0)), 6).alias(f"score_{d}") for d in domains))
    n = reduce(lambda a, d: F.when(F.col("domain") == d, F.col(f"_k.{d}")).otherwise(a), domains, F.lit(0))
    cap = F.when(n <= 1, 0.4).when(n <= 2, 0.6).otherwise(1.0)
    return held.withColumn("confidence", F.when(F.col("domain") == "unknown", 0.0).otherwise(F.round(cap, 3))).drop("_s", "_k")


def decide(keyword: Column, confidence: Column, gap: Column, semantic: Column, semantic_confidence: Column) -> Column:
    """struct(domain, confidence, method, needs_confirmation) of the two classifiers' answers."""
    made = lambda d, c, m, n: F.struct(d.alias("domain"), F.round(c, 3).alias("confidence"), F.lit(m).alias("method"), n.alias("needs_confirmation"))
    sure = (confidence >= CONFIDENT) & (gap >= CLEAR)
    both = F.least(F.lit(1.0), (confidence + semantic_confidence) / 2 + 0.15)
    lowered = semantic_confidence * 0.85
    return (
        F.when(sure | semantic.isNull(), made(keyword, confidence, "keyword", ~sure))
        .when(keyword == semantic, made(semantic, both, "semantic", F.lit(False)))
        .when(semantic_confidence > confidence, made(semantic, lowered, "semantic", lowered < CONFIDENT))
        .when((keyword != "unknown") & (confidence > 0), made(keyword, confidence, "keyword", F.lit(True)))
        .otherwise(made(F.lit("unknown"), F.lit(0.0), "keyword", F.lit(True)))
    )


def renderer(category: Column, description: Column) -> Column:
    """By category where it is known, else by keywords; ties are drawn as text."""
    known = F.when(category.isin(RENDERERS["mermaid"]), "mermaid").when(category.isin(RENDERERS["paperbanana"]), "paperbanana")
    drawn, pictured = (keyword_hits(description, w, acronyms=False) for w in (MERMAID_WORDS, PICTURE_WORDS))
    return F.coalesce(known, F.when(pictured > drawn, "paperbanana").otherwise("mermaid"))


def picture_kind(category: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in PICTURE_KINDS.items() for x in pair))
    return F.coalesce(kinds[category], F.lit("METHODOLOGY"))


def domain_sizes(spark) -> DataFrame:
    """(domain, keyword_count) of the weighted classifier."""
    return spark.createDataFrame([(d, len(a) + len(b)) for d, (a, b) in ROUTER_WORDS.items()], "domain string, keyword_count long")
