"""Queries of what models answer and of its upkeep, over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import hints
from folioforge.functions import model_json as mj
from folioforge.operators import captions
from folioforge.plans.library import LIBRARY_SQL, papers
from folioforge.plans.registry import register
from folioforge.session import table

PART = "p_partkey"


@register("jsn04_nested_or_flat", "SELECT p_partkey, p_name AS title FROM part")
def _(spark, sf):
    inner = F.to_json(F.struct(F.col("p_name").alias("title")))
    answer = F.when(F.col(PART) % 2 == 0, F.concat(F.lit('{"recipe": '), inner, F.lit("}"))).otherwise(inner)
    return table(spark, sf, "part").select(PART, mj.nested_or_flat(answer, "recipe", "title").alias("title"))


@register("jsn07_subfigures", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE p_brand END AS label, 0.0::DOUBLE AS x, CASE WHEN p_partkey % 3 = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w, CASE WHEN p_partkey % 3 = 2 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM part WHERE p_partkey % 5 > 0")
def _(spark, sf):
    label = F.concat(F.lit('"label": "'), "p_brand", F.lit('"'))
    body = F.when(F.col(PART) % 3 == 0, F.lit("")).when(F.col(PART) % 3 == 1, F.concat(label, F.lit(', "bbox": [0.0, 0.0, 0.5, 1.0]'))).otherwise(F.concat(label, F.lit(', "confidence": 0.9')))
    answer = F.when(F.col(PART) % 5 > 0, F.concat(F.lit("[{"), body, F.lit("}]"))).otherwise("no JSON")
    return table(spark, sf, "part").select(PART, F.inline(mj.subfigures(answer))).select(PART, "label", "x", "w", "confidence")


@register("jsn09_picture_plans", "SELECT p_partkey, CASE WHEN p_size = 0 OR p_partkey % 7 = 0 THEN 1 ELSE least(p_size, 5) END::INT AS n, CASE WHEN p_size = 0 OR p_partkey % 7 = 0 THEN 'Overview' ELSE p_brand END AS first_title FROM part")
def _(spark, sf):
    items = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.struct(i.cast("string").alias("id"), F.col("p_brand").alias("title")))
    answer = F.when((F.col("p_size") == 0) | (F.col(PART) % 7 == 0), "sorry").otherwise(F.to_json(items))
    return table(spark, sf, "part").select(PART, mj.picture_plan(answer).alias("p")).select(PART, F.size("p").alias("n"), F.col("p")[0]["title"].alias("first_title"))


@register("jsn11_token_usage", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE user_id END::BIGINT AS n_in, CASE WHEN event_id % 4 = 3 THEN 0 ELSE event_id END::BIGINT AS n_out FROM events")
def _(spark, sf):
    names = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in (("input_tokens", "output_tokens"), ("prompt_token_count", "candidates_token_count"), ("tokens_in", "tokens_out"), ("other", "names"))))
    name = lambda i: names[(F.col("event_id") % 4).cast("int")][i]
    answer = F.concat(F.lit('{"'), name(0), F.lit('": '), "user_id", F.lit(', "'), name(1), F.lit('": '), "event_id", F.lit("}"))
    n_in, n_out = mj.token_usage(answer)
    return table(spark, sf, "events").select("event_id", n_in.alias("n_in"), n_out.alias("n_out"))


@register("arr04_joined_parts", "SELECT doc_id, array_to_string([x FOR x IN string_split(text, chr(10)) IF x <> ''], chr(10)) AS body FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mj.joined_parts(F.split("text", "\n")).alias("body"))


@register("srt05_plan_order", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice, o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def _(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("plan"), F.collect_list(F.struct(F.col("o_orderkey").alias("id"))).alias("items"))
    done = mj.in_plan_order(F.col("items"), F.col("plan.o_orderkey"))
    return orders.select("o_custkey", F.array_join(F.transform(done, lambda x: x["id"].cast("string")), ",").alias("ids"))


@register("src13_key_precedence", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE 'config' END AS api_key FROM documents")
def _(spark, sf):
    environment = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    settings = F.when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise(" ")
    return table(spark, sf, "documents").select("doc_id", mj.resolved(environment, settings, F.lit("config")).alias("api_key"))


@register("txt26_output_dirs", "SELECT doc_id, '2024_' || regexp_replace(trim(source), '[^A-Za-z0-9]+', '_', 'g')[1:40] || '_' || regexp_replace(trim(text), '[^A-Za-z0-9]+', '_', 'g')[1:30] AS folder FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mj.output_dir(F.lit(2024), F.concat_ws(" ", F.lit("Ada"), "source"), F.col("text")).alias("folder"))


@register(
    "dml08_caption_backfill",
    "SELECT c_custkey AS doc_id, n AS number, CASE WHEN c_custkey % 3 = n - 1 THEN 'known' WHEN n = 3 THEN '' WHEN n = 1 THEN 'Setup of ' || c_mktsegment ELSE 'Result ' || c_custkey END AS caption, n < 3 AND c_custkey % 3 <> n - 1 AS filled FROM customer, (VALUES (1), (2), (3)) v(n)",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    page = F.concat(F.lit("x\nFig. 1. Setup of "), "c_mktsegment", F.lit("\nFigure 2:\nResult "), F.col("doc_id").cast("string"))
    figures = rows.select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("number")).withColumn("caption", F.when(F.col("doc_id") % 3 == F.col("number") - 1, "known").otherwise(""))
    return captions.backfilled(figures, rows.select("doc_id", F.lit(1).alias("page_no"), page.alias("text")))


@register("jon10_subcaption_lookup", "SELECT o_orderkey, min(l_linenumber)::VARCHAR AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = CASE WHEN o_orderkey % 2 = 0 THEN 'R' ELSE 'A' END GROUP BY o_orderkey")
def _(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("pos"), F.lower("l_returnflag").alias("label"), F.col("l_linenumber").cast("string").alias("text"))
    wanted = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "r").otherwise("A").alias("label"))
    return captions.sub_captions(wanted, parts, "o_orderkey").select("o_orderkey", F.col("text").alias("line"))


_HINTS_SQL = "CASE " + " ".join("WHEN domain IN (" + ", ".join(f"'{n}'" for n in names) + ") THEN '" + hints.HINT_HEAD.format(title) + p + "'" for names, (title, p) in hints.DOMAIN_PARAMETERS.items()) + f" ELSE '{hints.ANY_HINT}' END"


@register("udf11_domain_hints", LIBRARY_SQL + f"SELECT id, {_HINTS_SQL} AS hint FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'other' WHEN id % 5 = 0 THEN 'volt' ELSE domain END AS domain FROM papers)")
def _(spark, sf):
    domain = F.when(F.col("id") % 7 == 0, "other").when(F.col("id") % 5 == 0, "volt").otherwise(F.col("domain"))
    return papers(spark, sf).select("id", hints.domain_hint(domain).alias("hint"))


_DOMAINS = ["optics", "biology", "neural", "crystal", "energy", "quantum", "none"]
_TAILS = ["", " Laser power and pulse duration", " cell viability: magnification", " Batch size, epochs", " the FWHM and film thickness", " Fill factor. bandgap", " error rate of detuning"]
_NAMED_SQL = "CASE domain " + " ".join(f"WHEN '{d}' THEN [n[2] FOR n IN [" + ", ".join(f"['{w}', '{n}']" for w, n in hints.parameter_words(p).items()) + "] IF contains(lower(t), n[1])]" for d, (_, p) in zip(_DOMAINS, hints.DOMAIN_PARAMETERS.values())) + " ELSE [] END"


@register("udf11_mentioned_parameters", f"SELECT doc_id, domain, array_to_string({_NAMED_SQL}, ', ') AS parameters FROM (SELECT doc_id, {_DOMAINS!r}[doc_id % 7 + 1] AS domain, text || {_TAILS!r}[doc_id // 7 % 7 + 1] AS t FROM documents)")
def _(spark, sf):
    nth = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", nth(_DOMAINS, F.col("doc_id") % 7).alias("domain"), F.concat("text", nth(_TAILS, F.floor(F.col("doc_id") / 7) % 7)).alias("text"))
    return hints.mentioned_parameters(docs).select("doc_id", "domain", F.array_join("parameters", ", ").alias("parameters"))
