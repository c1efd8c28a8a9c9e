"""Queries of cost, usage and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import cost
from folioforge.operators.relational import with_titles
from folioforge.plans.library import LIBRARY_SQL, papers, results
from folioforge.plans.q_library import TAGS_SQL
from folioforge.plans.registry import register
from folioforge.functions.json_tools import parse_tags
from folioforge.schemas import MAIN_PHASES, VIZ_PHASES
from folioforge.session import table

L = LIBRARY_SQL
ALL_PHASES = [*MAIN_PHASES, *VIZ_PHASES]


@register("mth01_call_cost", L + "SELECT id, cost_usd FROM results")
def _(spark, sf):
    return results(spark, sf).select("id", "cost_usd")


@register("agg02_group_counts", L + "SELECT domain, count(*) AS n FROM papers GROUP BY domain")
def _(spark, sf):
    return papers(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))


@register("agg07_statistics", L + """SELECT 'papers' AS metric, '' AS name, count(*)::DOUBLE AS value FROM papers
UNION ALL SELECT 'status', status, count(*) FROM papers GROUP BY status UNION ALL SELECT 'domain', domain, count(*) FROM papers GROUP BY domain
UNION ALL SELECT 'agent', agent_used, count(*) FROM papers GROUP BY agent_used UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM papers WHERE year IS NOT NULL GROUP BY year
UNION ALL SELECT 'total_cost', '', round(coalesce(sum(cost_usd::DECIMAL(20, 8)), 0), 4)::DOUBLE FROM results UNION ALL SELECT 'tokens_in', '', sum(tokens_in) FROM results UNION ALL SELECT 'tokens_out', '', sum(tokens_out) FROM results
UNION ALL SELECT 'analyzed', '', count(DISTINCT paper_id) FROM results UNION ALL SELECT 'avg_cost', '', round(sum(cost_usd::DECIMAL(20, 8))::DOUBLE / count(DISTINCT paper_id), 4) FROM results""")
def _(spark, sf):
    return cost.statistics(papers(spark, sf), results(spark, sf))


@register("agg06_cost_over_all_papers", L + "SELECT round((SELECT sum(cost_usd::DECIMAL(20, 8))::DOUBLE FROM results WHERE phase <> 'error') / (SELECT count(*) FROM papers), 4) AS avg_cost")
def _(spark, sf):
    total = results(spark, sf).where("phase <> 'error'").agg(cost.money("cost_usd", 8).alias("c"))
    return total.crossJoin(F.broadcast(papers(spark, sf).agg(F.count("*").alias("n")))).select(F.round(F.coalesce(F.try_divide("c", "n"), F.lit(0.0)), 4).alias("avg_cost"))


TREND_SQL = """
months AS (SELECT i AS back, strftime({day}, '%Y-%m') AS month FROM range(0, 6) t(i)),
rows_ AS (SELECT strftime(created_at, '%Y-%m') AS month, coalesce(model_used, 'unknown') AS model, paper_id, cost_usd FROM results WHERE phase <> 'error'),
whole AS (SELECT month, round(sum(cost_usd::DECIMAL(20, 8)), 4)::DOUBLE AS total_cost, count(DISTINCT paper_id) AS papers FROM rows_ GROUP BY month),
models AS (SELECT month, string_agg(model || '=' || printf('%.4f', c), ',' ORDER BY model) AS by_model FROM (SELECT month, model, round(sum(cost_usd::DECIMAL(20, 8)), 4)::DOUBLE AS c FROM rows_ GROUP BY ALL) GROUP BY month)
SELECT m.back, m.month, coalesce(total_cost, 0) AS total_cost, coalesce(papers, 0) AS papers, coalesce(by_model, '') AS by_model
FROM months m LEFT JOIN whole USING (month) LEFT JOIN models USING (month)"""


@register("agg08_month_trend", L.rstrip() + ", " + TREND_SQL.format(day="DATE '1999-03-31' - to_months(i::INT)"))
def _(spark, sf):
    return cost.trend(results(spark, sf), "1999-03-31")


@register("dat02_trend_in_30_day_steps", L.rstrip() + ", " + TREND_SQL.format(day="DATE '1999-03-31' - (30 * i)::INT"))
def _(spark, sf):
    return cost.trend(results(spark, sf), "1999-03-31", legacy=True)


TOP_SQL = "SELECT paper_id, round(sum(cost_usd::DECIMAL(20, 8)), 4)::DOUBLE AS total_cost, " + ", ".join(f"round(coalesce(sum(cost_usd::DECIMAL(20, 8)) FILTER (phase = '{p}'), 0), 4)::DOUBLE AS cost_{p}" for p in ALL_PHASES) + " FROM results WHERE phase <> 'error' GROUP BY paper_id ORDER BY total_cost DESC, paper_id LIMIT 20"


@register("agg09_top_papers_by_cost", L + f"SELECT t.*, coalesce(p.title, 'Paper ' || t.paper_id) AS title FROM ({TOP_SQL}) t LEFT JOIN papers p ON p.id = t.paper_id")
def _(spark, sf):
    return cost.top_papers(results(spark, sf), papers(spark, sf))


@register("agg10_budget", L + "SELECT s AS spent, 5.0::DOUBLE AS budget, round(5.0::DOUBLE - s, 4) AS remaining, 0.8::DOUBLE AS warning_threshold, s >= 5.0::DOUBLE AS refused, least(100.0::DOUBLE, round(s / 5.0::DOUBLE * 100, 2)) AS percent FROM (SELECT round(coalesce(sum(cost_usd::DECIMAL(20, 8)), 0), 4)::DOUBLE AS s FROM results WHERE created_at >= TIMESTAMP '1998-12-01' AND created_at < TIMESTAMP '1999-01-01')")
def _(spark, sf):
    return cost.budget(results(spark, sf), "1998-12", 5.0)


@register("agg12_cost_breakdown", L + """SELECT paper_id, 'total' AS kind, '' AS name, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS cost_usd FROM results GROUP BY paper_id
UNION ALL SELECT paper_id, 'phase', phase, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE FROM results GROUP BY paper_id, phase UNION ALL SELECT paper_id, 'model', coalesce(model_used, ''), round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE FROM results GROUP BY paper_id, model_used""")
def _(spark, sf):
    return cost.breakdown(results(spark, sf))


@register("agg13_month_report", L.rstrip() + """, m AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day, coalesce(model_used, 'unknown') AS model FROM results WHERE created_at >= TIMESTAMP '1998-12-01' AND created_at < TIMESTAMP '1999-01-01')
SELECT 'total' AS kind, '' AS name, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS cost_usd, count(*) AS calls FROM m UNION ALL SELECT 'day', day, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE, count(*) FROM m GROUP BY day
UNION ALL SELECT 'model', model, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE, count(*) FROM m GROUP BY model UNION ALL SELECT 'phase', phase, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE, count(*) FROM m GROUP BY phase""")
def _(spark, sf):
    return cost.month_report(results(spark, sf), "1998-12")


@register("agg14_tag_frequencies", L + f"SELECT tag, count(*) AS n FROM (SELECT unnest({TAGS_SQL}) AS tag FROM papers) GROUP BY tag")
def _(spark, sf):
    tags = papers(spark, sf).where("tags IS NOT NULL AND tags <> ''").select("id", F.explode(parse_tags(F.col("tags"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").drop("first")


@register("agg15_usage_by_phase", L + "SELECT phase, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS cost_usd FROM results GROUP BY phase")
def _(spark, sf):
    return cost.usage(results(spark, sf))


@register("agg16_run_outcome", L + "SELECT paper_id, CASE WHEN bool_and(phase = 'error') THEN 'error' ELSE 'completed' END AS outcome, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS cost_usd FROM results GROUP BY paper_id")
def _(spark, sf):
    return cost.run_outcome(results(spark, sf))


@register("agg17_status_totals", L + "SELECT paper_id, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS cost_usd, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, phase ORDER BY created_at DESC, id DESC) AS n FROM results WHERE phase IN ('screening', 'visual', 'recipe', 'deep_dive')) WHERE n = 1 GROUP BY paper_id")
def _(spark, sf):
    return cost.status_totals(results(spark, sf))


@register("agg18_report_totals", L + "SELECT paper_id, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS cost_usd, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM results WHERE phase <> 'error' GROUP BY paper_id")
def _(spark, sf):
    return cost.report_totals(results(spark, sf))


@register("agg19_progress", L + "SELECT paper_id, least(100, count(DISTINCT phase) FILTER (phase IN ('screening', 'visual', 'recipe', 'deep_dive')) * 20 + CASE WHEN bool_or(phase IN ('viz_plan', 'visualization')) THEN 20 ELSE 0 END)::INT AS progress, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases FROM results GROUP BY paper_id")
def _(spark, sf):
    return cost.progress(results(spark, sf))


@register("agg22_argmax_by_declared_order", "SELECT c_nationkey AS doc, arg_min(c_mktsegment, (-n, c_mktsegment)) AS best FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def _(spark, sf):
    scores = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").count()
    return scores.groupBy(F.col("c_nationkey").alias("doc")).agg(F.min_by("c_mktsegment", F.struct(-F.col("count"), F.col("c_mktsegment"))).alias("best"))


@register("agg25_union_boxes", "SELECT c_nationkey AS grp, min(c_acctbal) AS x0, min(c_custkey) AS y0, max(c_acctbal) AS x1, max(c_custkey) AS y1 FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.min("c_acctbal").alias("x0"), F.min("c_custkey").alias("y0"), F.max("c_acctbal").alias("x1"), F.max("c_custkey").alias("y1"))


@register("agg26_distinct_tags", L + "SELECT DISTINCT trim(t) AS tag FROM (SELECT unnest(string_split(tags, ',')) AS t FROM papers) WHERE trim(t) <> ''")
def _(spark, sf):
    return papers(spark, sf).select(F.explode(F.transform(F.split("tags", ","), lambda t: F.trim(t))).alias("tag")).where("tag <> ''").distinct().orderBy("tag")


@register("agg27_chart_bars", L + "SELECT phase, c AS cost_usd, greatest(4, round(c / (SELECT greatest(max(s), 0.01) FROM (SELECT round(sum(cost_usd::DECIMAL(20, 8)), 4)::DOUBLE AS s FROM results GROUP BY phase)) * 100))::INT AS bar FROM (SELECT phase, round(sum(cost_usd::DECIMAL(20, 8)), 4)::DOUBLE AS c FROM results GROUP BY phase)")
def _(spark, sf):
    by = results(spark, sf).groupBy("phase").agg(cost.money("cost_usd", 4).alias("cost_usd"))
    return cost.bars(by, "cost_usd")


@register("agg28_backfill_counts", L + "SELECT count(*) FILTER (notes IS NULL) AS updated, count(*) AS processed FROM papers")
def _(spark, sf):
    return papers(spark, sf).agg(F.count_if(F.col("notes").isNull()).alias("updated"), F.count("*").alias("processed"))


@register("map01_cost_map", L + "SELECT paper_id, string_agg(phase || ':' || printf('%.6f', c), ',' ORDER BY phase) AS by_phase FROM (SELECT paper_id, phase, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS c FROM results GROUP BY ALL) GROUP BY paper_id")
def _(spark, sf):
    by = results(spark, sf).groupBy("paper_id", "phase").agg(cost.exact("cost_usd").alias("c")).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "c"))).alias("m"))
    rounded = F.transform_values("m", lambda _, v: F.round(v, 6).cast("double"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(rounded)), lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.6f", e["value"]))), ",")
    return by.select("paper_id", text.alias("by_phase"))


@register("dat01_month_key", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@register("dat04_duration", "SELECT user_id, coalesce(epoch(max(ts)) - epoch(min(ts)), 0)::BIGINT AS seconds FROM events GROUP BY user_id")
def _(spark, sf):
    ends = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    return ends.select("user_id", F.coalesce(F.round(seconds / 1e6), F.lit(0)).cast("long").alias("seconds"))


@register("m0_account_costs", "SELECT o_custkey AS paper_id, coalesce(c_name, 'Paper ' || o_custkey) AS title, round(sum(o_totalprice), 2) AS total, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS done FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = o_custkey GROUP BY ALL ORDER BY total DESC, paper_id LIMIT 20")
def _(spark, sf):
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0)), 2).alias("done"))
    names = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return with_titles(by.orderBy(F.desc("total"), "paper_id").limit(20), names)
