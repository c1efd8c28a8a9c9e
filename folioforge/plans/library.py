"""The library's tables as views of the driver's tables, in DataFrames and in DuckDB SQL.

A customer stands for a paper and an order for an analysis result; some results belong to no paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.cost import PRICES, call_cost
from folioforge.session import table

DOMAINS = ["optics", "materials", "bio", "energy", "quantum"]
STATUSES = ["pending", "analyzing", "completed", "error"]
PHASES = ["screening", "visual", "recipe", "deep_dive", "viz_plan", "visualization", "error"]
MODELS = ["gemini-3-flash-preview", "gemini-3-pro-preview", "claude-sonnet-4-20250514", "some-other-model"]


def _nth(values: list[str], i: str) -> str:
    """SQL that both engines read: the value of a zero-based index."""
    return "CASE " + " ".join(f"WHEN {i} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


PAPER_COLUMNS = {
    "id": "c_custkey",
    "title": "c_name",
    "authors": "CASE WHEN c_custkey % 11 <> 0 THEN concat('Author ', CAST(c_custkey % 97 AS {text})) END",
    "year": "CASE WHEN c_custkey % 7 <> 0 THEN CAST(1990 + c_custkey % 35 AS INT) END",
    "journal": "c_mktsegment",
    "domain": _nth(DOMAINS, "c_nationkey % 5"),
    "agent_used": _nth(["photon", "crystal", "helix"], "c_custkey % 3"),
    "tags": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('[\"t', CAST(c_custkey % 13 AS {text}), '\",\"', lower(c_mktsegment), '\"]') WHEN 2 THEN concat('t', CAST(c_custkey % 4 AS {text}), ', x,, y') WHEN 3 THEN 'solo' ELSE '' END",
    "status": _nth(STATUSES, "c_custkey % 4"),
    "notes": "CASE WHEN c_custkey % 9 = 0 THEN concat('100%_note ', c_mktsegment) END",
}

RESULT_COLUMNS = {
    "id": "o_orderkey",
    "paper_id": "CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey ELSE o_custkey END",
    "phase": _nth(PHASES, "o_orderkey % 7"),
    "result": "CASE o_orderkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN 'no json' WHEN 2 THEN '{{\"error\": \"e\"}}' WHEN 3 THEN '{{\"_parse_error\": \"p\", \"x\": 1}}' ELSE concat('{{\"summary\": \"s', CAST(o_orderkey % 10 AS {text}), '\", \"relevance\": 0.', CAST(o_orderkey % 10 AS {text}), ', \"key_topics\": [\"a\", \"b\"]}}') END",
    "model_used": "CASE WHEN o_orderkey % 23 <> 0 THEN " + _nth(MODELS, "o_orderkey % 4") + " END",
    "tokens_in": "o_orderkey * 7 % 100000",
    "tokens_out": "o_orderkey * 3 % 20000",
    "created_at": "o_orderdate",
}


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"{sql.format(text='STRING')} AS {name}" for name, sql in PAPER_COLUMNS.items()]
    created = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(c_custkey % 5000 AS INT) * 37) AS created_at"
    return table(spark, sf_dir, "customer").selectExpr(*columns, created)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"{sql.format(text='STRING')} AS {name}" for name, sql in RESULT_COLUMNS.items()]
    rows = table(spark, sf_dir, "orders").selectExpr(*columns)
    return rows.withColumn("cost_usd", call_cost(F.col("model_used"), F.col("tokens_in"), F.col("tokens_out")))


def _price(i: int) -> str:
    default = next(iter(PRICES.values()))
    return "CASE model_used " + " ".join(f"WHEN '{m}' THEN {p[i]}::DOUBLE" for m, p in PRICES.items()) + f" ELSE {default[i]}::DOUBLE END"


COST_SQL = f"round(tokens_in / 1000000 * {_price(0)} + tokens_out / 1000000 * {_price(1)}, 8)"
PAPERS_SQL = "papers AS (SELECT " + ", ".join(f"{sql.format(text='VARCHAR')} AS {name}" for name, sql in PAPER_COLUMNS.items()) + ", TIMESTAMP '2024-01-01' + to_minutes(c_custkey % 5000 * 37) AS created_at FROM customer)"
RESULTS_SQL = "results AS (SELECT *, " + COST_SQL + " AS cost_usd FROM (SELECT " + ", ".join(f"{sql.format(text='VARCHAR')} AS {name}" for name, sql in RESULT_COLUMNS.items()) + " FROM orders))"
LIBRARY_SQL = f"WITH {PAPERS_SQL}, {RESULTS_SQL} "
