"""Cost and usage analytics over model calls. Each is one aggregation of one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.relational import latest, month_range, not_errors, with_titles
from folioforge.schemas import MAIN_PHASES, VIZ_PHASES

# USD for a million tokens (input, output) by model; unknown models count as the first.
PRICES = {
    "gemini-3-flash-preview": (0.10, 0.40),
    "gemini-3-pro-preview": (1.25, 5.00),
    "gemini-3-pro-image-preview": (1.25, 5.00),
    "gemini-2.0-flash": (0.10, 0.40),
    "claude-sonnet-4-20250514": (3.00, 15.00),
    "claude-sonnet-4-5-20250929": (3.00, 15.00),
}
WARNING_SHARE = 0.8


def call_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """USD of one call, 8 decimals; a literal case expression, no join."""
    default = next(iter(PRICES.values()))

    def price(i: int) -> Column:
        found = F.lit(default[i])
        for name, prices in PRICES.items():
            found = F.when(model == name, F.lit(prices[i])).otherwise(found)
        return found

    million = 1_000_000
    return F.round(F.coalesce(tokens_in, F.lit(0)) / million * price(0) + F.coalesce(tokens_out, F.lit(0)) / million * price(1), 8)


def exact(column: Column | str) -> Column:
    """Costs have eight decimals: sums of decimals do not depend on the order of the rows."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(20,8)"))


def money(column: Column | str, places: int) -> Column:
    return F.round(F.coalesce(exact(column), F.lit(0).cast("decimal(20,8)")), places).cast("double")


def usage(results: DataFrame) -> DataFrame:
    """Calls, tokens and cost by phase."""
    return results.groupBy("phase").agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), money("cost_usd", 6).alias("cost_usd"))


def breakdown(results: DataFrame) -> DataFrame:
    """Cost of each paper in total, by phase and by model: grouping sets in one pass."""
    total = F.when((F.grouping("phase") == 1) & (F.grouping("model_used") == 1), "total").when(F.grouping("phase") == 0, "phase").otherwise("model")
    sets = results.groupingSets([["paper_id"], ["paper_id", "phase"], ["paper_id", "model_used"]], "paper_id", "phase", "model_used")
    return sets.agg(total.alias("kind"), money("cost_usd", 6).alias("cost_usd")).select("paper_id", "kind", F.coalesce("phase", "model_used", F.lit("")).alias("name"), "cost_usd")


def month_report(results: DataFrame, month: str, include_errors: bool = True) -> DataFrame:
    """Long form (kind, name, cost, calls) of a month: total, by model, by phase, by day."""
    rows = results.where(month_range("created_at", month))
    rows = rows if include_errors else not_errors(rows)
    day = rows.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.coalesce("model_used", F.lit("unknown")).alias("model"), "phase", "cost_usd")
    kind = F.when(F.grouping("day") == 0, "day").when(F.grouping("model") == 0, "model").when(F.grouping("phase") == 0, "phase").otherwise("total")
    sets = day.groupingSets([[], ["day"], ["model"], ["phase"]], "day", "model", "phase")
    return sets.agg(kind.alias("kind"), money("cost_usd", 6).alias("cost_usd"), F.count("*").alias("calls")).select("kind", F.coalesce("day", "model", "phase", F.lit("")).alias("name"), "cost_usd", "calls")


def month_spine(spark, anchor: str, months: int = 6, legacy: bool = False) -> DataFrame:
    """The last months up to the anchor's, as YYYY-MM. ``legacy``: steps of 30 days, which can repeat or skip a month."""
    back = spark.range(months - 1, -1, -1).select(F.col("id").cast("int").alias("i"))
    day = F.date_sub(F.to_date(F.lit(anchor)), F.col("i") * 30) if legacy else F.add_months(F.to_date(F.lit(anchor)), -F.col("i"))
    return back.select(F.col("i").alias("back"), F.date_format(day, "yyyy-MM").alias("month"))


def trend(results: DataFrame, anchor: str, months: int = 6, legacy: bool = False) -> DataFrame:
    """Total cost, papers and cost by model of the last months; months without rows are there with zeros."""
    spine = month_spine(results.sparkSession, anchor, months, legacy)
    first = F.add_months(F.to_date(F.lit(anchor)), -(months + 1)).cast("timestamp_ntz")
    rows = not_errors(results).where(F.col("created_at") >= first)
    rows = rows.select(F.date_format("created_at", "yyyy-MM").alias("month"), F.coalesce("model_used", F.lit("unknown")).alias("model"), "paper_id", "cost_usd")
    whole = rows.groupBy("month").agg(money("cost_usd", 4).alias("total"), F.countDistinct("paper_id").alias("papers"))
    models = rows.groupBy("month", "model").agg(money("cost_usd", 4).alias("cost")).groupBy("month").agg(F.sort_array(F.collect_list(F.struct("model", "cost"))).alias("pairs"))
    both = spine.join(whole, "month", "left").join(models, "month", "left")
    text = F.array_join(F.transform("pairs", lambda p: F.concat(p["model"], F.lit("="), F.format_string("%.4f", p["cost"]))), ",")
    return both.select("back", "month", F.coalesce("total", F.lit(0.0)).alias("total_cost"), F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce(text, F.lit("")).alias("by_model"))


def top_papers(results: DataFrame, papers: DataFrame, n: int = 20) -> DataFrame:
    """The papers of highest cost with the cost of each phase. Aggregated before the join; a top-k plan."""
    phases = [money_of(p) for p in (*MAIN_PHASES, *VIZ_PHASES)]
    by = not_errors(results).groupBy("paper_id").agg(money("cost_usd", 4).alias("total_cost"), *phases)
    return with_titles(by.orderBy(F.col("total_cost").desc(), "paper_id").limit(n), papers)


def money_of(phase: str) -> Column:
    return money(F.when(F.col("phase") == phase, F.col("cost_usd")), 4).alias(f"cost_{phase}")


def budget(results: DataFrame, month: str, limit: float) -> DataFrame:
    """Spend of a month against its limit; a run is refused once the limit is reached."""
    spent = results.where(month_range("created_at", month)).agg(money("cost_usd", 4).alias("spent"))
    return spent.select("spent", F.lit(limit).alias("budget"), F.round(F.lit(limit) - F.col("spent"), 4).alias("remaining"), F.lit(WARNING_SHARE).alias("warning_threshold"), (F.col("spent") >= limit).alias("refused"), F.least(F.lit(100.0), F.round(F.col("spent") / limit * 100, 2)).alias("percent"))


def status_totals(results: DataFrame) -> DataFrame:
    """Cost and tokens of the latest row of each main phase."""
    last = latest(results.where(F.col("phase").isin(MAIN_PHASES)), ["paper_id", "phase"], ["created_at", "id"])
    return last.groupBy("paper_id").agg(money("cost_usd", 6).alias("cost_usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def report_totals(results: DataFrame) -> DataFrame:
    """Cost and tokens of all rows that are no errors."""
    return not_errors(results).groupBy("paper_id").agg(money("cost_usd", 6).alias("cost_usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def progress(results: DataFrame) -> DataFrame:
    """Percent done: four main phases make 80, a visualization the rest."""
    main = F.size(F.array_intersect(F.collect_set("phase"), F.array(*map(F.lit, MAIN_PHASES))))
    drawn = F.bool_or(F.col("phase").isin(VIZ_PHASES))
    return results.groupBy("paper_id").agg(F.least(F.lit(100), (main * 20 + F.when(drawn, 20).otherwise(0))).cast("int").alias("progress"), F.array_join(F.sort_array(F.collect_set("phase")), ",").alias("phases"))


def run_outcome(results: DataFrame) -> DataFrame:
    """A run is an error if all its phases are."""
    return results.groupBy("paper_id").agg(F.when(F.bool_and(F.col("phase") == "error"), "error").otherwise("completed").alias("outcome"), money("cost_usd", 6).alias("cost_usd"))


def statistics(papers: DataFrame, results: DataFrame) -> DataFrame:
    """The library's figures in long form (metric, name, value)."""
    sets = papers.groupingSets([[], ["status"], ["domain"], ["agent_used"], ["year"]], "status", "domain", "agent_used", "year")
    kind = F.when(F.grouping("status") == 0, "status").when(F.grouping("domain") == 0, "domain").when(F.grouping("agent_used") == 0, "agent").when(F.grouping("year") == 0, "year").otherwise("papers")
    counts = sets.agg(kind.alias("metric"), F.count("*").cast("double").alias("value")).select("metric", F.coalesce("status", "domain", "agent_used", F.col("year").cast("string"), F.lit("")).alias("name"), "value")
    counts = counts.where("NOT (metric = 'year' AND name = '')")
    sums = results.agg(money("cost_usd", 8).alias("c"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("i"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("o"), F.countDistinct("paper_id").alias("n"))
    pairs = [("total_cost", F.round("c", 4)), ("tokens_in", F.col("i").cast("double")), ("tokens_out", F.col("o").cast("double")), ("analyzed", F.col("n").cast("double")), ("avg_cost", F.round(F.coalesce(F.try_divide("c", "n"), F.lit(0.0)), 4))]
    long = sums.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit("").alias("name"), v.alias("value")) for m, v in pairs))).alias("x")).select("x.*")
    return counts.union(long)


def bars(df: DataFrame, value: str) -> DataFrame:
    """Bar heights against the largest value: aggregated apart, not a global window."""
    most = df.agg(F.greatest(F.max(value), F.lit(0.01)).alias("_most"))
    return df.crossJoin(F.broadcast(most)).withColumn("bar", F.greatest(F.lit(4), F.round(F.col(value) / F.col("_most") * 100)).cast("int")).drop("_most")
