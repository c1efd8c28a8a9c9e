"""Queries of model calls and run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import backend
from folioforge.plans.library import COST_SQL, LIBRARY_SQL, papers, results
from folioforge.plans.registry import register
from folioforge.session import dropped_at_exit, shared_path, table, table_stream
from folioforge.sources import files
from folioforge.streaming import run_state

L = LIBRARY_SQL


def answered(prompt: str, rows: str, key: str, phase: str) -> str:
    """SQL of the stub's answers to prompts: JSON of a digest of the prompt, and what the call costs."""
    cost = COST_SQL.replace("model_used", "'gemini-3-flash-preview'")
    return f"""WITH p AS (SELECT {key} AS paper_id, {prompt} AS prompt FROM {rows}), h AS (SELECT *, sha256(prompt) AS h FROM p),
r AS (SELECT *, '{{"summary": "' || h[1:12] || '", "relevance_score": ' || (('0x' || h[1:2])::INT / 255::DOUBLE)::VARCHAR || '}}' AS result FROM h),
t AS (SELECT *, length(prompt) // 4 AS tokens_in, (length(result) + 12) // 4 AS tokens_out FROM r)
SELECT paper_id, '{phase}' AS phase, result, 'gemini-3-flash-preview' AS model_used, tokens_in::BIGINT AS tokens_in, tokens_out::BIGINT AS tokens_out, {cost} AS cost_usd, TIMESTAMP '2025-01-01' AS created_at FROM t"""


@register("str02_run_state", L + "SELECT paper_id, max(CASE phase WHEN 'screening' THEN 20 WHEN 'visual' THEN 40 WHEN 'recipe' THEN 60 WHEN 'deep_dive' THEN 80 WHEN 'visualization' THEN 100 ELSE 0 END)::INT AS progress, count(*) FILTER (phase IN ('screening', 'visual', 'recipe', 'deep_dive', 'visualization')) AS phases, round(sum(cost_usd::DECIMAL(20, 8)), 6)::DOUBLE AS cost_usd, bool_or(phase = 'cancel') AS cancelled FROM results GROUP BY paper_id")
def _(spark, sf):
    return run_state.run_state(results(spark, sf))


@register("str05_first_completions", L + "SELECT DISTINCT paper_id, phase FROM results")
def _(spark, sf):
    return run_state.first_completions(results(spark, sf)).select("paper_id", "phase")


#: Events as the log of runs: users are papers.
PHASE_OF_EVENT = {"view": "screening", "click": "recipe", "purchase": "visualization", "error": "cancel", "signup": "start"}
_PHASE_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PHASE_OF_EVENT.items()) + " END"
_OVER = "s.ended IS NOT NULL AND e.ts >= s.ended + INTERVAL 1 HOUR"


@register(
    "str03_run_expiry",
    f"""WITH RECURSIVE e AS (SELECT user_id AS paper_id, {_PHASE_SQL} AS phase, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, {_PHASE_SQL}) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
steps AS (
  SELECT DISTINCT paper_id, 0::BIGINT AS k, 0 AS progress, 'running' AS state, NULL::TIMESTAMP AS ended, false AS cancel, NULL::TIMESTAMP AS moment, NULL::INT AS lost, NULL::TIMESTAMP AS lost_at FROM e
  UNION ALL
  SELECT paper_id, k, progress, CASE WHEN NOT acts THEN state WHEN cancel THEN 'cancelled' WHEN progress = 100 THEN 'completed' ELSE 'running' END,
         CASE WHEN acts AND (cancel OR progress = 100) THEN ts ELSE ended END, cancel, CASE WHEN acts THEN ts END, lost, lost_at
  FROM (
    SELECT *, CASE WHEN acts AND NOT cancel THEN greatest(was, CASE phase WHEN 'screening' THEN 20 WHEN 'recipe' THEN 60 ELSE 100 END) ELSE was END AS progress
    FROM (
      SELECT paper_id, k, ts, phase, ended, state, CASE WHEN ended IS NULL AND phase = 'cancel' THEN true ELSE cancel END AS cancel, was, lost, lost_at, ended IS NULL AND phase NOT IN ('cancel', 'start') AS acts
      FROM (
        SELECT e.paper_id, e.k, e.ts, e.phase, anew, CASE WHEN NOT anew THEN s.ended END AS ended, CASE WHEN anew THEN 'running' ELSE s.state END AS state, NOT anew AND s.cancel AS cancel, CASE WHEN anew THEN 0 ELSE s.progress END AS was,
               CASE WHEN {_OVER} THEN s.progress END AS lost, CASE WHEN {_OVER} THEN s.ended + INTERVAL 1 HOUR END AS lost_at
        FROM (SELECT s.*, e.ts, ({_OVER}) OR (s.ended IS NOT NULL AND e.phase = 'start') AS anew FROM steps s JOIN e ON e.paper_id = s.paper_id AND e.k = s.k + 1) s JOIN e ON e.paper_id = s.paper_id AND e.k = s.k + 1
      )
    )
  )
),
rows AS (
  SELECT paper_id, progress, state, moment FROM steps WHERE moment IS NOT NULL
  UNION ALL SELECT paper_id, lost, 'expired', lost_at FROM steps WHERE lost_at IS NOT NULL
  UNION ALL SELECT paper_id, progress, 'expired', ended + INTERVAL 1 HOUR FROM (SELECT *, max(k) OVER (PARTITION BY paper_id) AS last FROM steps)
  WHERE k = last AND ended + INTERVAL 1 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)
)
SELECT paper_id, progress, state, count(*) AS n, epoch_ms(max(moment)) // 1000 AS last_second FROM rows GROUP BY ALL""",
)
def _(spark, sf):
    named = F.create_map(*(F.lit(x) for pair in PHASE_OF_EVENT.items() for x in pair))
    log = table_stream(spark, sf, "events").select(F.col("user_id").alias("paper_id"), F.try_element_at(named, F.col("event_type")).alias("phase"), "ts")
    changes = run_state.drained(run_state.live_runs(log), dropped_at_exit(spark, shared_path(spark, "runs")))
    return changes.groupBy("paper_id", "progress", "state").agg(F.count("*").alias("n"), run_state.shown_second(F.max("at")).alias("last_second"))


@register("udf01_phase_calls", answered("'Screen: ' || c_name", "customer", "c_custkey", "screening"))
def _(spark, sf):
    prompts = papers(spark, sf).select(F.col("id").alias("paper_id"), F.concat(F.lit("Screen: "), "title").alias("prompt"))
    return backend.phase_rows(backend.ask(prompts, [backend.Stub()]), "screening", "2025-01-01 00:00:00")


@register("udf03_model_fallback", "SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 5 > 0 THEN 'gemini-3-flash-preview' END AS model, c_custkey % 5 = 0 AS failed FROM customer")
def _(spark, sf):
    class Down(backend.Stub):
        def call(self, prompt):
            raise RuntimeError("down")

    prompts = papers(spark, sf).select(F.col("id").alias("paper_id"), F.concat(F.when(F.col("id") % 5 == 0, "FAIL ").otherwise(""), "title").alias("prompt"))
    answers = backend.ask(prompts, [Down("claude-sonnet-4-20250514"), backend.Stub()])
    return answers.select("paper_id", "model", F.col("error").isNotNull().alias("failed"))


@register("udf08_cached_explanations", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'cached' ELSE 'model' END AS source FROM part")
def _(spark, sf):
    figures = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p1_fig"), "p_partkey").alias("figure_num"), F.col("p_name").alias("caption"), F.when(F.col("p_partkey") % 2 == 0, "known").alias("detailed_explanation"))
    return backend.explanations(figures, [backend.Stub()]).select("id", "source")


@register("src15_media_types", "SELECT page_id, CASE WHEN ext IN ('png', 'gif', 'webp') THEN 'image/' || ext WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext = 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media FROM (SELECT page_id, ['png', 'JPG', 'gif', 'x', 'pdf'][page_id % 5 + 1] AS e, lower(e) AS ext FROM pages)")
def _(spark, sf):
    ending = F.element_at(F.array(*map(F.lit, ["png", "JPG", "gif", "x", "pdf"])), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", files.media_type(F.concat(F.lit("a.b/f."), ending)).alias("media"))


@register("src11_shadowed_profiles", "SELECT n_name AS name, 'user' AS origin FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'bundled' FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    user = names.where("n_nationkey % 2 = 0").select("name", F.lit("user").alias("origin"))
    return files.shadowed(user, names.select("name", F.lit("bundled").alias("origin")))


@register("snk05_text_cache", "SELECT doc_id, sha256(text)[1:16] AS hash, length(text) AS char_count FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", files.content_hash(F.col("text").cast("binary")).alias("hash"))
    return files.cache_rows(docs, "2025-01-01 00:00:00").select("doc_id", "hash", "char_count")


@register("udf05_batch_phases", answered("'Phase deep_dive' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '=== Introduction ===' || chr(10) || text ELSE CASE WHEN length(text) = 0 THEN '' ELSE '=== Introduction (estimated) ===' || chr(10) || text[1:3000] || CASE WHEN length(text) > 6000 THEN chr(10) || chr(10) || '=== Results & Discussion (estimated) ===' || chr(10) || text[length(text) // 2 + 1:] ELSE '' END END END", "documents", "doc_id", "deep_dive"))
def _(spark, sf):
    named = F.create_map(F.when(F.col("doc_id") % 2 == 0, "introduction").otherwise("other"), F.col("text"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), named.alias("sections"), F.col("text").alias("full_text"))
    return backend.batch_phase(docs, "deep_dive", [backend.Stub()], "2025-01-01 00:00:00")
