"""Model calls as a pluggable backend: prompts are columns, answers are rows. Offline a deterministic stub answers."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.json_tools import valid_or_wrapped, without_fence
from folioforge.functions.viz_targets import batch_input
from folioforge.operators.cost import call_cost

ANSWER = "text string, model string, tokens_in long, tokens_out long, error string"
# Thinking budgets by effort.
BUDGETS = {"low": 1024, "medium": 4096, "high": 8192}


class Backend(Protocol):
    model: str

    def call(self, prompt: str) -> tuple[str, int, int]:
        """(text, tokens in, tokens out); raises on failure."""


class Stub:
    """Answers with JSON that depends on the prompt alone. Prompts that hold FAIL fail."""

    def __init__(self, model: str = "gemini-3-flash-preview"):
        self.model = model

    def call(self, prompt: str) -> tuple[str, int, int]:
        if "FAIL" in prompt:
            raise RuntimeError("refused")
        digest = hashlib.sha256(prompt.encode()).hexdigest()
        text = "```json\n" + json.dumps({"summary": digest[:12], "relevance_score": int(digest[:2], 16) / 255}) + "\n```"
        return text, len(prompt) // 4, len(text) // 4


def is_passing(error: Exception) -> bool:
    """Too many requests, a server's failure (``status`` of the error) or a lost connection: the next attempt may succeed."""
    status = getattr(error, "status", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or status == 429 or isinstance(status, int) and status >= 500


def with_retries(call: Callable[[], tuple], attempts: int = 3, wait: float = 1.0) -> tuple:
    """The call's result; after a failure that may pass another attempt, each after twice the wait."""
    for n in range(attempts):
        try:
            return call()
        except Exception as error:
            if n == attempts - 1 or not is_passing(error):
                raise
            time.sleep(wait * 2**n)
    raise AssertionError


def ask(prompts: DataFrame, backends: list[Backend], prompt: str = "prompt", at_once: int | None = None, wait: float = 1.0) -> DataFrame:
    """``prompts`` with the answer of the first backend that gives one: text, model, tokens_in, tokens_out, error.

    Rows are split so that at most ``at_once`` calls run together. A prompt that all backends fail has an error.
    """

    def answer(text: str) -> tuple:
        error = ""
        for b in backends:
            try:
                reply, n_in, n_out = with_retries(lambda b=b: b.call(text), wait=wait)
                return reply, b.model, n_in, n_out, None
            except Exception as e:  # noqa: BLE001 - any failure of one model is the next one's turn
                error = str(e)
        return None, None, 0, 0, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = pd.DataFrame([answer(t) for t in frame[prompt]], columns=["text", "model", "tokens_in", "tokens_out", "error"], index=frame.index)
            yield pd.concat([frame, replies], axis=1)

    source = prompts.repartition(at_once) if at_once else prompts
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return source.mapInPandas(run, f"{fields}, {ANSWER}")


def phase_rows(answers: DataFrame, phase: str, at: str) -> DataFrame:
    """Rows for the results table of one phase: cleaned JSON, cost; failures are rows of the phase ``error``."""
    failed = F.col("error").isNotNull()
    body = F.when(failed, F.to_json(F.struct("error"))).otherwise(valid_or_wrapped(without_fence(F.col("text"))))
    return answers.select("paper_id", F.when(failed, "error").otherwise(F.lit(phase)).alias("phase"), body.alias("result"), F.col("model").alias("model_used"), "tokens_in", "tokens_out", call_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")).alias("cost_usd"), F.lit(at).cast("timestamp_ntz").alias("created_at"))


def explanations(figures: DataFrame, backends: list[Backend]) -> DataFrame:
    """Stored explanations as they are; only figures without one are asked for."""
    stored = figures.where("detailed_explanation IS NOT NULL").withColumn("source", F.lit("cached"))
    open_ = figures.where("detailed_explanation IS NULL").withColumn("prompt", F.concat(F.lit("Explain "), "figure_num", F.lit(": "), F.coalesce("caption", F.lit(""))))
    asked = ask(open_, backends).withColumn("detailed_explanation", F.col("text")).withColumn("source", F.lit("model"))
    return stored.unionByName(asked.select(*stored.columns))


def batch_phase(papers: DataFrame, phase: str, backends: list[Backend], at: str) -> DataFrame:
    """Result rows of a phase of a batch run over (paper_id, sections, full_text): its input, the call, the stored answer."""
    prompts = papers.select("paper_id", F.concat(F.lit(f"Phase {phase}\n"), batch_input(phase, F.col("sections"), F.coalesce("full_text", F.lit("")))).alias("prompt"))
    return phase_rows(ask(prompts, backends), phase, at)
