"""State of analysis runs from a log of phase events; each operator takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from folioforge.operators.cost import money

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Progress that a finished phase stands for.
PROGRESS = {"screening": 20, "visual": 40, "recipe": 60, "deep_dive": 80, "visualization": 100}


def run_state(events: DataFrame) -> DataFrame:
    """(paper_id, progress, phases, cost_usd, cancelled) so far. A stream of it runs in update or complete mode."""
    reached = F.lit(0)
    for phase, percent in PROGRESS.items():
        reached = F.when(F.col("phase") == phase, percent).otherwise(reached)
    return events.groupBy("paper_id").agg(F.max(reached).alias("progress"), F.count_if(F.col("phase").isin(list(PROGRESS))).alias("phases"), money("cost_usd", 6).alias("cost_usd"), F.bool_or(F.col("phase") == "cancel").alias("cancelled"))


def first_completions(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Each phase of a run once, so that what hangs on it is fetched once. ``lateness`` bounds a stream's state."""
    if lateness:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["paper_id", "phase"])
    return events.dropDuplicates(["paper_id", "phase"])


CHANGE = Row("paper_id", "progress", "state", "at")


class RunProcessor(StatefulProcessor):
    """One run a key: its progress and status, a cancel request, and a timer that forgets it after it has ended.

    A cancel request takes effect at the next phase (phases are not interrupted); an ended run ignores events until
    it is forgotten or started anew; a running one cannot be started. The rows of a batch are taken by time, and a run
    that is over for ``keep_seconds`` by the time of a row is forgotten before that row: where batches end changes nothing.
    """

    def __init__(self, keep_seconds: int, event_time: bool):
        self.keep, self.event_time = keep_seconds * 1_000_000, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "progress int, status string, ended long")
        # by processing time the request goes with a time to live of its own; by event time it goes with the run
        ttl = None if self.event_time else self.keep // 1000
        self.cancel = handle.getValueState("cancel", "requested long", ttlDurationMs=ttl)

    def _forget(self) -> None:
        self.run.clear()
        self.cancel.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        progress, status, ended = self.run.get() if self.run.exists() else (0, "running", None)
        for row in sorted(rows, key=lambda r: (r.at, r.phase)):
            if ended and row.at >= ended + self.keep:
                yield CHANGE(key[0], progress, "expired", ended + self.keep)
                self._forget()
                progress, status, ended = 0, "running", None
            if ended and row.phase == "start":
                self._forget()
                progress, status, ended = 0, "running", None
            if ended or row.phase == "start":
                continue
            if row.phase == "cancel":
                self.cancel.update((row.at,))
            elif row.phase in PROGRESS:
                if self.cancel.exists():
                    status = "cancelled"
                else:
                    progress = max(progress, PROGRESS[row.phase])
                    status = "completed" if progress == 100 else "running"
                if status != "running":
                    ended = row.at
                    now = ended // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                    self.handle.registerTimer(now + self.keep // 1000)
                yield CHANGE(key[0], progress, status, row.at)
        self.run.update((progress, status, ended))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        progress, _, ended = self.run.get() if self.run.exists() else (0, "running", None)
        if ended:
            self._forget()
            yield CHANGE(key[0], progress, "expired", ended + self.keep)

    def close(self) -> None:
        pass


def live_runs(events: DataFrame, keep_seconds: int = 3600, lateness: str | None = "10 minutes") -> DataFrame:
    """A stream of (paper_id, progress, state, at) of (paper_id, phase, ts): a row for each change of a run.

    With ``lateness`` time is that of the events; without, it is the clock's. The state is kept in RocksDB, a few
    bytes for each run that is not forgotten.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    keyed = (events.withWatermark("ts", lateness) if lateness else events).where("paper_id IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_micros("ts")).groupBy("paper_id")
    changes = keyed.transformWithState(RunProcessor(keep_seconds, bool(lateness)), "paper_id long, progress int, state string, at long", "Append", "EventTime" if lateness else "ProcessingTime")
    return changes.withColumn("at", F.timestamp_micros("at"))


def drained(stream: DataFrame, path: str) -> DataFrame:
    """The rows that a stream gives for all that its source holds, written below ``path``.

    Not for ``live_runs`` by the clock: while a timer is set, such a stream never ends.
    """
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def shown_second(moment: Column) -> Column:
    """The second of a moment that is kept in milliseconds, as DuckDB's ``epoch_ms(t) // 1000``: the nearest millisecond (half
    away from zero), cut to its second, so what is half a millisecond short of a second counts as the next one."""
    milliseconds = F.call_function("div", F.unix_micros(moment) + F.signum(F.unix_micros(moment)).cast("long") * 500, F.lit(1000))
    return F.call_function("div", milliseconds, F.lit(1000))
