"""Runs as a stream of events: stale ones are reaped by timers, each in its own state.

An event names a run and what happened to it: ``claimed`` (with its attempts so far), ``beat`` or ``over``. A run that nobody has heard of for the timeout goes back to the queue, or has failed
after its attempts; both come out as rows once event time has passed it. State and timers live in the checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REAPED = "id string, status string, error_message string, reaped_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reaper(StatefulProcessor):
    def __init__(self, timeout_ms: int, attempts: int) -> None:
        self.timeout, self.attempts = timeout_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Last sign of life and attempts; the state of a run that is over is cleared.
        self.run = handle.getValueState("run", "last_ms long, attempts int")

    def _rest(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, attempts = self.run.get() if self.run.exists() else (None, 0)
        events = pd.concat(rows).sort_values("ms", kind="stable")
        for kind, ms, n in zip(events["kind"], events["ms"], events["attempts"], strict=True):
            if kind == "over":
                last = None
            elif kind == "claimed":
                last, attempts = max(last or 0, int(ms)), int(n)
            elif last is not None:  # a beat of a run that isn't claimed says nothing
                last = max(last, int(ms))
        self._rest()
        if last is None:
            self.run.clear()
        else:
            self.run.update((last, attempts))
            # Just past the limit: a beat exactly as old isn't stale yet. A timer can't lie behind the watermark.
            self.handle.registerTimer(max(last + self.timeout + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            last, attempts = self.run.get()
            self.run.clear()
            spent = attempts >= self.attempts
            at = pd.Timestamp(last + self.timeout + 1, unit="ms", tz="UTC")
            yield pd.DataFrame({"id": [key[0]], "status": ["failed" if spent else "pending"], "error_message": ["worker lost" if spent else None], "reaped_at": [at]})

    def close(self) -> None:
        pass


def reaped(events: DataFrame, timeout_ms: int = 300_000, attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """``REAPED`` rows of a stream of ``run_id, kind, ts, attempts``. Events may come ``late``; a run shows up once event time is past its limit by that much."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.withWatermark("ts", late).select("run_id", "kind", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("attempts", F.lit(0)).alias("attempts"))
    return rows.groupBy("run_id").transformWithStateInPandas(Reaper(timeout_ms, attempts), REAPED, "Append", "EventTime")
