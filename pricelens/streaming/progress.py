"""Runs that close when all their items are in or no more come: keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the state store must be for keyed state with timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CLOSED = "run_id string, outcome string, expected long, done long, failed long, last_at timestamp"


class RunProgress(StatefulProcessor):
    """Items of a run in any order, repeated ones once (the last word counts); the run closes complete when as many as it expects are in, else timed out when ``timeout_ms`` of event time pass without a new one. A failed item fails alone."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "expected long, last_ms long")
        self.items = handle.getMapState("items", "idx long", "ok boolean")

    def _closed(self, key, outcome: str) -> pd.DataFrame:
        expected, last = self.run.get()
        said = [bool(ok) for _, (ok,) in self.items.iterator()]
        self.run.clear()
        self.items.clear()
        at = pd.Timestamp(last, unit="ms")
        return pd.DataFrame({"run_id": [str(key[0])], "outcome": [outcome], "expected": [expected], "done": [len(said)], "failed": [said.count(False)], "last_at": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected, last = self.run.get() if self.run.exists() else (0, 0)
        before = last
        for frame in rows:
            for r in frame.sort_values(["at_ms", "ok"]).itertuples():
                self.items.updateValue((int(r.idx),), (bool(r.ok),))
            expected, last = max(expected, int(frame["expected"].max())), max(last, int(frame["at_ms"].max()))
        self.run.update((expected, last))
        if before:
            self.handle.deleteTimer(before + self.timeout_ms)
        if sum(1 for _ in self.items.keys()) >= expected:
            yield self._closed(key, "complete")
        else:
            self.handle.registerTimer(last + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            yield self._closed(key, "timed out")

    def close(self) -> None:
        pass


def run_progress(items: DataFrame, timeout: str = "30 days", late: str = "1 day") -> DataFrame:
    """A row for each run that closes: of the stream ``items`` (``run_id``, ``idx``, ``ok``, ``expected``, event time ``at``). The session must have :data:`STORE`.

    Items later than ``late`` behind the newest are dropped. State is an entry for each item of
    each open run, spread by run; a run that closes leaves none. An item after the close opens
    the run again.
    """
    ms = int(pd.Timedelta(timeout) / pd.Timedelta(milliseconds=1))
    known = items.where("run_id IS NOT NULL AND idx IS NOT NULL AND at IS NOT NULL").withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late)
    return known.groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunProgress(ms), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")


def run_progress_batch(items: DataFrame, timeout: str = "30 days", late: str = "1 day") -> DataFrame:
    """What :func:`run_progress` gives when all items come in one batch and the newest sets the watermark: closed runs only."""
    known = items.where("run_id IS NOT NULL AND idx IS NOT NULL AND at IS NOT NULL").withColumn("at_ms", F.unix_millis("at"))
    one = known.groupBy("run_id", "idx").agg(F.max_by("ok", F.struct("at_ms", "ok")).alias("ok"), F.max("expected").alias("expected"), F.max("at_ms").alias("at_ms"))
    runs = one.groupBy("run_id").agg(F.max("expected").cast("long").alias("expected"), F.count("*").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.max("at_ms").alias("last"))
    newest = known.agg(F.max("at_ms").alias("newest"))
    gap = int(pd.Timedelta(timeout) / pd.Timedelta(milliseconds=1)) + int(pd.Timedelta(late) / pd.Timedelta(milliseconds=1))
    both = runs.join(F.broadcast(newest))  # one row
    outcome = F.when(F.col("done") >= F.col("expected"), "complete").when(F.col("last") + gap <= F.col("newest"), "timed out")
    return both.withColumn("outcome", outcome).where("outcome IS NOT NULL").select(F.col("run_id").cast("string").alias("run_id"), "outcome", "expected", "done", "failed", F.timestamp_millis("last").alias("last_at"))
