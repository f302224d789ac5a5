"""Streams with state of their own for each key: progress that times out, windows of requests, changelogs of dashboards."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.sources.commits import commit, snapshot
from millrace.streaming.jobs import TERMINAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """These processors need the RocksDB state store while their query is started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _micros(times: pd.Series) -> np.ndarray:
    return times.dt.tz_localize(None).to_numpy("datetime64[us]").astype(np.int64) if times.dt.tz is not None else times.to_numpy("datetime64[us]").astype(np.int64)


class Progress(StatefulProcessor):
    """The latest stage of a file as its state; a timer for the time after which it has timed out."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.latest = handle, handle.getValueState("latest", "at long, stage string, progress int")

    def _row(self, key: tuple, at: int, stage: str, progress: int, done: bool) -> pd.DataFrame:
        return pd.DataFrame({"file_id": [key[0]], "stage": pd.Series([stage], dtype=object), "progress": [progress], "at": [pd.Timestamp(at, unit="us")], "terminal": [done]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = tuple(self.latest.get()) if self.latest.exists() else None
        for batch in rows:
            at = _micros(batch["at"])
            newest = at == at.max()
            one = batch[newest].assign(t=at[newest]).sort_values("stage").iloc[-1]
            if best is None or (one.t, one.stage) >= best[:2]:
                best = (int(one.t), one.stage, int(one.progress))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[1] in TERMINAL:
            self.latest.clear()
        else:
            self.latest.update(best)
            self.handle.registerTimer(max(best[0] // 1000 + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, *best, best[1] in TERMINAL)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, _, progress = self.latest.get()
        self.latest.clear()
        yield self._row(key, at, "timeout", progress, True)

    def close(self) -> None:
        pass


def progress_changes(events: DataFrame, timeout: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """progress_stream with value state and timers: for each batch of a file's events its latest stage (of one moment the last by name) and whether that
    ends it; a timeout row once the watermark has passed `timeout` after it. Ended and timed-out files leave no state."""
    rows = events.select("file_id", "stage", F.coalesce(F.col("progress").cast("int"), F.lit(0)).alias("progress"), F.col("at").cast("timestamp").alias("at")).filter("file_id IS NOT NULL AND stage IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return rows.groupBy("file_id").transformWithStateInPandas(Progress(wait), "file_id long, stage string, progress int, at timestamp, terminal boolean", "Append", "EventTime")


class Limiter(StatefulProcessor):
    """The window that a key's request has opened, and how many came in it. A timer drops the window when it is over."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        t, ids = _micros(batch["at"]), batch["id"].to_numpy()
        order = np.lexsort((ids, t))
        t, ids = t[order], ids[order]
        start, n = self.window.get() if self.window.exists() else (None, 0)
        starts, nth, at = np.empty(len(t), np.int64), np.empty(len(t), np.int64), 0
        while at < len(t):  # a window at a time
            if start is None or t[at] >= start + self.width:
                start, n = int(t[at]), 0
            end = int(np.searchsorted(t, start + self.width, "left"))
            starts[at:end], nth[at:end] = start, np.arange(n + 1, n + 1 + end - at)
            n, at = n + end - at, end
        self.window.update((int(start), int(n)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((start + self.width) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        reset = -((t - starts - self.width) // 1_000_000)
        yield pd.DataFrame({"id": ids, "key": pd.Series([key[0]] * len(ids), dtype=object), "nth": nth, "allowed": nth <= self.limit, "remaining": np.maximum(0, self.limit - nth), "reset_in": reset})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, key: str, limit: int, seconds: int, at: str = "created_at", id: str = "id", late: str = "10 minutes") -> DataFrame:
    """rate_limit as requests come: id, key, nth, allowed, remaining, reset_in. Equal to the batch form where batches follow one another in time;
    inside a batch requests may come in any order, and one that comes later than its turn counts in the window that is open. What a
    key holds is its open window. Requests without key, id or time are not judged."""
    rows = requests.select(F.col(id).cast("long").alias("id"), F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).filter("id IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, seconds * 1_000_000), "id long, key string, nth long, allowed boolean, remaining long, reset_in long", "Append", "EventTime")


class Changelog(StatefulProcessor):
    """What a thing counts as, as its state; a change takes one from what it was and gives one to what it is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "at long, item string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = tuple(self.now.get()) if self.now.exists() else None
        rank = lambda x: (x[0], x[1] is not None, x[1] or "")
        best = max(((r["at"], r["item"]) for r in rows), key=rank)
        if old is not None and rank(best) <= rank(old):
            return
        self.now.update(best)
        was, is_ = old[1] if old else None, best[1]
        if was != is_:
            for item, n in ((was, -1), (is_, 1)):
                if item is not None:
                    yield Row(section=key[0], item=item, n=n)

    def close(self) -> None:
        pass


DASHBOARD = "section string, item string, n long"


def dashboard_changes(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Signed changes (section, item, n) of a dashboard from streams of states: files (file_id, status, deleted_at, at) and documents
    (doc_id, category, is_current, at). The newest state of each counts, a deleted file and a replaced document as nothing. A stream of states
    may repeat itself: only what differs changes anything. A thing has few rows in a batch, so they come as rows, not as frames of pandas."""
    alive = F.when(F.col("deleted_at").isNull(), F.col("status"))
    some = files.select(F.lit("file_status").alias("section"), F.col("file_id").cast("string").alias("id"), alias_item(alive), F.col("at").cast("timestamp").alias("at"))
    current = F.when(F.col("is_current"), F.coalesce("category", F.lit("none")))
    rows = some.unionByName(documents.select(F.lit("category").alias("section"), F.col("doc_id").cast("string").alias("id"), alias_item(current), F.col("at").cast("timestamp").alias("at")))
    rows = rows.filter("id IS NOT NULL AND at IS NOT NULL").withColumn("at", F.unix_micros("at"))
    return rows.groupBy("section", "id").transformWithState(Changelog(), DASHBOARD, "Append", "None")


def alias_item(c: Any) -> Any:
    return c.cast("string").alias("item")


def _add(changes: DataFrame, base: str, writer: str, number: int) -> None:
    """A batch's changes, summed, as one commit."""
    sums = changes.groupBy("section", "item").agg(F.sum("n").alias("n")).filter("n <> 0")
    commit(changes.sparkSession, base, writer, number, {"changes": sums})


def dashboard_stream(files: DataFrame, documents: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Keeps the changes in the lake at base, a commit a batch; takes all that is there and stops."""
    with rocksdb(files.sparkSession):
        writer = dashboard_changes(files, documents).writeStream.foreachBatch(lambda batch, number: _add(batch, base, checkpoint, number))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Statuses of files that are waiting, and of those that are being worked on.
PENDING, ACTIVE = ("pending",), ("processing",)


def dashboard(spark: SparkSession, base: str, as_of: int | None = None) -> DataFrame:
    """section, item, n: files by status, documents by category, and totals: files, documents, pending, active. Reads the sums of
    changes, a few rows for each batch, not the lake."""
    now = snapshot(spark, base, "changes", DASHBOARD, as_of).groupBy("section", "item").agg(F.sum("n").alias("n")).filter("n <> 0")
    files = F.col("section") == "file_status"
    marks = (("files", files), ("documents", ~files), ("pending", files & F.col("item").isin(*PENDING)), ("active", files & F.col("item").isin(*ACTIVE)))
    totals = now.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in marks))
    return now.unionByName(totals.select(F.explode(F.array(*(F.struct(F.lit("total").alias("section"), F.lit(name).alias("item"), F.col(name).alias("n")) for name, _ in marks))).alias("r")).select("r.*"))
