"""Structured Streaming forms: progress, dashboards, the ledger's windows, ingest."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import content_hash, count_tokens, hard_split

TERMINAL = ("complete", "error", "failed")


def read_stream(spark: SparkSession, path: str, schema: str | Any, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one table, as a stream."""
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def progress_stream(events: DataFrame, timeout: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Progress rows by file from events (file_id, stage, progress, at): for each batch of a file's events its latest stage, and
    whether that ends it; a file without an event for `timeout` of event time gets a timeout row. State is dropped
    with the ending and with the timeout."""
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, _, progress = state.get
            state.remove()
            yield pd.DataFrame({"file_id": [key[0]], "stage": ["timeout"], "progress": [progress], "at": [pd.Timestamp(at, unit="us")], "terminal": [True]})
            return
        best = state.get if state.exists else None
        for batch in batches:
            for at, stage, progress in zip(batch["at"].astype("int64") // _unit(batch["at"]), batch["stage"], batch["progress"], strict=True):
                if best is None or (at, stage) >= best[:2]:
                    best = (int(at), stage, int(progress))
        if best is None:
            return
        done = best[1] in TERMINAL
        if done:
            if state.exists:
                state.remove()
        else:
            state.update(best)
            state.setTimeoutTimestamp(max(best[0] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"file_id": [key[0]], "stage": [best[1]], "progress": [best[2]], "at": [pd.Timestamp(best[0], unit="us")], "terminal": [done]})

    rows = events.select("file_id", "stage", F.col("progress").cast("int").alias("progress"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("file_id").applyInPandasWithState(
        advance, "file_id long, stage string, progress int, at timestamp, terminal boolean", "at long, stage string, progress int", "append", GroupStateTimeout.EventTimeTimeout)


def _unit(times: pd.Series) -> int:
    """How many of a series' ticks are a microsecond."""
    return {"datetime64[ns]": 1000}.get(str(times.dtype).replace(", UTC", ""), 1)


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dashboard_stream(files: DataFrame, name: str, every: str | None = "5 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Counts of files by status in a table in memory, refreshed; every=None takes all that is there and stops."""
    writer = status_counts(files).writeStream.outputMode("complete").format("memory").queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ledger_stream(ledger: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The hourly summary over a stream: tumbling windows (sliding ones for running budgets) that the watermark closes."""
    rows = ledger.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    sums = rows.groupBy(span.alias("w"), "caller_service", "provider", "model").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("total_tokens"), F.count_if(F.col("status") != "success").alias("errors"), F.count("fallback_from").alias("fallbacks"))
    return sums.select(F.col("w.start").alias("hour"), "caller_service", "provider", "model", "requests", "total_tokens", "errors", "fallbacks")


def _folders(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """What the batches before have written of a table, with the column batch; empty before the first."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


REGISTRY = "doc_id long, sha256 string"
CHUNKS = "doc_id long, chunk_index int, content string, token_count int"


def ingest_batch(batch: DataFrame, out: str, number: int, tokens: int = 256) -> None:
    """Register, drop copies and chunk one batch of documents (doc_id, text) into <out>/registry, <out>/chunks and
    <out>/incremental (documents whose id came before with another text).

    A text that the registry has, or that came earlier in the batch, is not taken; of texts with one id, the last by hash is. Each
    table's rows of a batch are a folder (batch=<number>) that is written over as a whole, from the batches before only. So a batch that
    failed between two tables, or that is run again, leaves what one run leaves. current_chunks reads the tables.
    """
    spark = batch.sparkSession
    hashed = batch.select("doc_id", "text", content_hash(F.col("text")).alias("sha256"))
    before = _folders(spark, out, "registry", REGISTRY).filter(F.col("batch") < number)
    first = hashed.filter(F.col("text") != "").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    new = first.join(before.select("sha256"), "sha256", "left_anti").groupBy("doc_id").agg(F.max("sha256").alias("sha256"))
    again = new.join(before.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "sha256")
    texts = hashed.join(new, ["doc_id", "sha256"], "left_semi").dropDuplicates(["doc_id", "sha256"])
    chunks = texts.select("doc_id", F.posexplode(hard_split(F.col("text"), tokens)).alias("chunk_index", "content"))
    tables = (("chunks", chunks.withColumn("token_count", count_tokens(F.col("content")))), ("incremental", again), ("registry", new.select("doc_id", "sha256")))
    for name, rows in tables:
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each document's last text: a later upload of a document takes the place of the earlier one."""
    registry = _folders(spark, out, "registry", REGISTRY)
    last = registry.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return _folders(spark, out, "chunks", CHUNKS).join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def ingest_stream(documents: DataFrame, out: str, checkpoint: str, tokens: int = 256) -> StreamingQuery:
    """New documents as they come, through ingest_batch; takes all that is there and stops."""
    return documents.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, out, number, tokens)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
