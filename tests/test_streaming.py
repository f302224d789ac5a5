"""Streams against their batch twins, over several files."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import jobs as N


def _events(spark, path, batches):
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "file_id long, stage string, progress int, s long").selectExpr("file_id", "stage", "progress", "timestamp_seconds(1000000 + s) AS at")
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
        if i == 0:
            schema = frame.schema
    return N.read_stream(spark, f"{path}/in", schema, files_per_trigger=1)


def test_progress_ends_and_times_out(spark, tmp_path):
    batches = [[(1, "extract", 10, 0), (1, "chunk", 20, 5), (2, "extract", 1, 0)], [(1, "complete", 100, 60)], [(3, "extract", 1, 4000)], [(3, "failed", 2, 4100)]]
    stream = N.progress_stream(_events(spark, tmp_path, batches))
    stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = {(r.file_id, r.stage, r.terminal) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert (1, "complete", True) in rows and (2, "timeout", True) in rows and (3, "failed", True) in rows and (1, "timeout", True) not in rows


def test_late_rows_are_dropped(spark, tmp_path):
    base = "id long, caller_service string, provider string, model string, total_tokens long, status string, fallback_from string, s long"
    for rows in ([(1, "a", "p", "m", 5, "success", None, 100)], [(2, "a", "p", "m", 7, "error", "x", 9000)], [(3, "a", "p", "m", 9, "success", None, 120)], [(4, "a", "p", "m", 1, "success", None, 20_000)]):
        spark.createDataFrame(rows, base).withColumn("created_at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = N.ledger_stream(N.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1))
    stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(int(r.hour.timestamp()), r.requests, r.total_tokens, r.errors, r.fallbacks) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got in ({(0, 1, 5, 0, 0), (7200, 1, 7, 1, 1)}, {(0, 2, 14, 0, 0), (7200, 1, 7, 1, 1)})


def _lake(spark, out):
    state = {name: sorted(map(str, spark.read.parquet(f"{out}/{name}").collect())) for name in ("registry", "chunks", "incremental")}
    return state | {"current": sorted((r.doc_id, r.chunk_index, r.content) for r in N.current_chunks(spark, out).collect())}


def test_ingest_is_idempotent_and_replaces_uploads(spark, tmp_path, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = frame([(1, "a b c"), (2, "a b c"), (3, "d " * 600), (4, ""), (6, None), (1, "a b c")]), frame([(1, "changed text"), (5, "e"), (7, "a b c")])
    out = str(tmp_path / "lake")
    N.ingest_batch(first, out, 0)
    once = _lake(spark, out)
    assert once["current"][0] == (1, 0, "a b c") and len(once["current"]) == 4 and once["incremental"] == []
    N.ingest_batch(first, out, 0)
    assert _lake(spark, out) == once
    N.ingest_batch(second, out, 1)
    whole = _lake(spark, out)
    assert [c for d, _, c in whole["current"] if d == 1] == ["changed text"] and {d for d, _, _ in whole["current"]} == {1, 3, 5}
    assert len(whole["registry"]) == 4 and len(whole["incremental"]) == 1

    # a batch that fails between its tables, then runs again
    from pyspark.sql import DataFrameWriter

    write, broken = DataFrameWriter.parquet, str(tmp_path / "broken")
    N.ingest_batch(first, broken, 0)

    def failing(self, path, *args, **kwargs):
        if "/registry/" in path:
            raise OSError("lost")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError):
        N.ingest_batch(second, broken, 1)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert [c for d, _, c in _lake(spark, broken)["current"] if d == 1] == ["a b c"]  # not yet registered
    N.ingest_batch(second, broken, 1)
    assert _lake(spark, broken) == whole
