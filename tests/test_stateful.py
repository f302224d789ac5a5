"""State across batches: timers, windows of requests against the batch form, a changelog that repeats itself."""

import random

from pyspark.sql import functions as F

from millrace.operators import ledger, stats
from millrace.streaming import jobs as N
from millrace.streaming import stateful as W


def _stream(spark, path, frames):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return N.read_stream(spark, f"{path}/in", frames[0].schema, files_per_trigger=1)


def _collect(spark, stream, path):
    with W.rocksdb(spark):
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def test_progress_with_timers(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "file_id long, stage string, progress int, s long").selectExpr("file_id", "stage", "progress", "timestamp_seconds(1000000 + s) AS at")
    batches = [[(1, "extract", 10, 0), (1, "chunk", 20, 5), (2, "extract", 1, 0), (None, "x", 1, 0)], [(1, "complete", 100, 60)], [(3, "extract", 1, 4000)], [(3, "failed", None, 4100)], [(4, "extract", 1, 9000)]]
    rows = {(r.file_id, r.stage, r.terminal) for r in _collect(spark, W.progress_changes(_stream(spark, str(tmp_path), [frame(b) for b in batches])), str(tmp_path)).collect()}
    assert rows == {(1, "chunk", False), (2, "extract", False), (1, "complete", True), (3, "extract", False), (2, "timeout", True), (3, "failed", True), (4, "extract", False)}


def test_limiter_equals_its_batch_form(spark, tmp_path):
    pick = random.Random(5)
    rows = sorted((pick.randint(0, 5000), i, pick.choice("ab") if i % 3 else "hot") for i in range(400))
    frame = lambda some: spark.createDataFrame([(i, k, s) for s, i, k in some], "id long, key string, s long").selectExpr("id", "key", "timestamp_seconds(s) AS created_at")
    cuts = [[r for r in rows if a <= r[0] < b] for a, b in ((0, 700), (700, 3000), (3000, 6000))]
    got = _collect(spark, W.rate_limit_stream(_stream(spark, str(tmp_path), [frame(c) for c in cuts]), "key", 3, 60), str(tmp_path))
    want = ledger.rate_limit(frame(rows), "key", 3, 60)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_dashboard_follows_states(spark, tmp_path):
    files = lambda rows: spark.createDataFrame(rows, "file_id long, status string, deleted_at timestamp, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, category string, is_current boolean, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    import datetime

    gone = datetime.datetime(2024, 1, 1)
    f = [[(1, "pending", None, 1), (2, "pending", None, 1), (3, "processing", None, 1)], [(1, "processing", None, 2), (2, "pending", None, 1), (4, "pending", None, 2)], [(1, "processed", None, 4), (1, "failed", None, 3), (3, "processing", gone, 5)]]
    d = [[(1, "a", True, 1), (2, None, True, 1)], [(1, "a", False, 2), (11, "b", True, 2)], [(2, "a", True, 0)]]
    stream = [_stream(spark, str(tmp_path / n), frames) for n, frames in (("f", list(map(files, f))), ("d", list(map(docs, d))))]
    W.dashboard_stream(*stream, str(tmp_path / "lake"), str(tmp_path / "c")).awaitTermination()
    got = {(r.section, r.item): r.n for r in W.dashboard(spark, str(tmp_path / "lake")).collect()}
    last = files([(1, "processed", None, 4), (2, "pending", None, 1), (3, "processing", gone, 5), (4, "pending", None, 2)])
    want = {("file_status", r.status): r.n for r in stats.file_status_counts(last).collect() if r.status}
    current = docs([(1, "a", False, 2), (2, "none", True, 1), (11, "b", True, 2)])
    want |= {("category", r.category): r.n for r in stats.category_counts(current).collect()}
    assert got == want | {("total", "files"): 3, ("total", "documents"): 2, ("total", "pending"): 2, ("total", "active"): 0}


def test_a_changelog_takes_rows():
    """No frame of pandas for each thing: rows in, rows out; late and repeated states change nothing, null is a state of its own."""
    from pyspark.sql import Row

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    one = W.Changelog()
    one.now = Held()
    took = lambda *rows: [(r.section, r.item, r.n) for r in one.handleInputRows(("s", "1"), (Row(at=a, item=i) for a, i in rows), None)]
    assert took((1, "a"), (1, None), (0, "z")) == [("s", "a", 1)] and took((1, "a")) == [] and took((0, "b")) == []
    assert took((2, "b"), (3, "c")) == [("s", "a", -1), ("s", "c", 1)] and took((4, None)) == [("s", "c", -1)] and took((3, "c")) == [] and took((4, "a")) == [("s", "a", 1)]
