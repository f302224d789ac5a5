"""Uploads through the commit log: versions against the batch operators, a batch that dies, snapshots of the past."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from millrace.operators.versions import chunk_delta, delta_metadata
from millrace.sources import commits
from millrace.streaming import uploads as U

SCHEMA = "file_id long, filename string, content_type string, content string, version string, body string"


def _uploads(spark, rows):
    return spark.createDataFrame([(i, f"f{i}{ext}", None, text, "x", "y") for i, ext, text in rows], SCHEMA)


def _state(spark, base, as_of=None):
    return {name: sorted(map(str, U.read_lake(spark, base, name, as_of).collect())) for name in U.TABLES}


FIRST = [(1, ".txt", "one two three\n\nfour five six"), (2, ".txt", "one two three\n\nfour five six"), (3, ".md", "# Head\n\n" + "word " * 3000), (4, ".txt", ""), (5, ".txt", None), (None, ".txt", "lost"), (6, ".csv", "a,b\n1,2"), (7, ".xyz", "no adapter"), (1, ".txt", "one two three\n\nfour five six")]
SECOND = [(1, ".txt", "one two three\n\nfour five seven"), (3, ".md", "# Head\n\n" + "word " * 3000 + "and more"), (8, ".txt", "new here"), (9, ".txt", "a,b\n1,2"), (6, ".csv", "a,b\n1,2\n3,4"), (6, ".csv", "a,b\n1,2\n3,4\n5,6")]


def test_two_uploads(spark, tmp_path):
    base = str(tmp_path / "lake")
    assert U.upload_batch(_uploads(spark, FIRST), base, "w", 0)
    once = _state(spark, base)
    assert not U.upload_batch(_uploads(spark, FIRST), base, "w", 0) and _state(spark, base) == once
    assert U.upload_batch(_uploads(spark, SECOND), base, "w", 1)
    versions = {(r.file_id, r.version) for r in U.read_lake(spark, base, "documents").collect()}
    assert versions == {(1, 1), (3, 1), (6, 1), (7, 1), (1, 2), (3, 2), (6, 2), (8, 1)}  # 2 and 9 are copies; of two contents of 6 one is taken
    chunks = U.read_lake(spark, base, "chunks")
    old, new = (chunks.filter(F.col("version") == v).withColumnRenamed("file_id", "doc_id") for v in (1, 2))
    again = old.join(new.select("doc_id").distinct(), "doc_id", "left_semi")
    want = sorted(map(str, delta_metadata(chunk_delta(again, new)).collect()))
    got = U.read_lake(spark, base, "deltas").drop("version").withColumnRenamed("file_id", "doc_id").select("doc_id", "unchanged", "modified", "added", "removed", "change_ratio", "no_changes", "reclassify")
    assert sorted(map(str, got.collect())) == want and len(want) == 3
    diffs = {(r.file_id, r.version): r for r in U.read_lake(spark, base, "diffs").collect()}
    assert diffs[1, 1].justification == "Initial processing" and diffs[1, 2].before_text == "one two three\n\nfour five six" and diffs[1, 2].after_text.endswith("seven")
    kept = chunks.filter("version = 2 AND file_id = 3 AND reused")
    assert kept.count() > 0 and all(r.work == r.content[:150] for r in kept.collect())
    assert {r.file_id: r.version for r in U.read_current(spark, base, "documents").select("file_id", "version").collect()} == {1: 2, 3: 2, 6: 2, 7: 1, 8: 1}
    assert _state(spark, base, as_of=1) == once  # the past stays readable
    assert {r.file_id for r in U.read_lake(spark, base, "documents", as_of=0).collect()} == set()


def test_a_batch_that_dies_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    base, whole = str(tmp_path / "lake"), str(tmp_path / "whole")
    for where in (base, whole):
        U.upload_batch(_uploads(spark, FIRST[:3]), where, "w", 0)
    U.upload_batch(_uploads(spark, SECOND[:3]), whole, "w", 1)
    before, write = _state(spark, base), DataFrameWriter.parquet
    for dies_at in ("/chunks/", "/diffs/", "/commits/"):

        def failing(self, path, *args, dies_at=dies_at, **kwargs):
            if dies_at in path:
                raise OSError("lost")
            return write(self, path, *args, **kwargs)

        monkeypatch.setattr(DataFrameWriter, "parquet", failing)
        with pytest.raises(OSError):
            U.upload_batch(_uploads(spark, SECOND[:3]), base, "w", 1)
        monkeypatch.setattr(DataFrameWriter, "parquet", write)
        assert commits.last_commit(spark, base) == 1 and _state(spark, base) == before
    U.upload_batch(_uploads(spark, SECOND[:3]), base, "w", 1)
    assert _state(spark, base) == _state(spark, whole)


def test_writers_number_their_own_batches(spark, tmp_path):
    base, rows = str(tmp_path / "lake"), spark.range(2)
    assert commits.commit(spark, base, "a", 0, {"t": rows}) and commits.commit(spark, base, "b", 0, {"t": rows}) and not commits.commit(spark, base, "a", 0, {"t": rows})
    assert commits.snapshot(spark, base, "t", "id long").count() == 4 and commits.snapshot(spark, base, "t", "id long", as_of=1).count() == 2
    assert [r.number for r in commits.log(spark, base).orderBy("number").collect()] == [1, 2]
    assert commits.snapshot(spark, str(tmp_path / "none"), "t", "id long").count() == 0


def test_new_files_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    """Texts meet the list of what is taken once; no table of new files joins or shuffles them again, and copies within the batch count once."""
    plans, commit = {}, U.commit

    def seen(spark, base, writer, number, tables):
        plans.update({name: df._jdf.queryExecution().executedPlan().toString() for name, df in tables.items()})
        return commit(spark, base, writer, number, tables)

    monkeypatch.setattr(U, "commit", seen)
    base = str(tmp_path / "lake")
    assert U.upload_batch(_uploads(spark, FIRST), base, "w", 0)
    assert set(plans) == set(U.TABLES) and not [name for name, plan in plans.items() if "Exchange" in plan or "Join" in plan]
    files = sorted((r.file_id, r.version, r.filename) for r in U.read_lake(spark, base, "files").collect())
    assert files == [(1, 1, "f1.txt"), (3, 1, "f3.md"), (6, 1, "f6.csv"), (7, 1, "f7.xyz")]
    assert {r.file_id for r in U.read_lake(spark, base, "diffs").filter("before_text IS NULL AND justification = 'Initial processing'").collect()} == {1, 3, 6, 7}
    assert U.read_lake(spark, base, "deltas").isEmpty() and U.read_lake(spark, base, "chunks").filter("reused OR work IS NULL").isEmpty()
