"""Files of any size: parts and hashes equal the files' bytes; a 3 GB file needs little memory."""

import hashlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace.sources import files as A
from millrace.sources import large as L


def test_parts_join_to_the_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_tmp").mkdir()
    held = {"a.bin": bytes(range(256)) * 40, "sub/b.bin": b"x" * 1000, "sub/empty.bin": b"", "sub/c d%20é.bin": b"yz", "sub/a.bin": b"q"}
    for name, data in held.items() | {("_tmp/no.bin", b"1"), (".no.bin", b"1"), ("other.txt", b"1")}:
        (tmp_path / name).write_bytes(data)
    for path in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        got = L.file_parts(spark, path, "*.bin", part_bytes=1000).collect()
        for name, data in held.items():
            parts = sorted((r.start, bytes(r.content)) for r in got if r.path == f"file:{tmp_path}/{name}")
            assert b"".join(p for _, p in parts) == data and [s for s, _ in parts] == list(range(0, max(1, len(data)), 1000))
        assert len(got) == 11 + 1 + 1 + 1 + 1
        hashes = {r.path: (r.filename, r.size_bytes, r.sha256) for r in L.file_hashes(spark, path, "*.bin").collect()}
        assert hashes == {f"file:{tmp_path}/{n}": (n.rsplit("/", 1)[-1], len(d), hashlib.sha256(d).hexdigest()) for n, d in held.items()}
    assert L.file_parts(spark, str(tmp_path / "a.bin"), part_bytes=5000).count() == 3
    assert L.file_parts(spark, str(tmp_path), "*.none").count() == 0 and L.file_hashes(spark, str(tmp_path), "*.none").count() == 0
    with pytest.raises(Exception, match="part_bytes"):
        L.file_parts(spark, str(tmp_path), part_bytes=0).count()
    with pytest.raises(Exception, match="nowhere"):
        L.file_parts(spark, str(tmp_path / "nowhere")).count()


def test_raw_files_over_the_limit_have_hashes(spark, tmp_path):
    for name, data in (("small.bin", b"s" * 10), ("edge.bin", b"e" * 100), ("big.bin", b"b" * 101)):
        (tmp_path / name).write_bytes(data)
    whole = {r.path: r for r in A.read_raw_files(spark, str(tmp_path)).collect()}
    cut = {r.path: r for r in A.read_raw_files(spark, str(tmp_path), inline=100).collect()}
    assert whole.keys() == cut.keys() and all(r.content is not None for r in whole.values())
    for path, r in cut.items():
        assert (r.content is None) == path.endswith("big.bin")
        assert [r[c] for c in ("filename", "size_bytes", "sha256")] == [whole[path][c] for c in ("filename", "size_bytes", "sha256")]
        assert abs((r.modified_at - whole[path].modified_at).total_seconds()) < 0.01


def test_packs_bound_a_tasks_bytes():
    files = [L.Range(str(i), str(i), 0, size, size, None) for i, size in enumerate([10, 0, 5, 100, 7, 7, 7, 7])]
    packs = L.pack(L.cut(files, 20), 20)
    assert [r for p in packs for r in p.ranges] == L.cut(files, 20) and all(sum(r.length for r in p.ranges) <= 20 for p in packs)
    assert len(L.pack(files, 10**9, most=3)) == 3 and max(len(p.ranges) for p in L.pack(files, 10**9, most=3)) == 3


def test_a_file_that_shrank_is_an_error(tmp_path):
    file = tmp_path / "f"
    file.write_bytes(b"0" * 100)
    for reader in (L.PartsReader({"path": str(tmp_path), "part_bytes": "30"}), L.HashesReader({"path": str(tmp_path)})):
        file.write_bytes(b"0" * 100)
        packs = reader.partitions()
        file.write_bytes(b"0" * 50)
        with pytest.raises(OSError, match="shorter"):
            [batch for p in packs for batch in reader.read(p)]


def test_three_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB with marks about: size, hash and bytes through Spark; the readers alone stay under 400 MB."""
    size, marks = 3 * 10**9, {0: b"first", (1 << 31) - 3: b"across", 3 * 10**9 - 4: b"last"}
    file = tmp_path / "large.bin"
    with file.open("wb") as out:
        out.truncate(size)
        for at, text in marks.items():
            out.seek(at)
            out.write(text)
    with file.open("rb") as data:
        want = hashlib.file_digest(data, "sha256").hexdigest()
    row = A.read_raw_files(spark, str(tmp_path)).first()
    assert (row.filename, row.size_bytes, row.sha256, row.content) == ("large.bin", size, want, None)
    parts = L.file_parts(spark, str(tmp_path))
    sums = parts.agg(F.sum(F.length("content")).alias("bytes"), F.count(F.lit(1)).alias("parts"), F.max(F.length("content")).alias("most")).first()
    assert (sums.bytes, sums.parts, sums.most) == (size, 179, 16 << 20)
    for at, text in marks.items():
        start = at // (16 << 20) * (16 << 20)
        around = b"".join(bytes(r.content) for r in parts.filter(F.col("start").isin(start, start + (16 << 20))).orderBy("start").collect())
        assert around[at - start : at - start + len(text)] == text
    code = f"""
import resource
from millrace.sources import large as L
for reader in (L.PartsReader({{"path": {str(tmp_path)!r}}}), L.HashesReader({{"path": {str(tmp_path)!r}}})):
    for pack in reader.partitions()[:8]:
        for batch in reader.read(pack):
            pass
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400


def test_queries_read_the_tables_files(spark, small):
    from millrace.plans import QUERIES

    hashes = {r.filename: (r.size_bytes, r.sha256) for r in QUERIES["file_hashes"](spark, small).collect()}
    assert hashes == {r.filename: (r.size_bytes, r.sha256) for r in QUERIES["read_raw_files"](spark, small).collect()} and hashes
    parts = QUERIES["file_parts"](spark, small).groupBy("filename").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")).collect()
    assert {r.filename: r.bytes for r in parts} == {n: size for n, (size, _) in hashes.items()}
    for name in hashes:
        data = open(f"{small}/{name}", "rb").read()
        want = {(i, hashlib.sha256(data[i : i + (1 << 20)]).hexdigest()) for i in range(0, len(data), 1 << 20)}
        assert {(r.start, r.sha256) for r in QUERIES["file_parts"](spark, small).filter(F.col("filename") == name).collect()} == want


def test_a_task_reads_a_step_of_a_file(spark, tmp_path, monkeypatch):
    """Hashes that go on from task to task, over sizes about the steps; a plan has a stage for each step of the largest file, each with a file a task."""
    held = {f"{n}.bin": bytes(i * 7 % 251 for i in range(n)) for n in (0, 1, 999, 1000, 1001, 2000, 3500)}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    want = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in held.items()}
    rows = L.file_hashes(spark, str(tmp_path), step=1000)
    assert {r.filename: (r.size_bytes, r.sha256) for r in rows.collect()} == want and rows.count() == len(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4 and plan.count("RepartitionByExpression") == 4
    monkeypatch.setattr(L, "STEPS", 2)
    assert {r.filename: (r.size_bytes, r.sha256) for r in L.file_hashes(spark, str(tmp_path), larger_than=1000, step=300).collect()} == {n: x for n, x in want.items() if x[0] > 1000}
    monkeypatch.setattr(A, "STEP", 1000)
    bare = A.read_raw_files(spark, str(tmp_path), content=False)
    # Spark's own listing leaves out files without bytes
    assert "content" not in bare.columns and {r.filename: (r.size_bytes, r.sha256) for r in bare.collect()} == {n: x for n, x in want.items() if x[0]}
    monkeypatch.setattr(L, "_openssl", lambda: None)
    assert {r.filename: (r.size_bytes, r.sha256) for r in L.file_hashes(spark, str(tmp_path), step=1000).collect()} == want
