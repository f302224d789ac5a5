"""Files of any size: a data source whose partitions are packs of byte ranges, so that no file has to fit into a row or a task's memory."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatchcase
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.shared import written

#: Bytes read at a time for a hash.
PIECE = 8 << 20
#: Bytes of a file that one task reads for its hash, where hashes can go on from task to task.
STEP = 256 << 20
#: Steps in one plan; what is known after them is written.
STEPS = 32


@dataclass(frozen=True)
class Range:
    """length bytes of a file of size bytes, from start; place is the file's name in its store."""

    path: str
    place: str
    start: int
    length: int
    size: int
    modified: datetime


@dataclass
class Pack(InputPartition):
    """The ranges that one task reads, one after the other."""

    ranges: tuple[Range, ...]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path (local, s3, gs, abfs, hdfs) and the path's name there. Names of local files are taken as they are, as Spark does."""
    if path.startswith("file:") or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def list_files(path: str, glob: str = "*", larger_than: int = -1) -> list[Range]:
    """Files below path (or path itself) as ranges of all their bytes, by name. As in Spark's own listing, names that begin with a dot or an underscore are left out, folders too."""
    store, root = open_store(path)
    bare = path.split("?")[0].rstrip("/")
    prefix = "file:" if isinstance(store, fs.LocalFileSystem) else bare[: len(bare) - len(root.rstrip("/"))]
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    out = []
    for file in found:
        below = file.path.removeprefix(root).strip("/").split("/")
        hidden = any(part.startswith(".") or (part.startswith("_") and "=" not in part) for part in below)
        if file.type == fs.FileType.File and not hidden and fnmatchcase(file.base_name, glob) and file.size > larger_than:
            out.append(Range(prefix + file.path, file.path, 0, file.size, file.size, file.mtime or datetime.fromtimestamp(0, timezone.utc)))
    return sorted(out, key=lambda r: r.path)


def cut(files: list[Range], part_bytes: int) -> list[Range]:
    """Each file as ranges of part_bytes; an empty file is one empty range."""
    return [
        Range(f.path, f.place, start, min(part_bytes, f.size - start), f.size, f.modified)
        for f in files
        for start in range(0, max(f.size, 1), part_bytes)
    ]


def pack(ranges: list[Range], pack_bytes: int, most: int = 10_000) -> list[Pack]:
    """Ranges in order, so many to a task that it reads about pack_bytes; most bounds the ranges of a task, for very many small files."""
    packs: list[list[Range]] = []
    room = 0
    for r in ranges:
        if not packs or r.length > room or len(packs[-1]) == most:
            packs.append([])
            room = pack_bytes
        packs[-1].append(r)
        room -= r.length
    return [Pack(tuple(p)) for p in packs]


@cache
def _openssl() -> Any:
    """OpenSSL's functions on a SHA-256 context (112 bytes without pointers, so that they can be kept and taken up elsewhere); None where Python has no such OpenSSL, or its
    context does not do that."""
    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        for f, more in ((lib.SHA256_Init, []), (lib.SHA256_Update, [ctypes.c_char_p, ctypes.c_size_t]), (lib.SHA256_Final, [])):
            f.argtypes = [ctypes.c_char_p, *([ctypes.c_char_p] if f is lib.SHA256_Final else more)]
        data = bytes(range(200))
        return lib if _digest(lib, _resumed(lib, _resumed(lib, None, data[:77]), data[77:])) == hashlib.sha256(data).hexdigest() else None
    except (AttributeError, OSError):
        return None


def _resumed(lib: Any, state: bytes | None, data: bytes) -> bytes:
    """The context after more data; state None begins."""
    context = ctypes.create_string_buffer(state or bytes(112), 112)
    if state is None:
        lib.SHA256_Init(context)
    lib.SHA256_Update(context, data, len(data))
    return context.raw


def _digest(lib: Any, state: bytes) -> str:
    out, context = ctypes.create_string_buffer(32), ctypes.create_string_buffer(state, 112)
    lib.SHA256_Final(out, context)
    return out.raw.hex()


def readable(path: str) -> bool:
    """Whether pyarrow opens the path's store."""
    try:
        open_store(path)
    except (pa.ArrowException, OSError):
        return False
    return True


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.larger_than, self.pack_bytes = int(options.get("larger_than", -1)), int(options.get("pack_bytes", 128 << 20))
        self.at_most = int(options.get("at_most", 1 << 62))
        if self.pack_bytes < 1:
            raise ValueError("pack_bytes must be positive")

    def files(self) -> list[Range]:
        return [f for f in list_files(self.path, self.glob, self.larger_than) if f.size <= self.at_most]

    def short(self, r: Range) -> OSError:
        return OSError(f"{r.path} is shorter than when it was listed ({r.size} bytes)")


class PartsReader(_Reader):
    schema = pa.schema([("path", pa.string()), ("filename", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("start", pa.int64()), ("content", pa.binary())])

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.part_bytes = int(options.get("part_bytes", 16 << 20))
        if not 0 < self.part_bytes <= 1 << 30:
            raise ValueError("part_bytes must be positive and at most 1 GiB, as a part is one value")

    def partitions(self) -> list[InputPartition]:
        return pack(cut(self.files(), self.part_bytes), self.pack_bytes) or [Pack(())]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        store = open_store(self.path)[0]
        for r in partition.ranges:
            with store.open_input_file(r.place) as file:
                data = file.read_at(r.length, r.start)
            if len(data) < r.length:
                raise self.short(r)
            yield pa.RecordBatch.from_pylist([{"path": r.path, "filename": r.path.rsplit("/", 1)[-1], "size_bytes": r.size, "modified_at": r.modified, "start": r.start, "content": data}], self.schema)


class HashesReader(_Reader):
    schema = pa.schema([("path", pa.string()), ("filename", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string()), ("modified_at", pa.timestamp("us", "UTC"))])

    def partitions(self) -> list[InputPartition]:
        return pack(self.files(), self.pack_bytes) or [Pack(())]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        store = open_store(self.path)[0]
        for r in partition.ranges:
            digest, left = hashlib.sha256(), r.size
            with store.open_input_stream(r.place) as file:
                while left and (data := file.read(min(PIECE, left))):
                    digest.update(data)
                    left -= len(data)
            if left:
                raise self.short(r)
            yield pa.RecordBatch.from_pylist([{"path": r.path, "filename": r.path.rsplit("/", 1)[-1], "size_bytes": r.size, "sha256": digest.hexdigest(), "modified_at": r.modified}], self.schema)


class FileParts(DataSource):
    """spark.read.format("file_parts").load(path): options glob, larger_than, part_bytes, pack_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return "path string, filename string, size_bytes long, modified_at timestamp, start long, content binary"

    def reader(self, schema: Any) -> DataSourceReader:
        return PartsReader(self.options)


class FileHashes(DataSource):
    """spark.read.format("file_hashes").load(path): options glob, larger_than, at_most, pack_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "path string, filename string, size_bytes long, sha256 string, modified_at timestamp"

    def reader(self, schema: Any) -> DataSourceReader:
        return HashesReader(self.options)


def file_parts(spark: SparkSession, path: str, glob: str = "*", part_bytes: int = 16 << 20, larger_than: int = -1) -> DataFrame:
    """The bytes of files of any size: a row for each part_bytes of a file, with path, filename, size_bytes, modified_at, start, content.

    A file's parts are spread over tasks and a task holds one part at a time. An empty file is one row with empty content; a file that became shorter since it
    was listed is an error. The driver holds the list of files, as it does for Spark's own file sources. Only files larger than larger_than are read.
    """
    spark.dataSource.register(FileParts)
    return spark.read.format("file_parts").option("glob", glob).option("part_bytes", part_bytes).option("larger_than", larger_than).load(path)


def file_hashes(spark: SparkSession, path: str, glob: str = "*", larger_than: int = -1, step: int = STEP) -> DataFrame:
    """path, filename, size_bytes, sha256, modified_at of files of any size, each read once in pieces of 8 MiB; small files share tasks.

    SHA-256 is sequential, so a file of more than step bytes is read by one task after another: each reads step bytes and hands on the hash's state (112 bytes). Where
    Python's OpenSSL gives no such state, the file is one task's. The driver lists the large files.
    """
    spark.dataSource.register(FileHashes)
    hashes = spark.read.format("file_hashes").option("glob", glob).option("larger_than", larger_than)
    large = list_files(path, glob, max(larger_than, step)) if _openssl() else []
    if not large:
        return hashes.load(path)
    rows = spark.createDataFrame([(i, f.path, f.place, f.size, f.modified, None) for i, f in enumerate(large)], "id int, path string, place string, size_bytes long, modified_at timestamp, state binary")
    for k in range(-(-max(f.size for f in large) // step)):
        if k and k % STEPS == 0:
            rows = written(rows, "hash-states")
        rows = rows.repartitionById(len(large), F.col("id")).mapInArrow(_stepping(path, k * step, step), rows.schema)
    out = rows.select("path", F.substring_index("path", "/", -1).alias("filename"), "size_bytes", F.udf(lambda state: _digest(_openssl(), bytes(state)))("state").alias("sha256"), "modified_at")
    return hashes.option("at_most", step).load(path).unionByName(out)


def _stepping(path: str, start: int, step: int) -> Any:
    """Takes the states of files' hashes on over the bytes from start to start + step; files that end before it are left as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, lib = open_store(path)[0], _openssl()
        if lib is None:
            raise RuntimeError("the OpenSSL of this machine's Python gives no state of a SHA-256, unlike the driver's")
        for batch in batches:
            states = []
            for place, size, state in zip(*(batch.column(c).to_pylist() for c in ("place", "size_bytes", "state")), strict=True):
                at, end = start, min(size, start + step)
                with store.open_input_file(place) as file:
                    while at < end:
                        data = file.read_at(min(PIECE, end - at), at)
                        if not data:
                            raise OSError(f"{place} is shorter than when it was listed ({size} bytes)")
                        state = _resumed(lib, state, data)
                        at += len(data)
                states.append(state)
            yield batch.set_column(batch.schema.get_field_index("state"), "state", pa.array(states, pa.binary()))

    return run
