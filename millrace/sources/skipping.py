"""Data skipping: what each file of a table holds, in a small table of its own, so that lookups open few files."""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap, which is 4 KiB; hashes that a value sets.
BITS, HASHES = 1 << 15, 3


def write_clustered(rows: DataFrame, path: str, key: str, files: int, mode: str = "append") -> None:
    """A lake table in so many files, each a range of the key."""
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def _places(value: Column, maps: int) -> Column:
    """Where a value's bits are, in maps bitmaps."""
    return F.array(*(F.pmod(F.xxhash64(value.cast("string"), F.lit(i)), F.lit(maps * BITS)) for i in range(HASHES)))


def index_files(spark: SparkSession, path: str, keys: list[str], maps: int = 4) -> DataFrame:
    """file, rows, and for each key its smallest and largest value (low, high), whether it is null anywhere and a Bloom filter of maps bitmaps: one row for
    each file and key, values as text but ranges by the key's own order. One pass, which tasks pre-aggregate."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), *keys)
    out = None
    for key in keys:
        ends = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"), F.count_if(F.col(key).isNull()).alias("nulls"))
        bits = rows.filter(F.col(key).isNotNull()).select("file", F.explode(_places(F.col(key), maps)).alias("place")).select("file", (F.bitmap_bucket_number("place") - 1).cast("int").alias("map"), F.bitmap_bit_position("place").alias("bit"))
        bloom = bits.groupBy("file", "map").agg(F.bitmap_construct_agg("bit").alias("bits")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("map", "bits"))).alias("bloom"))
        one = ends.join(bloom, "file", "left").select("file", F.lit(key).alias("key"), "rows", "low", "high", "nulls", "bloom", F.lit(maps).alias("maps"))
        out = one if out is None else out.unionByName(one)
    return out


def _may_hold(value: Column, kind: str) -> Column:
    """Whether a row of the index says that its file may hold a value."""
    ranged = (F.col("low").cast(kind) <= value) & (value <= F.col("high").cast(kind))

    def is_set(place: Column) -> Column:
        bits, bit = F.element_at("bloom", (F.bitmap_bucket_number(place) - 1).cast("int")), F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))

    hashed = F.pmod(F.xxhash64(value.cast("string"), F.lit(0)), F.col("maps") * BITS)
    for i in range(1, HASHES):
        ranged &= is_set(F.pmod(F.xxhash64(value.cast("string"), F.lit(i)), F.col("maps") * BITS))
    return ranged & is_set(hashed)


def lookup(spark: SparkSession, path: str, index: DataFrame, key: str, values: list[Any]) -> DataFrame:
    """The rows of the table at path whose key is one of values (a list of the caller's own size). Only files are opened that the index
    does not rule out, and files that it does not know. The result equals a full scan's."""
    table = spark.read.parquet(path)
    kind = table.schema[key].dataType
    wanted = spark.createDataFrame([(v,) for v in values if v is not None], f"v {kind.simpleString()}")
    known = index.filter(F.col("key") == key)
    some = known.join(F.broadcast(wanted), _may_hold(F.col("v"), kind.simpleString())).select("file").distinct()
    there = {_plain(r["file"]) for r in known.select("file").collect()}
    files = sorted({_plain(r["file"]) for r in some.collect()} | ({_plain(f) for f in table.inputFiles()} - there))
    if not files or wanted.isEmpty():
        return table.limit(0)
    return spark.read.schema(table.schema).option("basePath", path).parquet(*files).join(F.broadcast(wanted.distinct()), F.col(key) == F.col("v"), "left_semi")


def _plain(file: str) -> str:
    """A local file's name has one or three slashes and some signs as %xx, as who lists it likes."""
    return re.sub(r"^file:/+", "file:/", unquote(file))
