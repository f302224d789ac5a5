"""Exact de-duplication by 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, spread_join, written


def _hashed(docs: DataFrame, text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


#: Bits of the filter that says which hashes are held twice: what is broadcast has this bound (16 MiB), whatever the data.
FILTER_BITS = 1 << 27


def _held_twice(hashed: DataFrame, bits: int) -> DataFrame:
    """A bitmap over bits places of the hashes that more than one row has: bucket and bits of it (4 KiB each), few rows."""
    twice = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.pmod(F.xxhash64("h"), F.lit(bits)).alias("place"))
    return twice.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """Say for every row which document of its group of equal texts stays.

    Texts are equal when their bytes are, after lower-casing A-Z; null counts as empty. One scan writes each row's MD5 and SHA-256.
    Hashes are then counted; which are held twice goes to all tasks as a bitmap of a fixed size (FILTER_BITS; if it is full, more
    texts pass, no text is missed). Only texts that pass are shuffled: they are grouped by (MD5, bytes), so that texts whose 128-bit hashes collide
    stay apart. Each task first merges its own equal texts, so a group of any size sends one row a task. Members find their group
    again by MD5 and SHA-256 together, and in that join very large groups are broadcast (spread_join).

    Returns id, keep_id, group_size, kept, text_sha256. keep: "smallest" or "largest" id of the group. Rows that repeat
    an id are copies of one document: each is counted, each is marked alike. A null id stays only where all ids of its
    group are null. An empty table gives an empty result; other columns of docs are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(F.col(id).alias("id"), _hashed(docs, text).alias("t"))
    hashed = written(rows.select("id", F.unhex(F.md5("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")), "hashes")
    maps = written(_held_twice(hashed, FILTER_BITS), "held-twice")

    place = F.pmod(F.xxhash64("h"), F.lit(FILTER_BITS))
    marked = F.expr("getbit(cast(conv(hex(substring(map, cast(bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(bit % 8 as int)) = 1")
    texts = rows.select("id", "t", F.unhex(F.md5("t")).alias("h")).withColumn("bit", F.bitmap_bit_position(place)).withColumn("bucket", F.bitmap_bucket_number(place))
    passed = texts.join(F.broadcast(maps), "bucket").filter(marked)
    groups = passed.groupBy("h", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.filter("group_size > 1").select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size"), "groups")

    found = spread_join(hashed, groups.withColumn("n", F.col("group_size")), ["h", "sha"], "n", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, one row for each group.

    One shuffle: each group's row is chosen by the aggregation that forms it. Among rows that repeat the kept id, the
    one with the smallest text by bytes stays (largest for keep="largest"); rows that are equal in all columns are one.
    """
    best = F.min_by if keep == "smallest" else F.max_by
    clean = F.col(id).isNull() if keep == "smallest" else F.col(id).isNotNull()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _hashed(docs, text).alias("t"), F.struct(clean.alias("a"), F.col(id).alias("b"), F.col(text).alias("c")).alias("at"))
    kept = rows.groupBy(F.unhex(F.md5("t")).alias("h"), "t").agg(best("row", "at").alias("row"))
    return kept.select("row.*")
