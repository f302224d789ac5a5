"""Mixing sources to target weights by weighted sampling without replacement (exponential keys)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_quality(text: Column, size: Column) -> Column:
    """The default document weight: longer texts up to a plateau; a quarter where words are oddly short or long."""
    plausible = F.char_length(text).between(3 * size, 13 * size)
    return F.greatest(size, F.lit(1)) / (F.greatest(size, F.lit(1)) + 50) * F.when(plausible, 1.0).otherwise(0.25)


def source_targets(sources: DataFrame, weights: Sequence[float], ratio: float, most: float) -> DataFrame:
    """Add target to a table with a row for each source (source, source_size).

    The sources in code point order, null last, have the weights in turn and share ratio times all sizes; none gets
    over `most` times its size, the excess goes to the others by weight. Sorted by cap / weight, the capped sources
    are a prefix, so one pass of running sums gives the fixed point. One row a source: these windows see no documents.
    """
    whole = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    by_ratio = whole.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    out = sources.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(most))
    out = out.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("level", (F.sum("source_size").over(whole) * float(ratio) - F.col("before")) / F.col("left"))
    level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("left"), F.col("level")))).over(whole)
    return out.withColumn("final", level["level"]).withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("final")), F.col("cap"))).drop("before", "left", "level", "final")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    quality=length_quality,
    boundary: str = "split",
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Say for every row how many of its words the mix takes.

    Each source has a target (source_targets). Complete epochs come first: every document once for each whole multiple
    of the source's size that the target holds. The rest is a sample without replacement: documents sorted by
    -ln(u) / quality, u from a hash of seed and id, taken until the budget is full. boundary="split": the last
    one gives just the words that still fit; "nearest": it is taken whole if more than half of it fits.

    The prefix sum of a source runs over range partitions of (source, key): each is summed by itself, then the sums of
    the partitions are, so that no source meets in one task. quality(text, size) is a column of positive weights.

    Returns id, source, size, source_size, target, taken. Null or empty text: size 0, taken 0. Null is a source of
    its own. Rows that repeat an id have the same key and are told apart by their size only: which of two
    equal rows comes first makes no difference. An empty table gives an empty result; other columns are not read.
    """
    if boundary not in ("split", "nearest"):
        raise ValueError("boundary is split or nearest")
    spark = docs.sparkSession
    raw = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("t"), word_count(F.col(text)).alias("size"))
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(hexed, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))
    base = written(raw.select("id", "source", "size", (-F.log(u) / F.coalesce(quality(F.col("t"), F.col("size")), F.lit(1e-3))).alias("key")), "mix-sizes")

    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, ratio, most)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(base.repartitionByRange(parts, "source", "key", "id", "size").withColumn("part", F.spark_partition_id()), "mix-sorted")
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts_of = (
        dealt.groupBy("source", "part").agg(F.sum("size").alias("in_part"))
        .withColumn("part_before", F.coalesce(F.sum("in_part").over(by_part), F.lit(0)))
        .alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select(F.col("p.source").alias("of"), F.col("part").alias("of_part"), "part_before", "source_size", "target")
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("own_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts_of, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    epochs = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    free = F.floor(F.col("target") - epochs * F.col("source_size")) - F.col("part_before") - F.col("own_before")
    if boundary == "split":
        extra = F.greatest(F.lit(0), F.least(F.col("size"), free))
    else:
        extra = F.when(2 * free >= F.col("size"), F.col("size")).otherwise(0)
    return rows.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", (epochs * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it (whole documents, boundary="nearest").

    Documents without words are in no mix. Copies of a row are made by the task that holds it. Rows that repeat id, source and
    size are taken alike, as often as the one that is taken most.
    """
    plan = mix_sources(docs, boundary="nearest", id=id, text=text, source=source, **how).filter(F.col("taken") > 0)
    times = plan.groupBy(F.col(id).alias("id"), F.col(source).alias("source"), "size").agg(F.max(F.expr("int(taken div size)")).alias("times")).alias("p")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("p.id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    return rows.join(times, same).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
