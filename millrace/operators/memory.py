"""The memory of questions asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def theme_summary(memory: DataFrame) -> DataFrame:
    return memory.filter("theme IS NOT NULL").groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 2).alias("avg_confidence"), F.max("created_at").alias("last_asked")).orderBy(F.desc("n"), "theme")


def memory_stats(memory: DataFrame) -> DataFrame:
    return memory.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("theme").alias("themes"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.count_if("led_to_analysis").alias("analyses"))


def curiosity(memory: DataFrame, rows: int = 20, most: int = 20) -> DataFrame:
    """Follow-up questions of the newest rows that have some: each string once, where it comes first; `most` of them."""
    newest = memory.filter(F.size("follow_ups") > 0).orderBy(F.desc("created_at"), F.desc("id")).limit(rows)
    asked = newest.select("created_at", "id", F.posexplode("follow_ups").alias("place", "question"))
    order = [F.desc("created_at"), F.desc("id"), F.asc("place")]
    first = asked.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy(*order))).filter("n = 1")
    return first.orderBy(*order).limit(most).select("question", "id", "place")


def unexplored(memory: DataFrame, most: int) -> DataFrame:
    """Follow-up questions never asked (in any case), the newest first; repeats stay."""
    asked = memory.select(F.lower("question").alias("low"))
    rows = memory.select("created_at", "id", F.posexplode("follow_ups").alias("place", "question")).withColumn("low", F.lower("question"))
    return rows.join(asked, "low", "left_anti").orderBy(F.desc("created_at"), F.desc("id"), "place").limit(most).select("question", "id", "place")


def list_memory(memory: DataFrame, most: int, theme: str | None = None) -> DataFrame:
    rows = memory if theme is None else memory.filter(F.col("theme") == theme)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", "question", F.substring("answer", 1, 500).alias("answer"), "theme", "created_at")
