"""Statistics of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(documents: DataFrame) -> DataFrame:
    return documents.filter("is_current").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def documents_by_month(documents: DataFrame, months: int = 12) -> DataFrame:
    """Current documents by month: the oldest `months` months, ascending."""
    return documents.filter("is_current").groupBy(F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy("month").limit(months)


def collection_stats(documents: DataFrame, chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """One row for each figure: section, item, n. Each is an aggregation of its table; nothing is joined."""
    total = documents.filter("is_current").agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit("documents").alias("item"), "n")
    sizes = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit(k).alias("item"), "n") for k, t in (("chunks", chunks), ("citations", citations))]
    by = category_counts(documents).select(F.lit("category").alias("section"), F.col("category").alias("item"), "n")
    month = documents_by_month(documents).select(F.lit("month").alias("section"), F.col("month").alias("item"), "n")
    return total.unionByName(sizes[0]).unionByName(sizes[1]).unionByName(by).unionByName(month)


def entity_mention_counts(documents: DataFrame) -> DataFrame:
    """How often current documents list each (name, type)."""
    rows = documents.filter("is_current").select(F.explode("entities").alias("e"))
    return rows.groupBy(F.col("e.name").alias("name"), F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name", "type")


def file_status_counts(files: DataFrame) -> DataFrame:
    """Files that are not deleted by status, and in all (status null)."""
    return files.filter("deleted_at IS NULL").rollup("status").agg(F.count(F.lit(1)).alias("n"))


def lake_overview(files: DataFrame, documents: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: files, current documents, categories and tag names in order."""
    f = files.filter("deleted_at IS NULL").agg(F.count(F.lit(1)).alias("files"))
    d = documents.filter("is_current").agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    t = tags.agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tags"))
    return f.join(d, F.lit(True)).join(t, F.lit(True))
