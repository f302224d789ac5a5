"""The file registry: registration without duplicates, changes, deletion, tags, listings."""

from __future__ import annotations

import base64
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def register_files(new: DataFrame, existing: DataFrame, order: str = "created_at") -> DataFrame:
    """Which of the new files are taken: columns of new, with verdict (registered, duplicate, empty) and existing_id.

    A file is a duplicate of a file in existing that is not deleted, or else of the first arrival with its hash. Only hash, id
    and arrival are shuffled, never contents, and first arrivals are an aggregation, so a hash that very many files share
    is a row from each task.
    """
    held = existing.filter("deleted_at IS NULL").groupBy("sha256").agg(F.min("file_id").alias("held_id"))
    first = new.filter("size_bytes > 0").groupBy("sha256").agg(F.min_by("file_id", F.struct(order, "file_id")).alias("first_id"))
    known = first.join(held, "sha256", "left")
    rows = new.join(known, "sha256", "left")
    empty = F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0
    verdict = F.when(empty, "empty").when(F.col("held_id").isNotNull() | (F.col("first_id") != F.col("file_id")), "duplicate").otherwise("registered")
    return rows.select(*new.columns, verdict.alias("verdict"), F.when(verdict == "duplicate", F.coalesce("held_id", "first_id")).alias("existing_id"))


def detect_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What to do for each path: full (new, or empty before), incremental (hash differs), skip (same), gone."""
    p, c = previous.alias("p"), current.alias("c")
    both = p.join(c, F.col("p.path") == F.col("c.path"), "full_outer")
    action = (
        F.when(F.col("c.path").isNull(), "gone").when(F.coalesce(F.col("p.size_bytes"), F.lit(0)) == 0, "full")
        .when(F.col("p.sha256").eqNullSafe(F.col("c.sha256")), "skip").otherwise("incremental")
    )
    return both.select(F.coalesce("c.path", "p.path").alias("path"), action.alias("action"))


def soft_delete(files: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """files with deleted_at and status set for the ids; rows deleted before keep their time."""
    marked = files.join(ids.select("file_id").distinct().withColumn("_hit", F.lit(True)), "file_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull()
    changed = {"deleted_at": F.when(hit, at).otherwise(F.col("deleted_at")), "status": F.when(hit, "deleting").otherwise(F.col("status"))}
    return marked.withColumns(changed).select(*files.columns)


def reprocess_queue(files: DataFrame, documents: DataFrame, version: int) -> DataFrame:
    """Files to process again, reset to pending: processed or failed, not deleted, with a current document older than version."""
    old = documents.filter(F.col("is_current") & (F.col("version") < version)).select(F.col("source_file_id").alias("file_id"))
    ready = files.filter(F.col("status").isin("processed", "failed") & F.col("deleted_at").isNull())
    return ready.join(old, "file_id", "left_semi").withColumn("status", F.lit("pending"))


def upsert_tags(tags: DataFrame, assignments: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """New tags and new links for comma lists of names (file_id, names): trimmed, lower-cased, cut, without empty ones."""
    names = assignments.select("file_id", F.explode(F.split("names", ",")).alias("name")).select("file_id", F.substring(F.lower(F.trim("name")), 1, most).alias("name")).filter("name <> ''").distinct()
    made = names.select("name").distinct().join(tags.select("name"), "name", "left_anti")
    return made, names


def new_links(names: DataFrame, links: DataFrame) -> DataFrame:
    """The links (file_id, name) that are not there yet."""
    return names.join(links, ["file_id", "name"], "left_anti")


def replace_tags(links: DataFrame, wanted: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links after files in wanted (file_id, name) got just these tags, and the wanted rows whose tag is unknown."""
    good = wanted.join(tags.select("name"), "name", "left_semi").select("file_id", "name").distinct()
    kept = links.join(wanted.select("file_id").distinct(), "file_id", "left_anti").select("file_id", "name")
    return kept.unionByName(good), wanted.join(tags.select("name"), "name", "left_anti").select("file_id", "name")


def tag_counts(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Files of each tag, unused tags included."""
    counted = links.groupBy("name").agg(F.count("file_id").alias("n"))
    return tags.select("name").join(counted, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("file_count")).orderBy(F.desc("file_count"), "name")


def encode_cursor(last: Any, id: Any) -> str:
    return base64.urlsafe_b64encode(json.dumps([last, id]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[Any, Any]:
    last, id = json.loads(base64.urlsafe_b64decode(cursor))
    return last, id


def list_rows(rows: DataFrame, order: str, id: str, limit: int, descending: bool = True, after: str | None = None, equal: dict[str, Any] | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """One page: filters, keyset cursor on (order, id), limit + 1 rows read so that has_more is known; ties are kept by id."""
    out = rows.filter(F.col("deleted_at").isNull()) if "deleted_at" in rows.columns else rows
    for column, value in (equal or {}).items():
        out = out.filter(F.col(column) == value)
    if tagged is not None:
        out = out.join(tagged.select(id).distinct(), id, "left_semi")
    if after is not None:
        last, at = decode_cursor(after)
        value, bound = F.col(order), F.lit(last).cast(rows.schema[order].dataType)
        out = out.filter(((value < bound) if descending else (value > bound)) | ((value == bound) & ((F.col(id) < at) if descending else (F.col(id) > at))))
    keys = [F.desc(order), F.desc(id)] if descending else [F.asc(order), F.asc(id)]
    page = out.orderBy(*keys).limit(limit + 1)
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))
    seen = page.withColumn("_at", at).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit)
    return seen.filter(F.col("_at") <= limit).drop("_at")
