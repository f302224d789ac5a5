"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import discard, shared_dir, slices, written

__all__ = ["discard", "shared_dir", "slices", "written"]  # with the helpers below

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row a key, evenly even if one key holds most rows: weight, a column of table,
    is how many rows a key has. A key with over 1 / (4 * shuffle partitions) of all rows is hot; so there are fewer than that
    many hot keys, whatever the size of the data. Their table rows (small ones: ids, counts) are broadcast, and the rows of
    hot keys are never shuffled. The other keys are shuffled. weight is dropped. how: inner or left."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) > max(1, total // (4 * parts))).drop(weight)
    cold = table.filter(F.col(weight) <= max(1, total // (4 * parts))).drop(weight)
    apart = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(apart.join(cold, keys, how))


_HELD: dict[Hashable, Any] = {}


def worker_cache(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker holds between tasks: one object at a time. Workers outlive stages, so the next operator that
    asks frees what the one before it remembered."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() has a fast path for texts that are all ASCII, where it means the same."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of structs that begin with start and the kind's rank, by these, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
