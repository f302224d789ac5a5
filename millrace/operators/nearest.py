"""Exact nearest vectors by angle, with cells around pivots whose bounds leave most products out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import discard, written

#: Cells at most (their pivots and bounds are broadcast), and rows that make a cell worth while.
CELLS, ROWS_A_CELL = 512, 64
#: Queries and rows whose products a task holds at a time.
PIECE = 512, 2048
#: What rounding may do to an angle.
SLACK = 1e-6


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack(column.to_numpy())
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _assign(batches: Iterator[pd.DataFrame], pivots: Any) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            v = _unit(batch.v)
            near = v @ pivots.value.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1))
            yield batch.assign(v=list(v), cell=cell.astype(np.int32), angle=angle)


def _scan(batches: Iterator[pd.DataFrame], shared: Any, k: int, timed: bool) -> Iterator[pd.DataFrame]:
    """The k nearest rows of a task's share for each query of a block among the cells it may look into; ties at the edge
    stay, for the id to settle. Queries and rows meet in pieces of bounded size; what is held is cut to k rows a query as soon as it is some times that, and its
    k-th scores keep out the rest."""
    ids, queries, times, allowed = shared.value
    best: list[pd.DataFrame] = []
    floor, held = np.full(len(ids), -np.inf), 0
    for batch in batches:
        for cell, rows in batch.groupby("cell", sort=False):
            asked = np.flatnonzero(allowed[:, cell])
            if not len(asked):
                continue
            v, names, t = np.stack(rows.v.to_numpy()), rows.id.to_numpy(), rows.t.to_numpy()
            for i, j in product(range(0, len(asked), PIECE[0]), range(0, len(v), PIECE[1])):
                some, here = asked[i : i + PIECE[0]], slice(j, j + PIECE[1])
                scores = queries[some] @ v[here].T
                if timed:
                    scores[t[here][None, :] >= times[some][:, None]] = -np.inf
                last = scores.shape[1] - min(k, scores.shape[1])
                edge = np.maximum(np.partition(scores, last, axis=1)[:, last], floor[some])
                q, c = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
                best.append(pd.DataFrame({"q": some[q], "id": names[here][c], "score": scores[q, c]}))
                held += len(q)
                if held > 4 * k * len(ids):
                    best = [_cut(pd.concat(best), k)]
                    held = len(best[0])
                    least = best[0].groupby("q").score.agg(["min", "size"])
                    full = least[least["size"] >= k]
                    floor[full.index.to_numpy()] = full["min"].to_numpy()
    if best:
        out = _cut(pd.concat(best), k)
        yield out.assign(q=np.array(ids, object)[out.q.to_numpy()])


def _cut(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.sort_values(["q", "score", "id"], ascending=[True, False, True])
    return rows[rows.groupby("q").cumcount() < k]


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(asked: DataFrame, size: int) -> list[DataFrame]:
    """Queries (with their cell) in blocks of about size, neighbours together: cells in order, a large one in several parts."""
    blocks: list[tuple[list[int], int, int]] = []  # cells, parts, part
    held: list[int] = []
    room = size
    for cell, n in sorted((r["cell"], r["count"]) for r in asked.groupBy("cell").count().collect()):
        if n > size:
            parts = -(-n // size)
            blocks += [([cell], parts, p) for p in range(parts)]
            continue
        if n > room:
            blocks.append((held, 1, 0))
            held, room = [], size
        held, room = [*held, cell], room - n
    if held:
        blocks.append((held, 1, 0))
    return [asked.filter(F.col("cell").isin(cells) & (F.pmod(F.xxhash64("q"), F.lit(parts)) == part)) for cells, parts, part in blocks]


def nearest(wanted: DataFrame, rows: DataFrame, k: int, timed: bool, least: float | None, block: int, effort: list[tuple[int, int]] | None = None) -> DataFrame:
    """q, id, score, rank: the k rows (id, v, t) of the largest cosine for each query (q, v, t); timed: only rows with a smaller t.

    Rows are put into cells around pivots (rows chosen by a hash, CELLS at most) and written in the order of (cell, angle), so that a cell with very many
    rows is dealt over tasks and a scan opens only the files of the cells it needs. A cell knows its angles and its earliest
    time. By the triangle rule no row of a cell is nearer to a query than the query's angle to the pivot allows. Queries come in
    blocks of neighbours, one after the other, each of a bounded size: a block first looks into its nearest cells, as many as hold k rows; then into those
    whose bound reaches its k-th score, and no others. Rows, pivots and queries are compared in double precision.
    effort gets, for each scan, the products made and those that comparing everything would take.
    """
    spark, n = rows.sparkSession, rows.count()
    schema = f"q {dict(wanted.dtypes)['q']}, id {dict(rows.dtypes)['id']}, score double"
    empty = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    if not n:
        return empty
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(CELLS, n // ROWS_A_CELL))).select("v").toPandas()
    pivots = _unit(chosen.v)
    shared = spark.sparkContext.broadcast(pivots)
    place = partial(_assign, pivots=shared)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = lambda df, name: f"{name} {dict(df.dtypes)[name]}, v array<double>, t double, cell int, angle double"
    placed = rows.mapInPandas(place, kinds(rows, "id")).repartitionByRange(parts, "cell", "angle").sortWithinPartitions("cell", "angle")
    placed = written(placed, "cells")
    asked = written(wanted.mapInPandas(place, kinds(wanted, "q")), "asked")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("t").alias("t")).collect()
    size, low, high, first = (np.zeros(len(pivots)) for _ in range(4))
    for r in stats:
        size[r["cell"]], low[r["cell"]], high[r["cell"]], first[r["cell"]] = r["n"], r["low"], r["high"], r["t"]

    out = empty
    for some in _blocks(asked, block):
        held = some.toPandas()
        ids, times = held.q.tolist(), held.t.to_numpy(float)
        queries = np.stack(held.v.to_numpy())
        angle = np.arccos(np.clip(queries @ pivots.T, -1, 1))
        bound = np.cos(np.clip(np.maximum(angle - high, low - angle) - SLACK, 0, math.pi))
        open_ = np.broadcast_to(size > 0, bound.shape).copy()
        if timed:
            open_ &= first[None, :] < times[:, None]
        if least is not None:
            open_ &= bound + SLACK > least
        order = np.argsort(-np.where(open_, bound, -2), axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(np.where(open_, size, 0), order, 1), axis=1) - np.take_along_axis(size[None, :].repeat(len(ids), 0), order, 1)
        now = np.zeros_like(open_)
        np.put_along_axis(now, order, before < k, 1)
        now &= open_
        best = _scanned(placed, ids, queries, times, now, k, timed, schema)
        floor = np.full(len(ids), -2.0)
        at = {q: i for i, q in enumerate(ids)}
        for r in best.filter(F.col("rank") == k).select("q", "score").collect():
            floor[at[r["q"]]] = r["score"]
        later = open_ & ~now & (bound + SLACK >= floor[:, None])
        if later.any():
            more = _scanned(placed, ids, queries, times, later, k, timed, schema)
            best = written(_best(best.drop("rank").unionByName(more.drop("rank")), k), "nearest")
        if effort is not None:
            effort.append((int((now | later).dot(size).sum()), len(ids) * n))
        out = out.unionByName(best)
    shared.destroy()
    discard(asked)
    return out if least is None else out.filter(F.col("score") > least)


def _scanned(placed: DataFrame, ids: list, queries: np.ndarray, times: np.ndarray, allowed: np.ndarray, k: int, timed: bool, schema: str) -> DataFrame:
    cells = np.flatnonzero(allowed.any(axis=0)).tolist()
    shared = placed.sparkSession.sparkContext.broadcast((ids, queries, times, allowed))
    found = placed.filter(F.col("cell").isin(cells)).select("id", "v", "t", "cell").mapInPandas(partial(_scan, shared=shared, k=k, timed=timed), schema)
    out = written(_best(found, k), "nearest")
    shared.destroy()
    return out
