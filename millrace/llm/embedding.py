"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from millrace.llm.common import spread_join, written
from millrace.llm.components import connected_components

#: Numbers in a block, of which a task holds two: each row is sent once for each block of its part of a cell, so small blocks cost disk. Rows and columns of a
#: product. How many times the wanted rows a cell has that is split. Rows on which it is estimated what cells leave out.
BLOCK, PIECE, LARGE, TRIED = 3 << 20, (1024, 4096), 8, 4096


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors: unit centroids, none empty."""
    pick = np.random.default_rng(seed)
    centres = sample[pick.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def useful_cells(sample: np.ndarray, cells: int, least: float, rows: int) -> np.ndarray:
    """The centroids of the sample, or its first vector alone where they don't pay: where `rows` vectors like these would come to twice as many rows
    for all blocks as without cells, or to over half of the products. Vectors that lie in all directions alike visit nearly all cells."""
    centres = fit_cells(sample, cells)
    tried, block = sample[:: -(-len(sample) // TRIED)], max(PIECE[0], BLOCK // sample.shape[1])
    _, cell, home = _visits(tried, centres, least)
    scale = rows / len(tried)
    there, own = (np.bincount(c, minlength=len(centres)) * scale for c in (cell, cell[home]))
    sent = lambda n: (n * np.maximum(1, np.ceil(n / block))).sum()
    pays = sent(there) <= 2 * sent(np.array([rows])) and (own * (there - own / 2)).sum() <= rows * rows / 4
    return centres if pays else sample[:1]


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _units(vectors: pd.Series) -> np.ndarray:
    return _unit_rows(np.stack(vectors.to_numpy()))


def _visits(units: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's home (its nearest centroid), for each cell where a row must be compared.

    A row x at home in i also visits a later cell j if some y with cosine >= least to x can be at home in j. For that
    (c_j - c_i).y >= 0 must be possible: with d = c_j - c_i, the angle between x and the plane d.y = 0 is at most
    acos(least). So the cells lose no pair, and each pair meets once.
    """
    sims = units @ centres.T
    home = sims.argmax(axis=1)
    a = sims - sims[np.arange(len(units)), home][:, None]
    d2 = (2 - 2 * centres @ centres.T)[home]
    b = np.sqrt(np.maximum(d2 - a * a, 0))
    slope = math.sqrt(max(0.0, 1 - least * least)) / least if least > 0 else math.inf
    near = -a <= slope * b + 1e-9
    near &= np.arange(len(centres))[None, :] > home[:, None]
    row, cell = np.nonzero(near)
    return np.concatenate([np.arange(len(units)), row]), np.concatenate([home, cell]), np.concatenate([np.ones(len(units), bool), np.zeros(len(row), bool)])


def _join(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put a[i] and b[i] into one set: low is each row's first row of its set, before and after."""
    while (open_ := low[a] != low[b]).any():
        a, b = a[open_], b[open_]
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while ((up := low[low]) != low).any():
            low[:] = up


def _compare(group: pa.Table, least: float) -> pa.Table:
    """Links inside a block, or between two: for each linked row, copies of its partners and a smaller reachable id. Two rows
    count where one at least is at home, in the cell and in the part of the cell: so they meet once. Products come in pieces, so
    that neither the pairs of two blocks nor their products are ever held together."""
    group = group.sort_by("rep").combine_chunks()
    column = lambda name: group[name].combine_chunks().to_numpy(zero_copy_only=False)
    rep, copies, part, at_home, in_part = (column(c) for c in ("rep", "copies", "part", "at_home", "in_part"))
    p, q = group["p"][0].as_py(), group["q"][0].as_py()
    units = _unit_rows(group["v"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1))
    left, right = np.nonzero(part == p)[0], np.nonzero(part == q)[0]
    links, low, linked = np.zeros(len(rep), np.int64), np.arange(len(rep)), np.zeros(len(rep), bool)
    for c in range(0, len(right), PIECE[1]):
        there = right[c : c + PIECE[1]]
        across = units[there].T
        for r in range(0, min(len(left), c + PIECE[1]) if p == q else len(left), PIECE[0]):
            here = left[r : r + PIECE[0]]
            i, j = np.nonzero(units[here] @ across >= least)
            i, j = here[i], there[j]
            met = (at_home[i] | at_home[j]) & (in_part[i] | in_part[j])
            if p == q:
                met &= i < j
            i, j = i[met], j[met]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            linked[i] = linked[j] = True
            _join(low, i, j)
    return pa.table({"rep": rep[linked], "links": links[linked], "root": rep[low[linked]]}, pa.schema([(c, pa.int64()) for c in ("rep", "links", "root")]))


def _split(rows: DataFrame, least: float, cell_rows: int, most_cells: int, sample: int) -> DataFrame:
    """The second level: add sub and in_part. A cell of over LARGE * cell_rows rows has centroids of its own, fitted on about `sample` of
    its rows at most (by a hash), most_cells of them at most; its rows are assigned by tasks that hold a part of the cell and
    those centroids. Rows of smaller cells, and of those that its own centroids would not help (useful_cells), are in one part."""
    key = ["label", "dim", "cell"]
    sizes = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    whole = rows.withColumn("sub", F.lit(0).cast("long")).withColumn("in_part", F.lit(True))
    large = sizes.filter(F.col("n") > LARGE * cell_rows)
    if large.isEmpty():
        return whole

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        wanted = int(min(most_cells, max(2, group.n.iat[0] // cell_rows)))
        centres = useful_cells(_units(group.v), wanted, least, int(group.n.iat[0]))
        if len(centres) < 2:
            return pd.DataFrame(columns=[*key, "centres"])
        return pd.DataFrame({"label": group.label.iat[0], "dim": group.dim.iat[0], "cell": group.cell.iat[0], "centres": [centres.ravel()]})

    there = spread_join(rows, large.withColumn("load", F.col("n")), key, "load").withColumn("turn", F.pmod(F.xxhash64("rep", F.lit("sub")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    some = there.filter(F.col("turn") < F.lit(float(sample)) / F.col("n")).select(*key, "n", "v")
    own = written(some.groupBy(*key).applyInPandas(fitted, "label string, dim long, cell long, centres array<double>"), "centres")
    if own.isEmpty():
        return whole
    large = written(large.join(own.select(*key), key, "left_semi"), "cells-split")
    small = spread_join(whole, sizes.join(large.select(*key), key, "left_anti"), key, "n")
    spots = large.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / sample).cast("long"))).alias("spot"))
    near = own.join(spots, key)
    dealt = spread_join(rows, large.withColumn("load", F.col("n")), key, "load").withColumn("spot", F.pmod(F.xxhash64("rep"), F.floor(F.col("n") / sample).cast("long") + 1))
    kind = rows.schema["v"].dataType.simpleString()

    def assign(group: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        flat = np.asarray(centres.centres.iat[0]).reshape(-1, int(group.dim.iat[0])) if len(group) and len(centres) else np.zeros((0, 1))
        if not len(flat):  # a cell whose sample is empty is one part
            return pd.DataFrame({c: group[c] for c in ("label", "dim", "cell", "at_home", "rep", "copies", "v")} | {"sub": 0, "in_part": True})
        row, sub, home = _visits(_units(group.v), flat, least)
        out = group.iloc[row]
        return pd.DataFrame({"label": out.label, "dim": out.dim, "cell": out.cell, "at_home": out.at_home, "rep": out.rep, "copies": out.copies, "v": out.v, "sub": sub, "in_part": home})

    schema = f"label string, dim long, cell long, at_home boolean, rep long, copies long, v {kind}, sub long, in_part boolean"
    parted = dealt.drop("n").groupBy(*key, "spot").cogroup(near.groupBy(*key, "spot")).applyInPandas(assign, schema)
    return written(small.select(*parted.columns).unionByName(parted), "parts")


def near_duplicates(vectors: DataFrame, least: float = 0.98, id: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = 20_000, cell_rows: int = 1500, most_cells: int = 1024) -> DataFrame:
    """Link vectors of the same label whose cosine is at least `least`; find groups and the vector that stays of each.

    1. Equal vectors of a label become one row with a count, by an aggregation; a group of copies of any size is then
       one row. 2. Cells come from spherical k-means on a bounded sample (about `sample` vectors; a cell for each
       cell_rows vectors of a label, most_cells at most: the centroids are what is broadcast), where they leave products out (useful_cells); else
       a label is one cell. 3. Each row goes to its cell and to those that could hold a partner (see _visits: no pair is lost). Cells that are still
       large are split once more in the same way, by centroids of their own (see _split): cells grow with the data up to most_cells ** 2, about
       1.5 thousand million vectors a label at the defaults. 4. A part of a cell is cut into blocks of BLOCK numbers at most (49,152 vectors of 64), and each pair of
       blocks is a group of its own, so no cell is whole in one task. Each row is sent to as many groups as its part has blocks. A task gives a row for
       each linked row, not for each pair. 5. Groups are connected components.

    Vectors that lie in all directions alike are all compared, n * n / 2 products a label, and are sent once for each block of their label: memory is bounded, time and disk are not.
    Returns id, n_links (other vectors linked directly), component_id (smallest id reachable), kept (id is that).
    Vectors that are null, empty or zero or hold null or non-finite components, and rows whose label or id is null, link
    with nothing; vectors of different length never link. Rows that repeat an id count as vectors of their own.
    Vectors find their copies' row again by 128 bits of hashes. An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    given = vectors.schema[vector].dataType
    kind = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"  # as they come; products are in double
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.transform(F.col(vector).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    key = ["k1", "k2"]
    valid = rows.filter(good).select("id", "label", "v", *(F.xxhash64("label", "v", F.lit(seed)).alias(k) for seed, k in enumerate(key)))
    reps = written(valid.groupBy("label", "v", *key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")

    total, labels = reps.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    share = min(1.0, sample / max(total, 1))
    chance = F.pmod(F.xxhash64("rep", F.lit("cells")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = [np.array(r["v"]) for r in reps.filter(chance < share).select("v").collect()]
    cells = max(1, min(most_cells, total // max(1, labels * cell_rows)))
    centres = {d: useful_cells(_units(pd.Series([v for v in chosen if len(v) == d])), cells, least, total // max(1, labels)) for d in {len(v) for v in chosen}}
    centres = {d: c for d, c in centres.items() if len(c) > 1}
    held = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch.v.map(len)):
                units = _units(part.v)
                row, cell, home = _visits(units, held.value[d], least) if d in held.value else (np.arange(len(part)), np.zeros(len(part), int), np.ones(len(part), bool))
                out = part.iloc[row]
                yield pd.DataFrame({"label": out.label.astype(str), "dim": d, "cell": cell, "at_home": home, "rep": out.rep, "copies": out.copies, "v": out.v})

    plain = reps.select(F.col("label").cast("string").alias("label"), "rep", "copies", "v")
    if centres:
        placed = written(plain.mapInPandas(assign, f"label string, dim long, cell long, at_home boolean, rep long, copies long, v array<{kind}>"), "cells")
    else:
        placed = plain.select("label", F.size("v").cast("long").alias("dim"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("at_home"), "rep", "copies", "v")
    parted = _split(placed, least, cell_rows, most_cells, sample)
    spot = ["label", "dim", "cell", "sub"]
    # two blocks at least where there are rows for two, so that the groups of a few labels are enough tasks
    most = F.greatest(F.lit(PIECE[0]), F.floor(F.lit(BLOCK) / F.col("dim")))
    count = F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(2), F.ceil(F.col("n") / PIECE[0])))
    blocks = written(parted.groupBy(*spot).agg(F.count(F.lit(1)).alias("n")).select("*", count.alias("blocks"), F.monotonically_increasing_id().alias("at")), "blocks")
    dealt = spread_join(parted, blocks, spot, "n").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("at", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "at_home", "in_part", "rep", "copies", "v")
    # by number: a task's time grows with the square of its rows, so tasks are not to be put together by their bytes
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "at", "p", "q")
    found = met.groupBy("at", "p", "q").applyInArrow(lambda g: _compare(g, least), "rep long, links long, root long")
    found = written(found, "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found, "rep", "root")
    of_rep = reps.select("rep", "copies", *key).join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = of_rep.select(*key, "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    grouped = spread_join(valid.select("id", *key), written(of_rep, "groups"), key, "copies").select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = grouped.unionByName(alone)
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
