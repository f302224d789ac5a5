"""Near-duplicate documents: an inverted join over MinHash signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, spread_join, worker_cache, written
from millrace.llm.components import connected_components

#: Words of a shingle; coordinates of a signature; how often a pair at the threshold may agree in too few of them.
WORDS, COORDINATES, LOSS = 5, 32, 2e-6
#: Rows of a block of signatures; rows and bytes of a block of sets; bytes hashed at a time.
SIGNATURE_BLOCK, SET_BLOCK, SET_BYTES, CHUNK = 1024, 256, 8_000_000, 500_000

_PICK = np.random.Generator(np.random.PCG64(20240229))
_OF_BYTE = _PICK.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BYTE[65:91] = _OF_BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _PICK.integers(1, 1 << 63, 2 * WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _PICK.integers(0, 1 << 63, COORDINATES, np.uint64)
_ODD = _PICK.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def agreements(percent: int) -> int:
    """How many coordinates must agree: the most that a pair at the threshold falls short of with a chance of LOSS at most
    (85: 16, one pair in 1.7 million; 80: 14, one in 840,000)."""
    p, short, k = percent / 100, 0.0, 0
    while k < COORDINATES and short + math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) <= LOSS:
        short += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        k += 1
    return max(1, k)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that equal bits of sums don't survive."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of the bytes, by running sums of a polynomial over the bytes of a chunk."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:  # a word is in one chunk
            end += 1
        part = data[at:end]
        power = np.full(len(part) + 1, _BASE)
        power[0] = 1
        back = np.full(len(part) + 1, _UNBASE)
        back[0] = 1
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(_OF_BYTE[part] * power[:-1])])
        word = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        starts.append(first + at)
        hashes.append(_mixed((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)))
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes."""
    raw = [t.encode() for t in texts]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, words = _word_hashes(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    cut = np.searchsorted(starts, begins)
    whole = len(words) - WORDS + 1
    flat = _mixed(sum((words[i : whole + i] * _PLACE[i] for i in range(WORDS)), np.zeros(max(whole, 0), np.uint64))) if whole > 0 else words[:0]
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(flat[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mixed(np.atleast_1d((words[a:b] * _PLACE[WORDS : WORDS + b - a]).sum(dtype=np.uint64) + np.uint64(b - a))))
        else:
            out.append(words[:0])
    return out


def _signature(values: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(values), 8192):
        low = np.minimum(low, ((values[None, k : k + 8192] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _key(values: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return b"".join(_mixed(values ^ _PLACE[i]).sum(dtype=np.uint64).tobytes() for i in range(2))


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sets, by slices of bounded size; the text is the last column."""
    worker_cache("sets", tuple)  # nothing of our own: frees what an operator before remembered
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for start, end in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            yield batch.slice(start, end - start), shingle_sets([t or "" for t in texts.slice(start, end - start).to_pylist()])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _each_slice(batches):
        values = np.concatenate([_signature(s) if len(s) else np.zeros(COORDINATES, np.int32) for s in sets])
        signatures = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), signatures], ["id", "n", "key", "sig"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _each_slice(batches):
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "group", "key", "set"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by keys, the rows of each key together. No more than a batch and a key's rows are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True))
        cuts = np.flatnonzero(change).tolist()
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _spanning(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the linked pairs a[i], b[i] (places in ids): each place and the place of the smallest id it reaches."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            break
        low = new
    moved = low != ids
    return ids[moved], low[moved]


def _agreeing(left: np.ndarray, right: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of signatures that agree in so many coordinates at least."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, 2_000_000 // max(1, right.size))
    for k in range(0, len(left), step):
        same = (left[k : k + step, None, :] == right[None, :, :]).sum(axis=2, dtype=np.uint8) >= agree
        x, y = np.nonzero(same)
        a.append(x + k)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _overlapping(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in left and right of the pairs with 100 * shared >= percent * united, from products of membership matrices."""
    sizes = np.array([len(s) for s in sets])
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    rank = np.cumsum(often) - 1
    row, column = row[often[column]], rank[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)))
    for k in range(0, int(often.sum()), 4096):
        at = slice(*np.searchsorted(column, [k, k + 4096]))
        member = np.zeros((len(sets), 4096), np.float32)
        member[row[at], column[at] - k] = 1
        shared += member[left] @ member[right].T
    united = sizes[left][:, None] + sizes[right][None, :] - shared
    return np.nonzero(100 * shared >= percent * united)


_EDGES = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _edges(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    tokens = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
    return pa.RecordBatch.from_arrays([pa.array(tokens), *(pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (1, 2))], schema=_EDGES)


class Matcher:
    """Which rows of a block are alike: by signatures that agree, or by whole sets. Both give places of pairs."""

    def __init__(self, carried: str, least: int):
        self.carried, self.least = carried, least

    def load(self) -> Column:
        """What a row takes of a block."""
        return F.lit(1.0 / SIGNATURE_BLOCK) if self.carried == "sig" else F.greatest(F.lit(1.0 / SET_BLOCK), F.octet_length("set") / F.lit(float(SET_BYTES)))

    def rows(self, table: pa.Table) -> np.ndarray | list[np.ndarray]:
        column = table.column(self.carried)
        if self.carried == "sig":
            return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
        return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]

    def pairs(self, rows: np.ndarray | list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.carried == "sig":
            a, b = _agreeing(rows[left], rows[right], self.least)
        else:
            used = np.union1d(left, right)
            a, b = _overlapping([rows[i] for i in used], np.searchsorted(used, left), np.searchsorted(used, right), self.least)
        return left[a], right[b]


def _within(matcher: Matcher):
    """Edges that span what a block joins, one a row at most. First all rows against the block's first row (in blocks of one
    list or group, the same row for all); those alike are settled among each other, and only the rest meets all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for table in _runs(batches, ["token", "p"]):
            if table.num_rows < 2:
                continue
            rows, ids = matcher.rows(table), table.column("rep").to_numpy()
            every = np.arange(len(ids))
            a, b = matcher.pairs(rows, np.array([ids.argmin()]), every)
            rest = np.setdiff1d(every, b)
            x, y = matcher.pairs(rows, rest, every)
            found.append((table.column("token")[0].as_py(), *_spanning(np.concatenate([a, x]), np.concatenate([b, y]), ids)))
            if len(found) >= 1000:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    return run


def _across(matcher: Matcher):
    """The same between two blocks, for rows of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for table in _runs(batches, ["token", "p", "q"]):
            part, p, q = (table.column(c).to_numpy() for c in ("part", "p", "q"))
            left, right = np.flatnonzero(part == p[0]), np.flatnonzero(part == q[0])
            if len(left) and len(right):
                rows, ids, component = matcher.rows(table), table.column("rep").to_numpy(), table.column("component").to_numpy()
                a, b = matcher.pairs(rows, left, right)
                apart = component[a] != component[b]
                found.append((table.column("token")[0].as_py(), *_spanning(a[apart], b[apart], ids)))
            if len(found) >= 500:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    return run


def _upto(first: Column, end: Column) -> Column:
    """first, first + 1, ... before end."""
    return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))


def _alike(rows: DataFrame, matcher: Matcher) -> DataFrame:
    """Components (id, component) of the rows (token, rep and what matcher compares) that are alike inside one of the lists,
    the rows of a token.

    Lists are cut into blocks, each also with the list's first row, and a block is compared in itself. What this joins in the list is
    settled: all blocks' rows that reach the first row are one component. Only lists of several blocks whose rows are still in
    several components go on: blocks that hold one large component are not compared with each other, all other pairs of blocks are. So a list of n rows that are all alike
    takes n comparisons, and one of n rows with m apart from the rest about n * m; no list has a cap.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, zero, load = "token long, a long, b long", F.lit(0).cast("long"), F.sum(matcher.load())
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first"), F.ceil(load - 1e-9).alias("blocks"))
    lists = written(lists.filter("n > 1"), "lists")
    placed = spread_join(rows, lists, ["token"], "n").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    at = F.explode(F.when(F.col("rep") == F.col("first"), _upto(zero, F.col("blocks"))).otherwise(F.array("own")))
    one = placed.select("token", at.alias("p"), "rep", matcher.carried).repartition(parts, "token", "p").sortWithinPartitions("token", "p")
    near = written(one.mapInArrow(_within(matcher), pairs), "near")
    long = lists.filter("blocks > 1").select("token", "n")
    if long.isEmpty():
        return connected_components(near)

    held = spread_join(rows, long, ["token"], "n").join(near.select("token", F.col("a").alias("rep"), F.col("b").alias("component")).groupBy("token", "rep").agg(F.min("component").alias("component")), ["token", "rep"], "left")
    held = held.withColumn("component", F.coalesce("component", "rep"))
    sizes = written(held.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"), load.alias("load")), "list-components")
    # the blocks of a list: first those with the rows of small components, then those of each large one
    mixed = F.ceil(F.sum(F.when(F.col("load") <= 1, F.col("load")).otherwise(0.0)) - 1e-9).alias("mixed")
    open_ = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("components"), mixed).filter("components > 1")
    turn = Window.partitionBy("token").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = sizes.filter("load > 1").withColumn("blocks", F.ceil("load")).withColumn("before", F.coalesce(F.sum("blocks").over(turn), zero))
    ends = large.groupBy("token").agg(F.sum("blocks").alias("larges"))
    plan = sizes.join(open_, "token").join(ends, "token", "left").join(large.select("token", "component", "blocks", "before"), ["token", "component"], "left")
    counts = F.coalesce("blocks", zero).alias("blocks"), (F.col("mixed") + F.coalesce("before", zero)).alias("low"), (F.col("mixed") + F.coalesce("larges", zero)).alias("all")
    plan = written(plan.select("token", "component", "n", "mixed", *counts), "plan")
    if plan.isEmpty():
        return connected_components(near)
    there, high = spread_join(held, plan, ["token", "component"], "n"), F.col("low") + F.col("blocks")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1)))
    own = F.when(F.col("blocks") > 0, F.col("low") + place(F.col("blocks"))).otherwise(place(F.col("mixed")))
    others = F.when(F.col("blocks") > 0, F.concat(_upto(zero, F.col("low")), _upto(high, F.col("all")))).otherwise(_upto(zero, F.col("all")))
    there = there.withColumn("part", own).withColumn("other", F.explode(others))
    two = there.select("token", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "rep", "component", matcher.carried)
    far = two.repartition(parts, "token", "p", "q").sortWithinPartitions("token", "p", "q").mapInArrow(_across(matcher), pairs)
    return connected_components(written(near.unionByName(far), "alike"))


def near_duplicates(docs: DataFrame, percent: int = 85, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose sets of five-word shingles are similar (100 * shared >= percent * united); find groups.

    1. One scan gives each document its set's size, 128-bit key and signature; documents with the same set are one from
       here on, by an aggregation. 2. Each document is posted under coordinate-value pairs: its rarest ones, as
       many as leave one fewer than must agree (agreements). Two signatures that agree so often share one of these (the
       prefix); the lists of the common pairs are skipped, and what a candidate shares with them is counted from its
       signature. 3. Inside a list, collisions are counted by blocks (see _alike), which gives edges that span what
       agrees. 4. Inside the groups that these edges join, whole sets are compared in the same way. There a document
       is listed under the class of its set's size and the next (classes are percent wide), since sets of more different
       sizes cannot be similar. 5. Groups are connected components of those exact links.

    Nothing is emitted for each pair, no list or group is whole in one task, and no list has a cap. A group of n texts that
    are all alike takes about n comparisons in steps 3 and 4; what is in one group, but not linked, is compared in pairs.
    Links hold on 64-bit hashes of shingles.

    Returns id, n_shingles, component_id (smallest id reachable), kept (id is that). Words are runs without ASCII white
    space, A-Z lower-cased; a text of fewer than five words is one shingle; one without words, or null, is empty and links
    with nothing, nor does a row with a null id. Rows that repeat an id are one vertex. An empty table gives an
    empty result; other columns are not read. Ids are long.
    """
    agree = agreements(percent)
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    base = written(source.mapInArrow(_sign, "id long, n long, key binary, sig array<int>"), "signatures")
    own = F.col("id").isNotNull() & (F.col("n") > 0)
    reps = written(base.filter(own).groupBy("key", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "sets")

    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = reps.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", token.alias("token"))
    common = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").withColumn("n", F.col("often")), "tokens")
    shared = spread_join(tokens, common, ["token"], "n").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("posts"))
    prefix = F.slice("posts", 1, F.size("posts") - (agree - 1))
    likely = written(shared.filter(F.size("posts") >= agree).select("rep", prefix["token"].alias("tokens")).join(reps, "rep"), "likely")
    posted = likely.select("rep", "sig", F.explode("tokens").alias("token"))
    alike = _alike(posted, Matcher("sig", agree))

    member = alike.unionByName(alike.select(F.col("component").alias("id"), "component").distinct())
    wanted = member.withColumnRenamed("component", "group").join(likely.select(F.col("rep").alias("id"), "key"), "id")
    texts = source.join(wanted.select("id", "group").distinct(), "id").select("id", "group", "text")
    sets = texts.mapInArrow(_full, "id long, group long, key binary, set binary")
    sets = written(sets.join(wanted.select("id", "key").distinct(), ["id", "key"], "left_semi").select(F.col("id").alias("rep"), "group", "set"), "full-sets")
    size = F.log(F.octet_length("set") / 8) / math.log(100 / percent)
    classes = F.array_distinct(F.array(*(F.floor(size + more + slack) for more in (0, 1) for slack in (-1e-9, 1e-9))))
    classed = sets.select("group", F.explode(classes).alias("class"), "rep", "set").select(F.xxhash64("group", "class").alias("token"), "rep", "set")
    links = _alike(classed, Matcher("set", percent))

    of_set = reps.select("key", "n", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").select("key", "n", F.coalesce("component", "rep").alias("component"), "copies")
    linked = spread_join(base.filter(own).select("id", "n", "key"), written(of_set, "components"), ["key", "n"], "copies").select("id", "n", "component")
    out = linked.unionByName(base.filter(~own).select("id", "n", F.col("id").alias("component")))
    kept = F.col("id").eqNullSafe(F.col("component"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
