"""Ranked lexical search, reversed: the items are indexed, and every document streams through their index once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, slices, written

#: What a block of items may hold, as all tasks get its index: bytes of text, and items.
ITEM_BYTES, ITEMS = 4_000_000, 4_000
#: Bytes of a text that are cut into words at a time; sums that a task holds at a time.
CHUNK, SUMS = 4_000_000, 4_000_000
#: Folds the heaps of tasks together in two steps, so that an item's last one takes at most so many.
FOLDS = 64

#: Bytes of UTF-8: letters and digits of ASCII, and all bytes beyond ASCII, are parts of terms; A-Z are lowered.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time; no term is cut."""
    plain, at = text.translate(_PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch], shared: Any) -> Iterator[pa.RecordBatch]:
    """Of each document its number of terms, and the places and counts of those that items have."""
    places = shared.value
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for start, end in slices(sizes):
            rows = batch.slice(start, end - start)
            ns, terms, tfs = [], [], []
            for text in rows.column(1).cast(pa.binary()).to_pylist():
                n, found = 0, Counter()
                for words in term_chunks(text or b""):
                    n += len(words)
                    found.update(filter(places.__contains__, words))
                ns.append(n)
                terms.append([places[w] for w in found])
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ns, pa.int64()), pa.array(terms, schema.field("terms").type), pa.array(tfs, schema.field("tfs").type)], schema=schema)


class Heaps:
    """The k best documents of each item so far, as columns: by score, then by id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64))  # item, score, no id, id

    def push(self, item: np.ndarray, score: np.ndarray, none: np.ndarray, id: np.ndarray) -> None:
        """Rows under an item's floor, its k-th score, are not to be pushed."""
        item, score, none, id = (np.concatenate(c) for c in zip(self.rows, (item, score, none, id), strict=True))
        order = np.lexsort((id, none, -score, item))
        item, score, none, id = item[order], score[order], none[order], id[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        full = rank == self.k - 1
        self.floor[item[full]] = score[full]
        self.rows = tuple(c[rank < self.k] for c in (item, score, none, id))


def _rank(batches: Iterator[pa.RecordBatch], shared: Any, k: int, documents: int, length: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's documents for each item."""
    item_ids, weight, starts, items, times = shared.value
    heaps = Heaps(len(item_ids), k)
    step = max(1, SUMS // max(1, len(item_ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            n = rows.column(1).to_numpy()
            lists = rows.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy(), rows.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            m = 75 + (25 * n * documents) // max(1, length)
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            sums = np.zeros(len(sizes) * len(item_ids), np.int64)
            posts = starts[term + 1] - starts[term]
            ends, a = np.cumsum(posts), 0
            while a < len(posts):  # a part of the terms at a time
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - posts[a] + SUMS, "right")))
                count = posts[a:b]
                place = np.arange(count.sum()) + np.repeat(starts[term[a:b]] - np.cumsum(count) + count, count)
                np.add.at(sums, np.repeat(doc[a:b], count) * len(item_ids) + items[place], np.repeat(gain[a:b], count) * times[place])
                a = b
            d, i = np.nonzero(sums.reshape(-1, len(item_ids)) >= heaps.floor)
            ids = rows.column(0)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            heaps.push(i, sums[d * len(item_ids) + i], none[d], pc.fill_null(ids, 0).to_numpy()[d])
    item, score, none, id = heaps.rows
    if len(item):
        yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(item)), pa.array(id, pa.int64(), mask=none), pa.array(score)], ["item_id", "doc_id", "score"])


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items (item_id, text) with the number of their block; how many blocks."""
    size = F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")
    total = items.agg(*size).first()
    blocks = max(1, -(-(total["bytes"] or 0) // ITEM_BYTES), -(-total["n"] // ITEMS))
    while blocks > 1:  # doubled until none is over twice its size, but for single items
        placed = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        if placed.groupBy("block").agg(*size).filter(f"n > 1 AND (bytes > {2 * ITEM_BYTES} OR n > {2 * ITEMS})").isEmpty():
            return placed, blocks
        blocks *= 2
    return items.withColumn("block", F.lit(0)), 1


def _postings(rows: list) -> tuple[dict[bytes, int], tuple]:
    """The inverted index of a block of items: places of terms; for each term the items and how often each holds it."""
    places: dict[bytes, int] = {}
    posts: list[tuple[int, int, int]] = []
    for i, row in enumerate(rows):
        terms = Counter(w for words in term_chunks((row["text"] or "").encode()) for w in words)
        posts += [(places.setdefault(w, len(places)), i, n) for w, n in terms.items()]
    term, item, times = (np.array(c, np.int64) for c in zip(*sorted(posts), strict=True)) if posts else (np.zeros(0, np.int64),) * 3
    return places, (np.searchsorted(term, np.arange(len(places) + 1)), item, times)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of all for each item: item id, rank, doc_id, score.

    The inverted index is over the items' terms, the small side; its size has a bound, since items come in blocks (ITEM_BYTES,
    ITEMS) of which each is sent to all tasks in turn. 1. Documents stream through the block's vocabulary: each leaves a short row, its number of
    terms and the counts of those that items have; these rows are written. 2. From them come the number of documents, their terms and each
    term's documents, over all documents. 3. The short rows stream through the index: a document's terms add to the sums of the items that
    hold them, and what reaches an item's k-th score so far goes into its heap. A task ends with k rows an item at most; the heaps of
    tasks are merged in two steps. No text is shuffled, and no task holds more than its own heaps.

    Terms: runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased; null has none. Score: the sum, over the item's
    terms with repeats, of weight * tf saturated by the document's length, in 64-bit integers. Only scores above 0 count; equal
    ones go by ascending id, null ids last. Rows of docs that repeat an id are documents of their own. Rows of items that
    repeat an id are one item with all their different texts. Without documents or items the result is empty; an item without terms, or
    null, has no rows. Other columns are not read. Ids of documents are long.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    asked = asked.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text"))
    placed, blocks = _blocks(asked)
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    kind = dict(asked.dtypes)["item_id"]
    schema = f"item_id {kind}, doc_id long, score long"
    out = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    for block in range(blocks):
        rows = sorted(placed.filter(F.col("block") == block).select("item_id", "text").collect(), key=lambda r: (r["item_id"] is not None, r["item_id"]))
        places, index = _postings(rows)
        if not places:
            continue
        vocabulary = spark.sparkContext.broadcast(places)
        counted = written(texts.mapInArrow(partial(_count, shared=vocabulary), "id long, n long, terms array<int>, tfs array<long>"), "term-counts")
        vocabulary.destroy()
        documents, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = np.zeros(len(places), np.int64)
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            held[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
        item_ids = pa.array([r["item_id"] for r in rows], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind))
        shared = spark.sparkContext.broadcast((item_ids, weight, *index))
        found = counted.mapInArrow(partial(_rank, shared=shared, k=k, documents=documents, length=length), schema)
        found = _best(found.withColumn("fold", F.pmod(F.spark_partition_id(), F.lit(FOLDS))), k, "item_id", "fold")
        out = out.unionByName(written(_best(found, k, "item_id").drop("fold"), "ranked"))
        shared.destroy()
        discard(counted)
    return out.select(F.col("item_id").alias(item_id), "rank", "doc_id", "score")


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.drop("rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
