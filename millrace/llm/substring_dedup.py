"""Repeated passages: documents are factored against an index of all documents' passages, relative Lempel-Ziv in blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, slices, spread_join, written

#: Words of an anchor; bytes of a text that are cut into words, and windows whose anchors are found, at a time.
ANCHOR, CHUNK = 8, 4_000_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_PICK = np.random.Generator(np.random.PCG64(20240311))
_LEFT, _RIGHT = (int(x) | 1 for x in _PICK.integers(1, 1 << 63, 2, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _mixed(x * np.uint64(_LEFT) + y * np.uint64(_RIGHT))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size words, from those of its halves."""
    out, n = words, 1
    while n < size and len(out):
        step = min(n, size - n)  # the second half may overlap the first
        out = _both(out[:-step], out[step:])
        n += step
    return out if n == size else words[:0]


def _word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + CHUNK)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def _words(text: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in _word_chunks(text))])


def blocks(words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """A text's windows cut into blocks, where the text itself says: a window belongs to its anchor, the run of ANCHOR words in it with
    the smallest hash (the first of equals), and the windows of one anchor are a block. So the same passage is cut alike in all texts.

    Returns anchor, key, start and count of windows for each block, and all windows' hashes. A block's key stands for its words:
    its first and last window overlap."""
    whole = run_hashes(words, window)
    if not len(whole):
        return whole, whole, np.zeros(0, np.int64), np.zeros(0, np.int64), whole
    anchors = run_hashes(words, ANCHOR)
    at = np.empty(len(whole), np.int64)
    for k in range(0, len(whole), CHUNK):
        part = anchors[k : k + CHUNK + window - ANCHOR]
        at[k : k + CHUNK] = k + np.arange(min(CHUNK, len(whole) - k)) + sliding_window_view(part, window - ANCHOR + 1).argmin(axis=1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(start, len(whole)))
    key = _both(_both(whole[start], whole[start + count - 1]), count.astype(np.uint64))
    return anchors[at[start]], key, start, count, whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts, the last column, by slices of bounded size."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for start, end in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            rows = batch.slice(start, end - start)
            yield rows, [t or b"" for t in rows.column(rows.num_columns - 1).cast(pa.binary()).to_pylist()]


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in _each_text(batches):
        found = [blocks(_words(t), window)[:4] for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        anchor, key, start, count = (np.concatenate(c) for c in zip(*found, strict=True))
        of = pa.array(of)
        yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), _signed(anchor), _signed(key), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["id", "h", "anchor", "key", "at", "n"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each window of the blocks that are asked for (column 2: their starts), with its anchor and hash."""
    for rows, texts in _each_text(batches):
        of, anchors, hashes, places = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (text, asked) in enumerate(zip(texts, rows.column(2).to_pylist(), strict=True)):
            anchor, _, start, count, whole = blocks(_words(text), window)
            wanted = np.isin(start, np.array(asked, np.int64))
            n = count[wanted]
            place = np.arange(n.sum()) + np.repeat(start[wanted] - np.cumsum(n) + n, n)
            of.append(len(place))
            anchors.append(np.repeat(anchor[wanted], n))
            hashes.append(whole[place])
            places.append(place)
        of = pa.array(np.repeat(np.arange(len(texts)), of))
        yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), _signed(np.concatenate(anchors)), _signed(np.concatenate(hashes)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.ones(len(of), np.int32))], ["id", "h", "anchor", "key", "at", "n"])


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """h tells texts of rows that repeat an id apart."""
    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("text"))


_PLACES = "id long, h long, anchor long, key long, at int, n int"


def factors(docs: DataFrame, window: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What of each document stands in a document with a smaller id: id, h (hash of the row's text), and factors, an array of (start, words, source,
    source_start) in order. Every factor has window words at least; factors may overlap; together they hold exactly the words of all windows
    that start in a document with a smaller id.

    The reference is all documents. It is cut into blocks by its content (see blocks), and its index holds each different block once, with the first
    document that has it: (anchor, key) -> (id, place), an aggregation in which tasks merge copies first. 1. A document is factored
    by looking up its blocks, from left to right: neighbouring blocks with the same source on the same diagonal are one factor,
    as long as it gets. 2. At factors' ends a window can be old though its block is new. Such a window's anchor has several blocks in the
    index; so the windows of these blocks, each different block once, are listed and looked up one by one in the same way. What
    has no anchor in common with an earlier document is not listed, nor is what lies inside a factor.

    Anchors, keys and windows with very many rows are broadcast where they are looked up (spread_join), so a passage that a third of all documents hold
    is no task of its own. Passages are compared by 64 bits of their words' hashes beside the 64 bits of an equal anchor.
    """
    source = _keyed(docs, id, text).filter(F.col("id").isNotNull())
    cut = written(source.mapInArrow(partial(_cut, window=window), _PLACES), "blocks")
    best, n = F.min(F.struct("id", "at", "h")).alias("first"), F.count(F.lit(1)).alias("rows")
    index = written(cut.groupBy("anchor", "key").agg(best, n, F.max("id").alias("last")), "block-index")
    again = spread_join(cut, index.filter(F.col("first.id") < F.col("last")).select("anchor", "key", "first", "rows"), ["anchor", "key"], "rows").filter(F.col("first.id") < F.col("id"))

    several = index.groupBy("anchor").agg(n, F.min("first.id").alias("low"), F.max("first.id").alias("high")).filter("low < high").select("anchor", "rows")
    several = written(several, "anchors")
    open_ = spread_join(index.select("anchor", "first"), several, ["anchor"], "rows").select("first.*")
    asked = open_.groupBy("id", "h").agg(F.collect_list("at").alias("starts"))
    listed = source.join(asked, ["id", "h"]).select("id", "h", "starts", "text").mapInArrow(partial(_windows, window=window), _PLACES)
    listed = written(listed, "windows")
    old = listed.groupBy("anchor", "key").agg(best, n, F.max("id").alias("last")).filter(F.col("first.id") < F.col("last")).drop("last")
    old = written(old, "old-windows")
    found = spread_join(listed, old, ["anchor", "key"], "rows").filter(F.col("first.id") < F.col("id"))

    place = F.struct("at", (F.col("n") + (window - 1)).alias("words"), F.col("first.id").alias("source"), F.col("first.at").alias("source_at"))
    places = again.unionByName(found).groupBy("id", "h").agg(F.collect_set(place).alias("places"))
    kind = "id long, h long, factors array<struct<start:int,words:int,source:long,source_start:int>>"
    out = written(places.mapInArrow(_joined, kind), "factors")
    discard(cut, index, several, listed, old)
    return out.withColumnRenamed("id", id)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedily, from left to right: places on one diagonal that meet are one factor."""
    for batch in batches:
        out = []
        for places in batch.column(2):
            at, words, source, source_at = (f.to_numpy().astype(np.int64) for f in places.values.flatten())
            order = np.lexsort((at, at - source_at, source))
            at, words, source, source_at = at[order], words[order], source[order], source_at[order]
            end = at + words
            new = np.ones(len(at), bool)
            new[1:] = (source[1:] != source[:-1]) | (at[1:] - source_at[1:] != at[:-1] - source_at[:-1]) | (at[1:] > end[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            spans = sorted(zip(at[first].tolist(), (end[last] - at[first]).tolist(), source[first].tolist(), source_at[first].tolist(), strict=True))
            out.append([dict(zip(("start", "words", "source", "source_start"), s, strict=True)) for s in spans])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["id", "h", "factors"])


def _united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as the fewest that lie apart, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _each_text(batches):
        all_, gone, kept = [], [], []
        for text, spans in zip(texts, rows.column(1).to_pylist(), strict=True):
            ends = _united((s["start"], s["start"] + s["words"]) for s in spans or [])
            n, stay, parts, at = 0, 0, [], 0
            for words in _word_chunks(text):
                gone_here = np.zeros(len(words) + 1, np.int64)
                while at < len(ends) and ends[at][0] < n + len(words):
                    gone_here[max(0, ends[at][0] - n)] += 1
                    gone_here[min(len(words), ends[at][1] - n)] -= 1
                    if ends[at][1] > n + len(words):  # goes on in the next chunk
                        ends[at] = (n + len(words), ends[at][1])
                        break
                    at += 1
                left = np.flatnonzero(np.cumsum(gone_here[:-1]) == 0).tolist()
                n, stay = n + len(words), stay + len(left)
                if left:
                    parts.append(b" ".join(words if len(left) == len(words) else [words[i] for i in left]))
            all_.append(n)
            gone.append(n - stay)
            kept.append(b" ".join(parts))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(all_, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's text without the words that factors cover: id, n_words, n_removed, kept_text (the kept words, one space between).

    Words are runs without ASCII white space, compared as they are; null has none. All windows are judged on the input. A window that
    repeats only inside its document, or in documents with larger ids, stays. Rows that repeat an id are one document in that none of them removes
    from another; each keeps its own text. A row with a null id removes nothing and keeps everything. A text of fewer words than
    a window keeps everything. An empty table gives an empty result; other columns are not read. Ids are long.
    """
    found = factors(docs, window, id, text).withColumnRenamed(id, "id")
    rows = _keyed(docs, id, text).join(found, ["id", "h"], "left").select("id", "factors", "text")
    return rows.mapInArrow(_strip, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id)


def digest(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
