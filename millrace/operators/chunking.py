"""Chunks of documents by a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import SENTENCE_END, content_hash, count_tokens, words

#: Blocks that stand alone.
ATOMIC = ("table", "code", "image_description")
_SENTENCES = re.compile(SENTENCE_END)
Block = tuple[str, str, str]  # content, type, locator


def _count(text: str) -> int:
    return len(text.split())


def _cut(text: str, n: int) -> list[str]:
    tokens = text.split()
    return [" ".join(tokens[i : i + n]) for i in range(0, len(tokens), n)]


class _Packer:
    """Gathers pieces while they fit and hands out what it has when the next one does not."""

    def __init__(self, limit: int, joint: str, gap: int, counter: Callable[[str], int]):
        self.limit, self.joint, self.gap, self.counter = limit, joint, gap, counter
        self.pieces: list[str] = []
        self.locator, self.tokens = "", 0

    def flush(self) -> Iterator[tuple[str, str]]:
        if self.pieces:
            yield self.joint.join(self.pieces), self.locator
        self.pieces, self.tokens = [], 0

    def add(self, piece: str, locator: str) -> Iterator[tuple[str, str]]:
        if self.pieces and self.tokens + self.gap + self.counter(piece) > self.limit:
            yield from self.flush()
        if not self.pieces:
            self.locator = locator
        self.pieces.append(piece)
        self.tokens = self.counter(self.joint.join(self.pieces))


def pack_blocks(blocks: list[Block], limit: int, counter: Callable[[str], int] = _count, cut: Callable[[str, int], list[str]] = _cut) -> list[tuple[str, str]]:
    """Chunks (content, locator of their first block) of one document, before overlap.

    Runs of other blocks than ATOMIC are a segment; whole segments are packed while they fit. A segment over the limit is not
    packed: its blocks that fit become chunks each, the others are cut into sentences that are packed, and a sentence
    over the limit is cut by tokens.
    """
    segments: list[list[Block]] = []
    for block in blocks:
        alone = block[1] in ATOMIC
        if alone or not segments or segments[-1][-1][1] in ATOMIC:
            segments.append([block])
        else:
            segments[-1].append(block)
    out: list[tuple[str, str]] = []
    packer = _Packer(limit, "\n\n", counter("\n\n"), counter)
    for segment in segments:
        text = "\n\n".join(b[0] for b in segment)
        if counter(text) <= limit:
            out += packer.add(text, segment[0][2])
            continue
        out += packer.flush()
        for content, _, locator in segment:
            if counter(content) <= limit:
                out.append((content, locator))
                continue
            inner = _Packer(limit, " ", 1, counter)
            for sentence in (s.strip() for s in _SENTENCES.split(content)):
                if not sentence:
                    continue
                if counter(sentence) > limit:
                    out += inner.flush()
                    out += [(piece, locator) for piece in cut(sentence, limit)]
                else:
                    out += inner.add(sentence, locator)
            out += inner.flush()
    out += packer.flush()
    return out


def chunk_blocks(documents: DataFrame, max_tokens: int = 1024, overlap: int = 64, id: str = "doc_id", blocks: str = "blocks", counter: Callable[[str], int] = _count, cut: Callable[[str, int], list[str]] = _cut) -> DataFrame:
    """Chunks of documents whose blocks are an array of structs (content, block_type, source_locator, ...).

    Documents are independent, so packing runs where they lie, without a shuffle; overlap, hash and counts are columns.
    counter and cut default to whitespace tokens. Returns id, chunk_index, content, source_locator, token_count, content_hash.
    """
    kind = documents.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, found in zip(batch.id, batch.blocks, strict=True):
                if found is not None:
                    packed = pack_blocks([(b["content"], b["block_type"], b["source_locator"]) for b in found], max_tokens, counter, cut)
                    rows += [(key, i, content, at, packed[i - 1][0] if i else None) for i, (content, at) in enumerate(packed)]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "content", "source_locator", "previous"])

    raw = documents.select(F.col(id).alias("id"), F.col(blocks).alias("blocks")).mapInPandas(run, f"id {kind}, chunk_index int, content string, source_locator string, previous string")
    content = _overlapped(F.col("content"), F.col("previous"), overlap)
    return raw.select(F.col("id").alias(id), "chunk_index", content.alias("content"), "source_locator", count_tokens(content).alias("token_count"), content_hash(content).alias("content_hash"))


def _overlapped(content, previous, n: int):
    tail = words(previous)
    if n <= 0:
        return content
    return F.when(F.size(tail) > n, F.concat(F.array_join(F.slice(tail, -n, n), " "), F.lit("\n\n"), content)).otherwise(content)


def apply_overlap(chunks: DataFrame, n: int, id: str = "doc_id") -> DataFrame:
    """Chunks that begin with the last n tokens of the raw chunk before them, where that has more than n; the hash is taken after."""
    before = F.lag("content").over(Window.partitionBy(id).orderBy("chunk_index"))
    rows = chunks.withColumn("_before", before).withColumn("content", _overlapped(F.col("content"), F.col("_before"), n)).drop("_before")
    return rows.withColumn("token_count", count_tokens(F.col("content"))).withColumn("content_hash", content_hash(F.col("content")))


def chunk_stats(chunks: DataFrame, id: str = "doc_id") -> DataFrame:
    return chunks.groupBy(id).agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("total_tokens"), F.max("token_count").alias("max_tokens"))
