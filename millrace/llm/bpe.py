"""Byte-pair encoding and decoding with a deterministic tokenization automaton.

The automaton's arcs bear tokens; the state that an arc leads to is named after the arc's last token. It starts with one
state for all bytes, with every arc. Each merge u, v -> w then adds a gadget: the state of u loses its arc v; every state
with the arc u gets an arc w, in the place and manner of u's; and w's state begins as a copy of v's row as it was. A path of
arcs that spells a word is the word's encoding, and there is exactly one.

The driver compiles all merges into tables, once. Tokens are numbered so that those whose arcs were copied from y's, the
youngest first, follow y: what one cut takes away, with all later copies, is then one interval of numbers. A row is the
intervals that are cut; it begins as the prefix of another row (up to the copy's moment), so rows share all older cuts. Words are
walked byte by byte through a goto table over the arcs' labels, many words in step; at each byte the longest token that ends
there and whose arc is there is the last token of the prefix, and the tokens read backwards are the path.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import slices, worker_cache

#: The pre-split of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts below U+0100, with the classes written out: the standard module needs a third of the time.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_NARROW = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = regex.compile(SPLIT)
_BEYOND = re.compile("[^\x00-\xff]")
#: What became a letter or a number after the Unicode version (16) that byte-level vocabularies are split by.
_LATE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)) + "]")

#: Words whose encoding a Python worker remembers, and characters of a word that is walked by itself and not remembered.
CACHED_WORDS, LONG = 400_000, 64


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """Read a byte-level BPE vocabulary in the tokenizers library's JSON and compile it. Its size bounds all that is broadcast."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    byte_of, ids = _byte_of(), model["vocab"]
    pieces = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
    merges = []
    for m in model["merges"]:
        u, v = m if isinstance(m, list) else m.split(" ")
        merges.append((ids[u], ids[v], ids[u + v]))
    if len({w for _, _, w in merges}) < len(merges):
        raise ValueError("two merges make the same token")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that take white space are not supported")
    pieces |= {i: s.encode() for s, i in special.items()}
    flat = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    if len({p for p in flat if len(p) == 1}) < 256:
        raise ValueError("some bytes have no token")
    digest = hashlib.sha256(repr((merges, flat, special)).encode()).hexdigest()
    return {"pieces": flat, "special": special, "automaton": Automaton(flat, merges, special), "digest": digest}


def _followers(left: dict[int, int], born: dict[int, int], size: int) -> tuple[np.ndarray, dict[int, tuple[list[int], list[int]]], np.ndarray]:
    """Numbers of tokens in which a token is followed by those whose columns were copied from its own, the youngest first;
    for each token these copies (moments descending, numbers), and the end of its range."""
    children: dict[int, list[int]] = {}
    for w in sorted(left, key=born.__getitem__, reverse=True):
        children.setdefault(left[w], []).append(w)
    number, ends, at = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
    copies: dict[int, tuple[list[int], list[int]]] = {}
    for root in (i for i in range(size) if i not in left):
        stack = [(root, False)]
        while stack:
            token, done = stack.pop()
            if done:
                ends[token] = at
                copies[token] = ([-born[c] for c in children.get(token, ())], [int(number[c]) for c in children.get(token, ())])
                continue
            number[token], at = at, at + 1
            stack.append((token, True))
            stack += [(c, False) for c in reversed(children.get(token, ()))]
    return number, copies, ends


def compile_rows(merges: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
    """The gadgets, one after the other: numbers of the tokens; the cut intervals of all rows as keys state * size + number
    (starts and ends, sorted and apart, with a sentinel first); and tokens of merges whose arc an earlier merge had cut:
    no path bears those."""
    left, right, born = {}, {}, {}
    own: dict[int, list[tuple[int, int]]] = {}
    for moment, (u, v, w) in enumerate(merges):
        left[w], right[w], born[w] = u, v, moment
        own.setdefault(u, []).append((v, moment))
    number, copies, ends = _followers(left, born, size)
    none = np.zeros((0, 3), np.int64)
    rows: list[np.ndarray] = [none] * size

    def cuts(token: int) -> np.ndarray:
        """Moment, first and end of what the token's own merges took from its row: the arc, and all copies of it since."""
        found = []
        for v, moment in own.get(token, ()):
            ages, at = copies[v]
            older = bisect_right(ages, -moment)
            found.append((moment, int(number[v]), at[older] if older < len(at) else int(ends[v])))
        return np.array(found, np.int64) if found else none

    for token in range(size):
        if token not in left:
            rows[token] = cuts(token)
    dead: set[int] = set()
    for u, v, w in merges:
        there = rows[u][: np.searchsorted(rows[u][:, 0], born[w])]
        if u in dead or v in dead or ((there[:, 1] <= number[v]) & (number[v] < there[:, 2])).any():
            dead.add(w)
        before = rows[v][: np.searchsorted(rows[v][:, 0], born[w])]
        mine = cuts(w)
        rows[w] = np.concatenate([before, mine]) if len(mine) else before
    flat = np.concatenate(rows) if rows else none
    state = np.repeat(np.arange(size), [len(r) for r in rows]) * size
    starts, stops = state + flat[:, 1], state + flat[:, 2]
    order = np.lexsort((-stops, starts))
    starts, stops = starts[order], stops[order]
    outer = np.ones(len(starts), bool)
    outer[1:] = stops[1:] > np.maximum.accumulate(stops)[:-1]
    return number, np.concatenate([[-1], starts[outer]]), np.concatenate([[-1], stops[outer]]), dead


def compile_goto(pieces: list[bytes], spelt: list[int]) -> dict[str, np.ndarray]:
    """The goto table over the labels of the tokens spelt: which node follows a node at a byte, the longest token that ends at
    a node, and for each token the next shorter one that ends with it. A node's row starts as the row of the node it
    falls back to; rows are 16 pieces of 16 bytes each, and only the pieces that its own labels change are copied."""
    next_node: list[dict[int, int]] = [{}]
    label = [-1]
    for i in spelt:
        node = 0
        for b in pieces[i]:
            step = next_node[node].get(b)
            if step is None:
                step = next_node[node][b] = len(label)
                next_node.append({})
                label.append(-1)
            node = step
        label[node] = i
    fail, rows, table = [0] * len(label), np.zeros((len(label), 16), np.int32), [np.zeros(16, np.int32)]
    longest, shorter = [-1] * len(label), np.full(len(pieces), -1, np.int32)
    queue = deque([0])
    while queue:
        node = queue.popleft()
        back = fail[node]
        rows[node] = row = rows[back]
        own: set[int] = set()
        for b, step in next_node[node].items():
            if b >> 4 not in own:
                own.add(b >> 4)
                table.append(table[row[b >> 4]].copy())
                rows[node, b >> 4] = len(table) - 1
            part = table[rows[node, b >> 4]]
            fail[step] = int(part[b & 15])
            part[b & 15] = step
            queue.append(step)
        longest[node] = label[node] if label[node] >= 0 else longest[back]
        if label[node] >= 0:
            shorter[label[node]] = longest[back] if node else -1
    return {"goto": np.concatenate(table), "row": rows.reshape(-1) * 16, "longest": np.array(longest, np.int32), "shorter": shorter}


class Automaton:
    """The compiled merges: tables that don't change, broadcast as they are."""

    def __init__(self, pieces: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.size = len(pieces)
        self.lengths = np.array([len(p) for p in pieces], np.int32)
        self.number, self.starts, self.stops, dead = compile_rows(merges, self.size)
        borne, apart = {w for _, _, w in merges} - dead, set(special.values())
        tables = compile_goto(pieces, [i for i, p in enumerate(pieces) if i not in apart and p and (len(p) == 1 or i in borne)])
        self.goto, self.row, self.longest, self.shorter = (tables[k] for k in ("goto", "row", "longest", "shorter"))

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word, 32-bit integers in bytes: all words go a byte on in each step."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        data = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        last, node = np.empty(len(data), np.int32), np.zeros(len(words), np.int32)
        longer = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        for i, m in enumerate(longer.tolist()):
            at = begin[:m] + i
            byte = data[at]
            node[:m] = now = self.goto[self.row[node[:m] * 16 + (byte >> 4)] + (byte & 15)]
            token = self.longest[now]
            doubt = np.flatnonzero(self.lengths[token] <= i)  # the arc of a first token is always there
            while len(doubt):
                some = token[doubt]
                key = last[at[doubt] - self.lengths[some]].astype(np.int64) * self.size + self.number[some]
                doubt = doubt[key < self.stops[np.searchsorted(self.starts, key, "right") - 1]]
                token[doubt] = self.shorter[token[doubt]]
                doubt = doubt[self.lengths[token[doubt]] <= i]
            last[at] = token
        ends, left, live = np.zeros(len(data), bool), sizes.copy(), np.flatnonzero(sizes)
        while len(live):
            at = begin[live] + left[live] - 1
            ends[at] = True
            left[live] -= self.lengths[last[at]]
            live = live[left[live] > 0]
        ids = last[ends].tobytes()
        stop = np.concatenate([[0], np.cumsum(ends)])[begin + sizes] * 4
        out: list[bytes] = [b""] * len(words)
        for place, a, b in zip(order.tolist(), [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            out[place] = ids[a:b]
        return out

    def encode_long(self, word: bytes) -> bytes:
        """The same for one long word, a byte at a time."""
        goto, row, longest, shorter, number, length, starts, stops = map(memoryview, (self.goto, self.row, self.longest, self.shorter, self.number, self.lengths, self.starts, self.stops))
        last, node = np.empty(len(word), np.int32), 0
        seen = memoryview(last)
        for i, b in enumerate(word):
            node = goto[row[node * 16 + (b >> 4)] + (b & 15)]
            token = longest[node]
            while length[token] <= i:
                key = seen[i - length[token]] * self.size + number[token]
                if key >= stops[bisect_right(starts, key) - 1]:
                    break
                token = shorter[token]
            seen[i] = token
        path, end = [], len(word)
        while end:
            path.append(seen[end - 1])
            end -= length[path[-1]]
        return np.array(path[::-1], np.int32).tobytes()


class Encoder(dict):
    """Encodes texts; itself the cache from pre-split words to their ids as 32-bit integers in bytes."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.automaton: Automaton = vocabulary["automaton"]
        self.lengths = self.automaton.lengths.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(vocabulary["pieces"]), np.uint8)
        self.special = {s: np.int32(i).tobytes() for s, i in vocabulary["special"].items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes:
        """A word over LONG, which is not remembered."""
        return self.automaton.encode_long(word.encode())

    def learn(self, words: set[str]) -> None:
        new = [w for w in words - self.keys() if len(w) <= LONG]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = [w for w in words if len(w) <= LONG]
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            self.update(zip(part, self.automaton.encode_many([w.encode() for w in part]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: pre-split all, walk the words that are new, look all up."""
        parts = [self._parts(t) for t in texts]
        split = [[p if i % 2 else _words(p) for i, p in enumerate(x)] for x in parts]
        self.learn(set().union(*(w for x in split for w in x[::2])))
        get = self.__getitem__
        return [b"".join(b"".join(map(get, w)) if not i % 2 else self.special[w] for i, w in enumerate(x)) for x in split]

    def _parts(self, text: str) -> list[str]:
        """Plain text and added tokens in turn."""
        return self.at_special.split(text) if self.at_special is not None and self.at_special.search(text) else [text]

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs in turn. Ids outside the vocabulary have none."""
        out = []
        for k in range(0, len(ids), 500_000):
            part = ids[k : k + 500_000]
            part = part[(part >= 0) & (part < len(self.lengths))]
            size = self.lengths[part]
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.starts[part] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return b"".join(out)


def _words(text: str) -> list[str]:
    """The pre-split. Characters that became letters or numbers later count as neither."""
    if not _BEYOND.search(text):
        return _NARROW.findall(text)
    if _LATE.search(text):
        return [text[m.start() : m.end()] for m in _WIDE.finditer(_LATE.sub("\u2603", text))]
    return _WIDE.findall(text)


def _encoder(vocabulary: dict) -> Encoder:
    """One for each Python worker and vocabulary, kept between tasks."""
    return worker_cache(("encoder", vocabulary["digest"]), lambda: Encoder(vocabulary))


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def bpe_encode(docs: DataFrame, vocabulary: dict, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Encode every whole text: id, ids (array<int>), and with decoded=True the text that the ids decode to.

    Splits texts as byte-level vocabularies do, added tokens first. Null counts as empty; an empty text has no ids; an
    empty table gives an empty result. One pass without a shuffle; other columns are not read. Equal rows give
    equal rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [T.StructField("id", docs.schema[id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            texts = batch.column(1)
            for start, end in slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
                parts = encoder.ids([t or "" for t in texts.slice(start, end - start).to_pylist()])
                columns = [batch.column(0).slice(start, end - start), _lists(parts)]
                if decoded:
                    columns.append(pa.array([encoder.decode(np.frombuffer(p, np.int32)).decode("utf-8", "replace") for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    out = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))
    return out.withColumnRenamed("id", id)


def bpe_decode(encoded: DataFrame, vocabulary: dict, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Decode arrays of ids: id, decoded. Null, and null elements, decode to nothing; broken UTF-8 is replaced. Equal rows
    give equal rows; an empty table gives an empty result; other columns are not read."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("id", encoded.schema[id].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            texts = [encoder.decode(np.array([x for x in row or () if x is not None], np.int64)).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    out = encoded.select(F.col(id).alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id)
