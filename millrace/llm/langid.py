"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import slices, worker_cache

#: A run of letters and the like; whether it has a letter is settled once for each word.
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of the longest word that is scored without logarithms at each step, and the words that a Python worker remembers.
PLAIN, CACHED_WORDS = 38, 400_000
#: The probability of a character that no piece covers, in every language.
FLOOR = 1e-7


def load_pieces(path: str) -> list[str]:
    """The fixed vocabulary: all pieces of a public rank file that are lower-case letters, with or without the space
    that opens a word."""
    found = set()
    for line in Path(path).read_bytes().splitlines():
        try:
            piece = base64.b64decode(line.split()[0]).decode()
        except UnicodeDecodeError:
            continue
        if piece.removeprefix(" ").isalpha() and piece == piece.lower():
            found.add(piece)
    return sorted(found | {p[1:] for p in found if len(p) == 2 and p[0] == " "})


class Lattice:
    """Words as all their segmentations: for each place and length the row of the piece that stands there.

    Row 0 of the probability table is no piece (0), row 1 a character outside the vocabulary (FLOOR).
    """

    def __init__(self, pieces: list[str]):
        self.row = {p: i + 2 for i, p in enumerate(pieces)}
        self.lengths = sorted({len(p) for p in pieces} | {1})  # those of pieces; a character may also stand alone

    def rows(self, words: list[str]) -> np.ndarray:
        """For words of one length n (their opening space counted): n x lengths of pieces x len(words)."""
        get, n = self.row.get, len(words[0])
        longest = max(k for k in self.lengths if k <= n)
        out = np.zeros((n, longest, len(words)), np.int32)
        for i in range(n):
            for k in self.lengths:
                if k <= n - i:
                    out[i, k - 1] = [get(w[i : i + k], 0) for w in words]
            one = out[i, 0]
            one[one == 0] = 1
        return out

    @staticmethod
    def forward(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """alpha[i]: the summed probability of all segmentations of the first i characters; (n + 1) x words x languages."""
        n, longest, w = rows.shape
        alpha = np.zeros((n + 1, w, p.shape[1]))
        alpha[0] = 1
        for i in range(n):
            for k in range(min(longest, n - i)):
                if rows[i, k].any():
                    alpha[i + k + 1] += alpha[i] * p[rows[i, k]]
        return alpha

    def expected(self, rows: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in each language, over all segmentations (forward-backward)."""
        n = len(rows)
        alpha = self.forward(rows, p)
        beta = np.zeros_like(alpha)
        beta[n] = counts / alpha[n]
        used = np.zeros_like(p)
        for i in reversed(range(n)):
            for k in range(min(rows.shape[1], n - i)):
                if rows[i, k].any():
                    step = p[rows[i, k]] * beta[i + k + 1]
                    beta[i] += step
                    np.add.at(used, rows[i, k], alpha[i] * step)
        return used

    def log_score(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the summed probability for words of one length; words x languages."""
        rows = self.rows(words)
        if len(rows) <= PLAIN:
            return np.log(self.forward(rows, p)[-1])
        with np.errstate(divide="ignore"):
            logs = np.log(p)
        last = [np.zeros((len(words), p.shape[1]))]
        for j in range(1, len(rows) + 1):
            ways = [last[-k] + logs[rows[j - k, k - 1]] for k in range(1, min(rows.shape[1], j) + 1)]
            last = [*last[-(rows.shape[1] - 1) :], np.logaddexp.reduce(ways)] if rows.shape[1] > 1 else [np.logaddexp.reduce(ways)]
        return last[-1]


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        found.setdefault(len(w), []).append(i)
    return found


def fit(labelled: DataFrame, pieces: list[str], id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 1500, sample_words: int = 20_000, rounds: int = 4) -> dict:
    """Learn the pieces' probabilities in each language from labelled rows.

    The fit uses a bounded sample: about sample_docs documents of each language, chosen by a hash of their id, and the
    sample_words most frequent words of those, of fewer than PLAIN (38) characters; predictions score words of any length. Spark counts the words; expectation-maximisation over all segmentations
    of these words runs on the driver, in memory bounded by languages x sample_words. Rows without text or
    language are left out. Returns the model: languages, pieces, p (one row a piece, one column a language).
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = reduce(lambda c, x: c.when(F.col("lang") == x[0], F.lit(min(1.0, sample_docs / x[1]))), sizes.items(), F.when(F.lit(False), 1.0))
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    words = rows.filter(chance < share).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counted = words.filter(F.char_length("word") < PLAIN).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.row_number().over(top)).filter(F.col("at") <= sample_words)
    found = counted.select("lang", "word", "n").collect() if sizes else []

    languages = sorted(sizes)
    column = {x: i for i, x in enumerate(languages)}
    seen = sorted({r["word"] for r in found})
    place = {w: i for i, w in enumerate(seen)}
    counts = np.zeros((len(seen), len(languages)))
    for r in found:
        counts[place[r["word"]], column[r["lang"]]] = r["n"]
    lattice, groups = Lattice(pieces), []
    for at in _by_length([f" {w}" for w in seen]).values():
        groups.append((lattice.rows([f" {seen[i]}" for i in at]), counts[at]))
    p = np.full((len(pieces) + 2, len(languages)), 1 / (len(pieces) + 2))
    for _ in range(rounds):
        p[0], p[1] = 0, FLOOR
        used = sum((lattice.expected(r, p, c) for r, c in groups), np.zeros_like(p))
        used[:2] = 0
        p = (used + 0.01) / (used.sum(axis=0) + 0.01 * len(p))
    p = np.maximum(p, FLOOR)
    p[0], p[1] = 0, FLOOR
    return {"languages": languages, "pieces": pieces, "p": p}


class Scorer:
    """Scores texts with a model; remembers words."""

    def __init__(self, model: dict):
        self.p, self.lattice, self.n = model["p"], Lattice(model["pieces"]), len(model["languages"])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, self.n + 1))

    def learn(self, words: list[str]) -> None:
        """Score words not seen before. The table's last column says whether the word has a letter."""
        if len(self.place) + len(words) > CACHED_WORDS:
            self.clear()
        first = len(self.place)
        while first + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in _by_length(words).values():
            step = max(1, min(20_000, 5_000_000 // max(1, len(words[at[0]]) * min(len(words[at[0]]) + 1, self.lattice.lengths[-1]))))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                logs = self.lattice.log_score([f" {words[i]}" for i in some], self.p)
                self.table[[first + i for i in some], : self.n] = logs
        self.table[first : first + len(words), self.n] = [any(c.isalpha() for c in w) for w in words]
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def score(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the logarithm for each language, and the number of words with letters."""
        split = [_WORD.findall(t.lower()) for t in texts]
        need = set(chain.from_iterable(split))
        new = need - self.place.keys()
        if len(self.place) + len(new) > CACHED_WORDS:
            self.clear()
            new = need
        if new:
            self.learn(sorted(new))
        sizes = [len(s) for s in split]
        where = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        out, full = np.zeros((len(texts), self.n + 1)), [i for i, s in enumerate(sizes) if s]
        if full:
            starts = np.concatenate([[0], np.cumsum([sizes[i] for i in full])[:-1]])
            for c in range(self.n + 1):
                out[full, c] = np.add.reduceat(self.table[where, c], starts)
        return out


def _predicted(batches: Iterator[pa.RecordBatch], model: dict, place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with each row's language and score; the text is the column at place."""
    key = repr(model["languages"]).encode() + model["p"].tobytes()
    scorer, names = worker_cache(("scorer", key), lambda: Scorer(model)), np.array([*model["languages"], "und"], object)
    for batch in batches:
        texts = batch.column(place)
        for start, end in slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
            found = scorer.score([t or "" for t in texts.slice(start, end - start).to_pylist()])
            best, score = np.full(len(found), -1), np.zeros(len(found))
            if scorer.n:
                logs = found[:, :-1]
                share = np.exp(logs - logs.max(axis=1, keepdims=True))
                best = np.where(found[:, -1] > 0, logs.argmax(axis=1), -1)
                score = np.where(best >= 0, 1 / share.sum(axis=1), 0.0)
            yield batch.slice(start, end - start), names[best], score


def identify(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Predict the language of every whole text: id, lang_pred, score.

    score is the language's share of the summed probabilities, 0 to 1. A null or empty text, or one without a letter,
    gets "und" and 0; so does every text if the model has no language. Ties go to the first language by name. One pass
    without a shuffle; columns other than id and text are not read; equal rows give equal rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, scores in _predicted(batches, held.value, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id)


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is one of the model's with a score of at least `least`.

    Null and empty texts and texts without a letter are rejected, as are texts that no language explains better than
    the others together. One pass without a shuffle.
    """
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, scores in _predicted(batches, held.value, place):
            yield rows.filter(pa.array((names != "und") & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3. Null ids are none."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_unheld(docs: DataFrame, pieces: list[str], **how) -> dict:
    """fit on the rows of docs with an id that are not held out."""
    id = how.get("id", "doc_id")
    return fit(docs.filter(F.col(id).isNotNull() & ~held_out(F.col(id))), pieces, **how)
