"""Personal data: overlapping candidate spans, boosted trees on format and context, calibrated thresholds."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import joined_spans, kind_count, slices

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits where it can't begin at the run's start: the look-behind spares the tries.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
#: Generators of further spans, wide on purpose. Written-out addresses; addresses with masked dots; addresses of version 6;
#: numbers in other groups than the base patterns take; numbers in phone groups without a plus, or dialled with 00.
_AT = re.compile(r"(?:[\[({]|\x20)at(?:[\])}]|\x20)", re.I)
_SPELLED = re.compile(r"\x20?(?:[\[({]at[\])}]|at)\x20?(?P<host>[A-Za-z0-9-]++(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+)", re.I)
_DOT = re.compile(r"\x20?[\[({]dot[\])}]\x20?|\x20dot\x20", re.I)
_MASKED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?P<dot>\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20|\x20\.\x20)[0-9]{1,3}(?P=dot)[0-9]{1,3}(?P=dot)[0-9]{1,3}(?![0-9])")
_SIX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){2,}+(?![0-9A-Za-z])")
_FOURS = re.compile(r"(?<![0-9])[0-9]{4}(?P<gap>[._/]|\x20{2}|\x20-\x20)[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?![0-9])")
_GROUPS = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIALLED = re.compile(r"(?<![0-9+])00\x20?(?=[1-9])[0-9]++(?:[\x20()./-]{1,2}[0-9]++)++")
#: Words near a span that speak for a kind (in the kinds' order), and against all.
_NEAR = [re.compile(p, re.I) for p in (r"mail|contact|write|reach", r"\bip\b|host|server|addr|ping|login", r"card|visa|credit|payment|debit|paid", r"phone|\btel|call|mobile|fax|dial|ring", r"version|order|invoice|isbn|serial|issue|page|chapter|build|\bno\b")]


class Span(NamedTuple):
    """A candidate: its place, what it stands for in plain form, and whether a base pattern took it."""

    start: int
    kind: int
    end: int
    base: bool
    value: str


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, value: str) -> bool:
    """Whether a plain form passes its kind's own test."""
    if kind == EMAIL:
        return value.count("@") == 1 and _DOMAIN.fullmatch(value, value.index("@") + 1) is not None and value[0] != "@"
    if kind == IP and ":" in value:
        try:
            return len(ipaddress.IPv6Address(value).compressed) > 6
        except ValueError:
            return False
    if kind == IP:
        return value.count(".") == 3 and all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in value.split(".")))
    digits = _digits(value)
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == CARD else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The matches of the base patterns, leftmost and apart within a kind: those that pass their test, and those that fail."""
    found: list[Span] = []
    if "@" in text:
        found += [Span(a, EMAIL, b, True, text[a:b]) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [Span(m.start(), IP, m.end(), True, m[0]) for m in _IP.finditer(text)]
        found += [Span(m.start(), CARD, m.end(), True, m[0]) for m in _CARD.finditer(text) if m.end() - m.start() >= 12]
        if "+" in text:
            found += [Span(m.start(), PHONE, m.end(), True, m[0]) for m in _PHONE.finditer(text)]
    good = [valid(s.kind, s.value) for s in found]
    return sorted(s for s, g in zip(found, good, strict=True) if g), sorted(s._replace(base=False) for s, g in zip(found, good, strict=True) if not g)


def _readings(failed: Span, text: str) -> Iterator[Span]:
    """Shorter readings of a match that failed: runs of its whole groups of digits, as many digits as its kind has, with a plus for phones."""
    groups = [m.span() for m in _DIGITS.finditer(text, failed.start, failed.end)]
    most = 19 if failed.kind == CARD else 15
    first = failed.start if failed.kind == PHONE else None
    for i in range(1 if first is not None else len(groups)):
        size = 0
        for a, b in (groups[k] for k in range(i, min(len(groups), i + most))):
            size += b - a
            if size > most:
                break
            start = groups[i][0] if first is None else first
            if size >= (12 if failed.kind == CARD else 9) and (start, b) != (failed.start, failed.end):
                yield Span(start, failed.kind, b, False, text[start:b])


def further_spans(text: str, failed: list[Span]) -> Iterator[Span]:
    """All further candidates, which may overlap: other readings of failed matches, and what the other generators find.
    Each generator reads the text once and gives a bounded number of spans for each place."""
    for s in failed:
        if s.kind in (CARD, PHONE):
            yield from _readings(s, text)
    done = 0
    for m in _AT.finditer(text):
        gap = start = m.start() - (text[m.start() - 1 : m.start()] == "\x20")
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _SPELLED.match(text, gap) if start < gap else None
        if found:
            yield Span(start, EMAIL, found.end(), False, text[start:gap] + "@" + _DOT.sub(".", found["host"]))
            done = found.end()
    if _DIGIT.search(text):
        for m in _MASKED.finditer(text):
            yield Span(m.start(), IP, m.end(), False, m[0].replace(m["dot"], "."))
        for m in _FOURS.finditer(text):
            yield Span(m.start(), CARD, m.end(), False, m[0].replace(m["gap"], " "))
        for pattern in (_GROUPS, _DIALLED):
            for m in pattern.finditer(text):
                yield Span(m.start(), PHONE, m.end(), False, m[0])
    if ":" in text:
        for m in _SIX.finditer(text):
            yield Span(m.start(), IP, m.end(), False, m[0])


def _overlaps(span: Span, apart: list[tuple[int, int]]) -> bool:
    """Whether a span overlaps one of the (start, end) that are sorted and apart."""
    at = bisect_left(apart, (span.end,))
    return at > 0 and apart[at - 1][1] > span.start


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s.start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s.end))
        else:
            out.append((s.start, s.end))
    return out


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and the further candidates that pass their kind's test and overlap no base span."""
    base, failed = base_spans(text)
    taken = _merged(base)
    return base, sorted({s for s in further_spans(text, failed) if valid(s.kind, s.value) and not _overlaps(s, taken)})


def format_features(span: Span) -> list[float]:
    """The plain form of a candidate and nothing around it. Whether it passes its test is not among these, nor does anything tell which
    generator or pattern proposed it, so that a written-out address is judged like a plain one."""
    kind, value = span.kind, span.value
    groups = [len(g) for g in _DIGITS.findall(value)]
    digits = sum(groups)
    last = value.rsplit(".", 1)[-1]
    if kind == EMAIL:
        own = [last.isalpha() and len(last) >= 2, value[0].isalnum(), value[-1].isalnum(), value.split("@")[0][-1:].isalnum(), ".." in value]
    elif kind == IP:
        six = ":" in value
        own = [six or not any(len(g) > 1 and g[0] == "0" for g in value.split(".")), six or len(groups) == 4, 0, 0, 0]
    elif kind == CARD:
        own = [digits in (15, 16), len(set(groups)) == 1, 3 <= int(_digits(value)[:1] or 0) <= 6, min(groups, default=0) >= 4, len(groups) in (1, 4)]
    else:
        own = [10 <= digits <= 13, groups[-1:] >= [3], max(groups, default=0) <= 5, len(groups) <= 5, value[-1:].isdigit()]
    return [*own, len(set(value)) / max(1, len(value)) < 0.2]


def context_features(text: str, span: Span) -> list[float]:
    """What stands around a candidate: its edges, and words that speak for its kind, for others, or against all. Its own form is not read."""
    start, kind, end = span.start, span.kind, span.end
    before, after, far = text[max(0, start - 40) : start], text[end : end + 2], text[end : end + 20]
    return [
        before[-1:].isalnum(), after[:1].isalnum(), bool(re.match(r"[.@:/_-]?\w", after)), bool(re.search(r"\w[.@:/_-]?$", before)), before[-1:] in ("$", "#", "=", '"', "+"),
        bool(_NEAR[kind].search(before)), any(p.search(before) for k, p in enumerate(_NEAR[:4]) if k != kind), bool(_NEAR[4].search(before)), bool(_NEAR[kind].search(far)),
    ]


def features(text: str, span: Span) -> list[float]:
    return [*context_features(text, span), *(float(span.kind == k) for k in range(len(KINDS))), *format_features(span)]


#: Places among the features: the context view has the context and the kind, the format view the kind and the form.
CONTEXT, KIND, FORM = slice(0, 13), slice(9, 13), slice(9, 19)


class BoostedTrees:
    """Logistic gradient boosting with trees of depth two over quantile bins."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, bins: int = 16):
        self.rounds, self.rate, self.bins = rounds, rate, bins

    def _best(self, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int]:
        best, total, weight = (0.0, 0, 0), grad.sum(), hess.sum()
        for f in range(codes.shape[1]):
            g = np.cumsum(np.bincount(codes[:, f], grad, self.bins + 1))[:-1]
            h = np.cumsum(np.bincount(codes[:, f], hess, self.bins + 1))[:-1]
            gain = g * g / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total**2 / (weight + 1)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, k)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> BoostedTrees:
        """weights: how many equal rows a row stands for."""
        weights = np.ones(len(y)) if weights is None else weights
        self.edges = [self._edges(x[:, f], weights) for f in range(x.shape[1])]
        codes = self._codes(x)
        self.start = float(np.log((weights @ y + 1) / (weights @ (1 - y) + 1)))
        raw, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = weights * (y - p), weights * p * (1 - p)
            _, f, k = self._best(codes, grad, hess)
            side, leaves = codes[:, f] > k, []
            for s in (False, True):
                rows = side == s
                _, f2, k2 = self._best(codes[rows], grad[rows], hess[rows])
                under = codes[:, f2] > k2
                leaves.append((f2, k2, *(float(self.rate * grad[rows & (under == u)].sum() / (hess[rows & (under == u)].sum() + 1)) for u in (False, True))))
            self.trees.append((f, k, leaves))
            raw = raw + self._tree(codes, self.trees[-1])
        return self

    def _edges(self, column: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Between all values where there are few, else at quantiles."""
        values = np.unique(column)
        if len(values) <= self.bins:
            return values[:-1]
        return np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1], method="inverted_cdf", weights=weights))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _tree(codes: np.ndarray, tree: tuple) -> np.ndarray:
        f, k, leaves = tree
        out = [np.where(codes[:, f2] > k2, high, low) for f2, k2, low, high in leaves]
        return np.where(codes[:, f] > k, out[1], out[0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return sum((self._tree(codes, t) for t in self.trees), np.full(len(x), self.start))


class TwoViews:
    """Trees that learned from each other's evidence: those of the context which spans pass their kind's test (digits that add up,
    numbers in range), which the context does not show; those of the form which spans stand free of letters, digits and
    words against them, which the form does not show. All kinds share the trees, so that a rare kind leans on the others."""

    def __init__(self, x: np.ndarray, passes: np.ndarray, free: np.ndarray, weights: np.ndarray):
        self.context, self.form = BoostedTrees().fit(x[:, CONTEXT], passes, weights), BoostedTrees().fit(x[:, FORM], free, weights)
        self.trees = self.context.trees + self.form.trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores of both views, and the kind."""
        return np.column_stack([self.context.raw(x[:, CONTEXT]), self.form.raw(x[:, FORM]), x[:, KIND]])


_ROW = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("passes", T.BooleanType()), T.StructField("free", T.BooleanType()), T.StructField("fold", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("at", T.LongType())])


def _examples(text: str) -> Iterator[tuple[int, bool, bool, list[float]]]:
    """Spans of a text that look like a kind, with two labels: whether the form passes its test, and whether the context leaves it
    alone. These are the base matches, the matches that fail, other readings of these, and base matches with their edges
    cut as far as they fail then: of those that pass, nothing says that they are wrong. What only the other generators propose is not learned from."""
    base, failed = base_spans(text)
    cut = {Span(s.start + a, s.kind, s.end - b, False, text[s.start + a : s.end - b]) for s in base for a, b in ((1, 0), (0, 1), (0, 3), (3, 0))}
    for s in [*base, *failed, *(r for f in failed if f.kind in (CARD, PHONE) for r in _readings(f, text)), *sorted(cut)]:
        passes = s.value != "" and valid(s.kind, s.value)
        if s.value and not (passes and s in cut):
            x = features(text, s)
            yield s.kind, passes, not (x[0] or x[1] or x[7]), x


def _calibrated(raw: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve from scores to probabilities, by Newton's steps; they lean a little to 1 for both views, 0 for the kinds."""
    lean = np.array([1.0, 1.0] + [0.0] * (raw.shape[1] - 2))
    loss = lambda w: float(weights @ (np.logaddexp(0, raw @ w) - y * (raw @ w)) + ((w - lean) ** 2).sum() / 2)
    w = lean
    for _ in range(50):
        p = _probability(raw, w)
        step = np.linalg.solve((raw * (weights * p * (1 - p))[:, None]).T @ raw + np.eye(len(w)), raw.T @ (weights * (y - p)) - (w - lean))
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
    return tuple(w.tolist())


def _probability(raw: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw @ np.array(weights), -30, 30)))


#: Spans that a kind's share of good ones is drawn to that of all kinds by.
PRIOR = 10


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", sample_docs: int | None = None, sample_spans: int | None = None, precision: float = 0.95) -> dict:
    """Fit the trees (TwoViews) on all documents, calibrate their score and give each kind its threshold.

    What is learned from are the spans with both labels (_examples) of every text. Their features are yes or no, so Spark counts the spans of each combination of
    features, labels and half, and the counts are all that comes to the driver: their number is bounded by the combinations (2^15 of them for a kind), not by the data. Half of
    the documents fit the trees. The others' spans, as far as they pass their test, which every candidate does, calibrate the sum of both views to a probability; a kind's
    threshold is `precision`, or a lower probability if of the spans above that one a share of `precision` stands free as well. That share is drawn to the one of
    all kinds (PRIOR). So there is a model for every kind at every size, unless a half has no span at all. sample_docs and sample_spans, where given, bound the documents
    (by a hash of the id) and the spans (by a hash of id and place), so that a sample does not depend on the partitions. Null texts and ids, ties and repeated
    rows are counted as they are; an empty table gives an empty model, and the method adds nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()):
                part = batch.slice(start, end - start)
                rows = [(kind, passes, free, fold, x, at + k) for t, fold, at in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) if t for k, (kind, passes, free, x) in enumerate(_examples(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.float64()), pa.int64()))], _ROW.names)

    if sample_docs is not None:
        chance = F.pmod(F.xxhash64(F.col(id), F.lit("pii")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        docs = docs.filter(chance < min(1.0, sample_docs / max(1, docs.count())))
    # the place of a span among its document's is added to a hash that leaves room for it
    hashed = F.shiftleft(F.pmod(F.xxhash64(F.col(id), F.lit("span")), F.lit(1 << 40)), 20)
    texts = docs.select(F.col(text).alias("t"), F.pmod(F.xxhash64(F.col(id), F.lit("fold")), F.lit(2)).cast("int").alias("fold"), hashed.alias("at"))
    spans = texts.mapInArrow(run, _ROW)
    if sample_spans is not None:
        spans = spans.orderBy(F.xxhash64("at"), "at", "kind", "passes", "free", "x").limit(sample_spans)
    rows = spans.groupBy("fold", "kind", "passes", "free", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["fold"], r["kind"], r["passes"], r["free"], r["x"]))
    x, kind, passes, free, fold, n = (np.array([r[c] for r in rows], float) for c in ("x", "kind", "passes", "free", "fold", "n"))
    fits, held = fold == 0, (fold == 1) & (passes == 1)
    if not fits.any() or not held.any():
        return {}
    views = TwoViews(x[fits], passes[fits], free[fits], n[fits])
    raw, truth, kind, n = views.raw(x[held]), free[held], kind[held], n[held]
    scale = _calibrated(raw, truth, n)
    p = _probability(raw, scale)
    levels, model, order = np.unique(p)[::-1], {}, np.argsort(-p, kind="stable")
    ends = np.searchsorted(-p[order], -levels, "right") - 1
    upto = lambda v: np.cumsum(v[order])[ends]  # the sum of v over the spans of each level's probability or more
    shared = upto(n * truth) / upto(n)
    for k in range(len(KINDS)):
        mine = n * (kind == k)
        good = levels[(upto(mine * truth) + PRIOR * shared) / (upto(mine) + PRIOR) >= precision]
        model[k] = (views, scale, max(0.5, min(float(min(good, default=precision)), precision)))
    return model


def select(text: str, maybe: list[Span], model: dict) -> list[Span]:
    """Of overlapping candidates those with the best calibrated scores, each at its kind's threshold or above; ties: the longer,
    then the first."""
    scored = []
    for kind in {s.kind for s in maybe} & model.keys():
        views, scale, least = model[kind]
        mine = [s for s in maybe if s.kind == kind]
        p = _probability(views.raw(np.array([features(text, s) for s in mine], float)), scale)
        scored += [(-round(x, 9), s.start - s.end, s) for s, x in zip(mine, p.tolist(), strict=True) if x >= least]
    chosen: list[tuple[int, int]] = []
    out = []
    for _, _, s in sorted(scored):
        if not _overlaps(s, chosen):
            insort(chosen, (s.start, s.end))
            out.append(s)
    return out


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])


def _lists(rows: list[list[Span]]) -> pa.Array:
    flat = [s for r in rows for s in r]
    parts = [pa.array([s[i] for s in flat], pa.int32()) for i in range(3)] + [pa.array([KINDS[s.kind] for s in flat], pa.string())]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.StructArray.from_arrays(parts, ["start", "rank", "end", "kind"]))


def find_personal_data(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Find personal data in every whole text: id, base and spans, arrays of (start, rank, end, kind).

    base has the matches of the fixed patterns; spans has these and the candidates that the model selects (see select); those overlap
    neither base spans nor each other. Places are code points, end exclusive. Null counts as empty. One pass without a
    shuffle; work is linear in the text, whatever it holds, but for sorting its candidates. Equal rows give equal rows; an
    empty table gives an empty result; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("spans", T.ArrayType(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(1)
            for start, end in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                base, spans = [], []
                for text in texts.slice(start, end - start).to_pylist():
                    sure, maybe = candidates(text or "")
                    base.append(sure)
                    spans.append(sorted([*sure, *select(text, maybe, model)]) if maybe else sure)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), _lists(base), _lists(spans)], ["id", "base", "spans"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id)


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts of base spans, a hash of them, all spans as text, and their number."""
    counts = [kind_count("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select(id, *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
