"""Ranked search against brute force: edges, ties, repeated rows, blocks of items, many partitions."""

import math
import random
import re
from collections import Counter

import pytest

from millrace.llm import ranked_search
from test_training_operators import EDGES, frame


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    counted = [(i, _terms(t)) for i, t in docs]
    counted = [(i, len(w), Counter(w)) for i, w in counted if w]
    total, length = len(counted), sum(n for _, n, _ in counted)
    held = Counter(w for _, _, c in counted for w in c)
    out = []
    for item, text in items.items():
        scored = []
        for place, (i, n, c) in enumerate(counted):
            m = 75 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * held[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in _terms(text) if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, place))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [ranked_search.ITEM_BYTES, 60])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", block)
    monkeypatch.setattr(ranked_search, "CHUNK", 50)
    monkeypatch.setattr(ranked_search, "SUMS", 40)
    pick = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "été", "x1", "ÉTÉ", "zeta9", "one", "two"]
    rows = EDGES + [(100 + i, " ".join(pick.choices(words, k=pick.randint(1, 60))), "en", "a") for i in range(150)] + [(300 + i, "tie one two", "en", "a") for i in range(30)] + [(300, "tie one two", "en", "a")]
    items = [(1, "alpha beta, été"), (2, "one two two tie"), (3, None), (4, ""), (5, "nowhere"), (5, "zeta9 nowhere"), (5, "zeta9 nowhere"), (None, "lost gamma"), (7, "word-school ÉCOLE")]
    held = {}
    for i, t in items:
        held.setdefault(i, set()).add(t or "")
    got = ranked_search.search(frame(spark, rows).repartition(7), spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score long"), k=12)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r[:2] for r in rows], {i: "\n".join(sorted(t)) for i, t in held.items()}, 12)


def test_nothing_to_search(spark):
    some, items = frame(spark, EDGES), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked_search.search(some.limit(0), items).count() == 0
    assert ranked_search.search(some, items.limit(0)).count() == 0
    assert ranked_search.search(some, spark.createDataFrame([(1, " - ")], "item_id long, text string")).count() == 0


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(ranked_search, "CHUNK", 5)
    text = "Abc-" + "déjà" * 10 + " x\ty z9 " + "q" * 30
    assert [w.decode() for part in ranked_search.term_chunks(text.encode()) for w in part] == _terms(text)
