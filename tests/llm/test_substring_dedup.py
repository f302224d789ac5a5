"""Repeated passages against brute force: windows by place, hot passages, long texts, repeated ids."""

import random
import re

import pytest

from millrace.llm import substring_dedup
from test_training_operators import EDGES, frame


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = _words(t)
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            if i is not None:
                first[run] = min(first.get(run, i), i)
    out = []
    for i, t in rows:
        w, gone = _words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [substring_dedup.CHUNK, 40])
@pytest.mark.parametrize("window", [50, 12])
def test_repeats_against_brute_force(spark, monkeypatch, chunk, window):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    pick = random.Random(window)
    prose = lambda n: [pick.choice("abcdefghijklmnopqrstuvwxyz") * pick.randint(1, 2) + str(pick.randint(0, 40)) for _ in range(n)]
    passage, line = prose(90), prose(6)
    rows = list(EDGES)
    for i in range(60):  # a passage cut anywhere, with other words or a changed word
        a, b = sorted((pick.randint(0, 30), pick.randint(45, 90)))
        own = prose(pick.randint(0, 30)) + passage[a:b] + prose(pick.randint(0, 30))
        if i % 3 == 0:
            own[len(own) // 2] = "changed"
        rows.append((1000 - i * 7 if i % 2 else 1000 + i, " ".join(own), "en", "a"))
    rows += [(2000 + i, "\t".join(line * 30), "en", "a") for i in range(4)] + [(2100, "\n".join(line * 30 + passage + line * 12), "en", "a")]
    rows += [(3000, " ".join(passage), "en", "a"), (3000, " ".join(passage), "en", "a"), (3000, " ".join(passage[5:] + passage[:60]), "en", "a"), (None, " ".join(passage), "en", "a")]
    few = [(i, " ".join(pick.choices(["x", "y"], k=pick.randint(10, 130))), "en", "a") for i in range(4000, 4040)]  # hardly any different anchors
    rows += few
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(5), window=window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r[:2] for r in rows], window)


def test_factors_point_at_what_they_repeat(spark):
    pick = random.Random(3)
    texts = {i: [f"w{pick.randint(0, 500)}" for _ in range(300)] for i in range(6)}
    texts[4][40:160] = texts[1][100:220]
    texts[5] = texts[2][:]
    rows = [(i, " ".join(w), "en", "a") for i, w in texts.items()]
    found = {r.doc_id: [tuple(f) for f in r.factors] for r in substring_dedup.factors(frame(spark, rows)).collect()}
    assert found == {4: [(40, 120, 1, 100)], 5: [(0, 300, 2, 0)]}
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_equal_passages_are_cut_alike():
    pick = random.Random(5)
    words = [substring_dedup._words(" ".join(f"w{pick.randint(0, 99)}" for _ in range(200)).encode()) for _ in range(2)]
    shared = substring_dedup._words(" ".join(f"s{pick.randint(0, 999)}" for _ in range(400)).encode())
    import numpy as np

    keys = [set(substring_dedup.blocks(np.concatenate([w, shared, w]), 50)[1].tolist()) for w in words]
    assert len(keys[0] & keys[1]) >= 10
