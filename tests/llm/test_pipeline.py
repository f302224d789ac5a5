"""Each stage of the pipeline against brute force, on its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from millrace.llm import langid
from millrace.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "src1", 0), (90_002, "", "en", None, 0), (90_003, "123 !!", None, "src1", 6), (90_004, docs.filter("doc_id = 1").first().text.upper(), "en", "src2", 0)], docs.schema)
    seen = [written(docs.unionByName(extra), "documents")]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], small), name))
    return seen


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "source_mixing", "bpe_encoding"]


def test_language_rejects_only_what_has_none(stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    assert before - after == {90_001, 90_002, 90_003}


def test_copies_go(stages):
    before, after = stages[1].collect(), stages[2].collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    best = {}
    for r in before:
        best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())


def test_near_copies_go(stages):
    rows = stages[2].collect()
    sets = {}
    for r in rows:
        w = _words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i in ids if find(i) == i)


def test_mix_follows_targets(stages):
    size = {}
    for r in stages[3].collect():
        size.setdefault(r.source, []).append(len(_words(r.text)))
    total, taken = sum(map(sum, size.values())), {}
    for r in stages[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(_words(r.text))
    assert set(taken) <= set(size)
    assert abs(sum(taken.values()) - 1.5 * total) <= sum(max(s) for s in size.values())
    assert all(n <= 2 * sum(size[s]) for s, n in taken.items())


def test_tokens_decode_to_the_texts(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)


def test_run_is_the_stages_in_turn(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert langid.FLOOR > 0
