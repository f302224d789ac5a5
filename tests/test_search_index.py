"""Indexed search against its plain forms: grams, blocks with bounds, cells with angles."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.functions.stems import stem
from millrace.operators import grams, search


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_grams_find_what_contains_finds(spark):
    pick = random.Random(9)
    alphabet = "ab\né😀."
    hays = [(i, i, "".join(pick.choice(alphabet) for _ in range(pick.randrange(0, 40)))) for i in range(80)] + [(900, 1, None), (901, 1, ""), (902, 1, "a"), (903, 1, "long " * 20_000 + "needle")]
    needles = [(i, "".join(pick.choice(alphabet) for _ in range(pick.randrange(0, 6)))) for i in range(60)] + [(100, None), (101, "needle"), (102, "ng lo"), (102, "ng lo"), (103, "ng lo"), (104, "a")]
    got = grams.containing(spark.createDataFrame(needles, "query_id long, needle string"), spark.createDataFrame(hays, "doc_id long, created_at long, hay string"))
    assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
    want = sorted((q, d) for q, n in needles if n for d, _, h in hays if h and n in h)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == want
    assert grams.containing(spark.createDataFrame([], "query_id long, needle string"), spark.createDataFrame(hays, "doc_id long, created_at long, hay string")).count() == 0


def test_blocks_give_the_same_rows_and_are_skipped(spark):
    pick = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "common"]
    body = lambda i: " ".join(pick.choices(words, k=12)) + " common" * (30 if i in (40, 41) else 1) + (" alpha beta" * 20 if i == 77 else "")
    docs = spark.createDataFrame([(i, f"title {pick.choice(words)}", "", body(i), True) for i in range(400)], "doc_id long, title string, summary string, body string, is_current boolean")
    queries = spark.createDataFrame([(1, "common"), (2, "alpha beta"), (3, "alpha OR gamma"), (4, '"alpha beta" -delta'), (5, "nowhere common"), (6, "the"), (7, "-alpha"), (8, 'gamma -"delta"')], "query_id long, text string")
    postings = search.build_postings(docs).cache()
    blocked, tops = search.block_tops(postings, 16)
    for k in (3, 20):
        rows = lambda df: sorted((r.query_id, r.doc_id, r.score, r.rank) for r in df.collect())
        assert rows(search.block_search(queries, blocked, tops, k)) == rows(search.keyword_search(queries, postings, k))
    one = queries.filter("query_id = 1")
    read = []
    scored = search._scored
    try:
        search._scored = lambda asked, hits, p: (read.append(hits.count()), scored(asked, hits, p))[1]
        search.block_search(one, blocked, tops, 2).collect()
    finally:
        search._scored = scored
    assert sum(read) < postings.filter(F.col("term") == "common").count() / 2


def test_cells_leave_out_products_but_no_neighbour(spark, monkeypatch):
    import numpy as np

    from millrace.operators import nearest

    monkeypatch.setattr(nearest, "ROWS_A_CELL", 20)
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, 8))
    v = np.concatenate([centres[pick.integers(12, size=500)] + 0.05 * pick.normal(size=(500, 8)), np.repeat(centres[:1], 60, axis=0)])  # with a hot cell of equal rows
    rows = spark.createDataFrame([(i, x.tolist(), i % 50) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 8, 1)], "doc_id long, embedding array<double>, at long")
    queries = rows.filter("doc_id % 9 = 0 OR doc_id >= 890").withColumnRenamed("doc_id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for before, least, block in ((None, None, 4096), ("at", 0.2, 10)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        effort = []
        got = {}
        for r in search.semantic_search(queries, rows, 5, least=least, before=before, effort=effort).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.doc_id, round(r.score, 9)))
        for q in range(0, len(v), 9):
            scores = [(-round(float(s), 9), i) for i, s in enumerate(unit @ unit[q]) if (before is None or i % 50 < q % 50) and (least is None or s > least)]
            want = [(n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5], 1)]
            assert [x[2] for x in sorted(got.get(q, []))] == [x[2] for x in want]  # equal rows differ by rounding, so ids may
            assert len({x[1] for x in got.get(q, [])}) == len(want)
        assert sum(a for a, _ in effort) < 0.7 * sum(b for _, b in effort)
    assert search.semantic_search(queries, rows.limit(0), 5).count() == 0 and search.semantic_search(queries.limit(0), rows, 5).count() == 0


def test_postings_equal_a_plain_count(spark):
    """Empty, null and stop-word texts, repeated ids and words, one stem of several words, a long text; cut bodies too."""
    long = "Running runs and ran; the runner RUNS. " * 3000
    rows = [(1, "Runs", "runs running", long), (2, None, "", None), (3, "the of", " .,- ", "x"), (4, "Été ÉTÉ", "a1 2b", "été's end"), (5, "cats cat", None, "Cat"), (5, "cats cat", None, "Cat"), (None, "dogs", "dog", "")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, summary string, body string").withColumns({"is_current": F.lit(True), "term": F.lit("clash"), "field": F.lit("clash"), "positions": F.lit("clash")})
    old = docs.filter("doc_id = 1").withColumns({"doc_id": F.lit(9).cast("long"), "is_current": F.lit(False)})
    spelled = {w for r in rows for x in r[1:] if x for w in re.findall(r"[^\W_]+", x.lower() + " " + x.lower()[:50])}  # a cut text ends in a part of a word
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for w in spelled], "w string").withColumn("s", stem(F.col("w"))).collect()}
    for chars in (None, 50):
        want = defaultdict(list)
        for doc_id, *texts in rows:
            for field, text in zip(("title", "summary", "body"), texts):
                for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower()[: chars if field == "body" else None])):
                    if w not in search.STOP:
                        want[stems[w], doc_id, field].append(i)
        got = {(r.term, r.doc_id, r.field): (r.tf, r.positions) for r in search.build_postings(docs.unionByName(old), chars).collect()}
        assert got == {k: (len(v), sorted(v)) for k, v in want.items()}
    assert search.build_postings(docs.limit(0)).count() == 0


def test_asked_postings_are_those_of_the_asked_stems(spark, small):
    """An index for queries: the same rows as the whole index has for their stems, without a shuffle of texts or of other words."""
    texts = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "split(text, ' ')[1] AS title", "substring(text, 1, 99) AS summary", "concat(text, ' aing aed a I.d. ying ties tied skies sky') AS body", "true AS is_current")
    queries = spark.createDataFrame([(1, '"ran skis" OR -running'), (2, "a aing the dogs"), (3, "tie ski y"), (4, "")], "query_id long, text string")
    asked = search.asked_terms(queries)
    whole = search.build_postings(texts).join(asked, "term", "left_semi")
    rows = lambda df: sorted((r.term, r.doc_id, r.field, r.tf, r.positions) for r in df.collect())
    few = search.build_postings(texts, asked=asked)
    assert rows(few) == rows(whole) != []
    exchanged = [line for line in _plan(few).split("Optimized Logical Plan")[1].splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert exchanged == []


def test_words_begin_like_their_stems(spark, small):
    pick = random.Random(4)
    ends = ["", "s", "ed", "ing", "edly", "ingly", "ies", "ied", "y", "e", "eed", "sses", "ational", "ly", "'s"]
    made = {"".join(pick.choice("abeiouysltz") for _ in range(pick.randrange(0, 4))) + pick.choice(ends) for _ in range(4000)}
    words = spark.createDataFrame([(w,) for w in made if w], "term string").union(spark.read.parquet(f"{small}/documents.parquet").select(F.explode(search.terms(F.col("text"))))).distinct()
    begun = words.withColumn("stem", stem(F.col("term"))).select("term", "stem", search._beginnings(F.col("stem")).alias("b"))
    assert begun.groupBy("term", "stem").agg(F.max(F.col("b") == F.substring("term", 1, 2)).alias("ok")).filter("NOT ok").collect() == []


def test_an_asked_index_stems_each_word_once(spark):
    """Each different word is stemmed once: what is stemmed is a table of words, not the words of each text."""
    texts = spark.createDataFrame([(i, "running shoes", "running", "running runs runner", True) for i in range(50)], "doc_id long, title string, summary string, body string, is_current boolean")
    held = {}
    real = search.written
    try:
        search.written = lambda df, name: held.setdefault(name, real(df, name))
        few = search.build_postings(texts, asked=search.asked_terms(spark.createDataFrame([(1, "run")], "query_id long, text string")))
    finally:
        search.written = real
    assert sorted(r.term for r in held["near-words"].collect()) == ["runner", "running", "runs"]
    assert few.count() == 150


def test_clauses_decided_in_one_row(spark):
    """Phrases with a word twice, across fields and after stop words; negated words; the nearest two words over fields."""
    docs = spark.createDataFrame(
        [(1, "red red fox", "blue", "x", True), (2, "red fox red", "red", "y", True), (3, "fox", "red", "red then the fox", True), (4, "fox and red", "", "fox one two red", True), (5, "red", "fox", "", True)],
        "doc_id long, title string, summary string, body string, is_current boolean",
    )
    queries = spark.createDataFrame([(1, '"red red"'), (2, '"red the the fox"'), (3, "red fox"), (4, "red -blue"), (5, 'fox -"blue red"'), (6, '"red"')], "query_id long, text string")
    got = {}
    for r in search.keyword_search(queries, search.build_postings(docs), 10).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert got[1] == {1: 2.0} and set(got[2]) == {3} and set(got[4]) == {2, 3, 4, 5} and 5 not in got and set(got[6]) == {1, 2, 3, 4, 5}
    assert got[3] == {1: 6.0, 2: 6.8, 3: round(1.8 * (1 + 1 / 3), 6), 4: round(2.4 * 1.5, 6), 5: 1.4}
