"""Goldens and invariants for chunks, versions, analysis, the graph, the ledger and search."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import analysis, chunking, citations, folders, graph, ledger, registry, search, versions


def test_packing():
    p = lambda n, k="paragraph", at="a": (" ".join(["w"] * n), k, at)
    sizes = lambda blocks, limit: [(len(c.split()), at) for c, at in chunking.pack_blocks(blocks, limit)]
    assert sizes([], 10) == []
    assert sizes([p(3), p(4)], 10) == [(7, "a")]
    assert sizes([p(3), p(4, "code", "c"), p(2, at="d")], 10) == [(9, "a")]
    assert sizes([p(3), p(9, "table", "t"), p(2, at="d")], 10) == [(3, "a"), (9, "t"), (2, "d")]
    # a segment over the limit is not packed: each block that fits is a chunk
    assert sizes([p(6), p(6, at="b"), p(1, at="c")], 10) == [(6, "a"), (6, "b"), (1, "c")]
    long = "One two three. Four five six. Seven eight nine ten. " + " ".join(["w"] * 12)
    assert [c for c, _ in chunking.pack_blocks([(long, "paragraph", "a")], 6)] == ["One two three.", "Four five six.", "Seven eight nine ten. w w", "w w w w w w", "w w w w"]


def test_chunks_overlap_and_bounds(spark):
    rows = [(1, [{"content": f"A{i} " + " ".join(f"w{i}_{k}" for k in range(30)) + ".", "block_type": "paragraph", "source_locator": f"line:{i}"} for i in range(20)]), (2, []), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, blocks array<struct<content:string,block_type:string,source_locator:string>>")
    got = chunking.chunk_blocks(docs, max_tokens=40, overlap=5).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(20)) and {r.doc_id for r in got} == {1}
    assert all(r.token_count <= 45 for r in got) and got[0].token_count == 31 and got[1].token_count == 36
    assert got[1].content.startswith("w0_25 w0_26") and "\n\nA1 " in got[1].content and all(len(r.content_hash) == 64 for r in got)
    counted = chunking.chunk_blocks(docs, max_tokens=200, overlap=0, counter=len, cut=lambda t, n: [t[i : i + n] for i in range(0, len(t), n)]).collect()
    assert all(len(r.content) <= 200 for r in counted)


def test_delta(spark):
    make = lambda rows: chunk_frame(spark, rows)
    words = " ".join(f"t{i}" for i in range(40))
    old = make([(1, 0, "same"), (1, 1, words), (1, 2, "gone for good"), (2, 0, "dup"), (2, 1, "dup")])
    new = make([(1, 0, words + " extra"), (1, 1, "same"), (1, 2, "brand new"), (2, 0, "dup"), (3, 0, "first")])
    got = {(r.doc_id, r.change, r.old_index, r.new_index) for r in versions.chunk_delta(old, new).collect()}
    assert got == {(1, "unchanged", 0, 1), (1, "modified", 1, 0), (1, "removed", 2, None), (1, "added", None, 2), (2, "unchanged", 1, 0), (3, "added", None, 0)}
    meta = {r.doc_id: r for r in versions.delta_metadata(versions.chunk_delta(old, new)).collect()}
    assert meta[1].change_ratio == 0.75 and meta[1].reclassify and meta[2].no_changes and not meta[2].reclassify


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, content string").withColumn("content_hash", F.sha2("content", 256))


def test_greedy_takes_each_old_chunk_once(spark):
    words = [f"t{i}" for i in range(40)]
    old = chunk_frame(spark, [(1, 0, " ".join(words)), (1, 1, " ".join(words[:39] + ["x"]))])
    new = chunk_frame(spark, [(1, k, " ".join(words[:38] + [f"n{k}", "y"])) for k in range(3)])
    got = [(r.change, r.old_index, r.new_index) for r in versions.chunk_delta(old, new).orderBy("new_index").collect()]
    assert got == [("modified", 0, 0), ("modified", 1, 1), ("added", None, 2)]


@pytest.mark.parametrize("rounds", [6, 1])
def test_greedy_pairs_against_a_walk(spark, monkeypatch, rounds):
    import random

    pick = random.Random(7)
    monkeypatch.setattr(versions, "ROUNDS", rounds)
    pairs = {(d, o, n): pick.choice([0.85, 0.9, 0.95]) for d in range(6) for n in range(14) for o in pick.sample(range(14), pick.randint(0, 4 if d else 12))}
    pairs |= {(9, o, n): 0.9 for o in range(12) for n in range(12)}  # all alike: each waits for the one before
    want = set()
    for d in {k[0] for k in pairs}:
        used = set()
        for n in range(14):
            free = sorted((-s, o) for (x, o, y), s in pairs.items() if x == d and y == n and o not in used)
            if free:
                used.add(free[0][1])
                want.add((d, free[0][1], n, -free[0][0]))
    frame = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "doc_id long, old_index int, new_index int, similarity double")
    got = [(r.doc_id, r.old_index, r.new_index, r.similarity) for r in versions.greedy_pairs(frame).collect()]
    assert len(got) == len(want) and set(got) == want


def test_line_diff_covers_both_sides(spark):
    a, b = "Line A\nLine B\nLine C", "Line A\nLine D\nLine C\nLine E"
    row = versions.line_diff(spark.createDataFrame([(a, b), (None, "x")], "before_text string, after_text string")).collect()
    assert sum(o.i2 - o.i1 for o in row[0].ops) == 3 and sum(o.j2 - o.j1 for o in row[0].ops) == 4 and row[1].ops[0].op == "insert"
    got = spark.createDataFrame([("same", "same"), ("abcd", "bcde"), ("", "x"), (None, None)], "a string, b string").select(versions.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [1.0, 0.75, 0.0, 1.0]


def test_edits_leave_one_current_version(spark):
    docs = spark.createDataFrame([(1, 1, "t", "a", 1, True), (2, 2, "t", "b", 1, False)], "doc_id long, source_file_id long, title string, body string, version int, is_current boolean")
    edits = spark.createDataFrame([(10, 1, "x", "u", "j"), (11, 1, "y", "v", "k"), (12, 2, "z", "u", "j"), (13, 9, "z", "u", "j")], "edit_id long, doc_id long, body string, edited_by string, justification string")
    after, diffs, refused = versions.apply_edits(docs, edits, 100)
    assert sorted((r.doc_id, r.version, r.is_current, r.body) for r in after.collect()) == [(1, 1, False, "a"), (2, 1, False, "b"), (110, 2, False, "x"), (111, 3, True, "y")]
    assert sorted((r.before_text, r.after_text) for r in diffs.collect()) == [("a", "x"), ("x", "y")] and sorted(r.edit_id for r in refused.collect()) == [12, 13]


def test_model_json():
    f = analysis.find_json
    assert f('{"a": 1}') == {"a": 1} and f("x\n```json\n[1]\n```") == [1] and f('thinking [] then [{"b": 2}] end') == [{"b": 2}] and f('pre {"c": {"d": 1}} post') == {"c": {"d": 1}}
    assert f("") == {} and f(None) == {} and f("nothing") == {}


@pytest.mark.parametrize(("raw", "key"), [("The Acme Corp.", "acme"), ("Acme, Inc", "acme"), ("  ACME   Labs LLC ", "acme labs"), ("Theory Ltd.", "theory"), ("acme;", "acme"), ("Inc", ""), ("", ""), ("Acme-Co", "acme-"), ("Acme.Inc", "acme"), ("The Inc", ""), ("Foo Incorporated", "foo incorporated"), ("Cisco", "cisco"), ("\u00c9Co", "\u00e9co"), ("A\u00a0 B, llp. ", "a b"), ("A, llp . ", "a, llp"), ("Acme Inc Ltd", "acme inc")])
def test_canonical(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "n string").select(T.canonical_name(F.col("n")).alias("c")).first().c == key


def test_reasoning(spark):
    rows = [("<think>a</think>b</think> c ", "c"), ("Okay, so\nthe user wants\n  A title\nmore", "A title"), ("plain ", "plain"), ("Okay, only this", "Okay, only this"), (None, None)]
    assert [r.s for r in spark.createDataFrame([(a,) for a, _ in rows], "a string").select(T.strip_reasoning(F.col("a")).alias("s")).collect()] == [b for _, b in rows]


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "b", "R", 1), ("b", "c", "R", 2), ("c", "d", "R", 1), ("a", "x", "R", 9), ("x", "c", "R", 1), ("z", "z", "R", 1)], "src string, dst string, rel string, weight long")
    seeds = spark.createDataFrame([("a",), ("z",)], "seed string")
    assert sorted((r.seed, r.node, r.hop) for r in graph.neighbors(edges, seeds, 2).collect()) == [("a", "b", 1), ("a", "c", 2), ("a", "x", 1)]
    mentions = spark.createDataFrame([("a", 1), ("z", 1)], "canonical string, doc_id long")
    assert ("z", "a", 2) in {(r.seed, r.node, r.hop) for r in graph.neighbors(edges, seeds, 2, mentions=mentions).collect()}
    wanted = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "z"), ("d", "a")], "src string, dst string")
    got = {(r.src, r.dst): (r.path, r.hops, r.total_weight) for r in graph.shortest_path(edges, wanted).collect()}
    assert got == {("a", "d"): ("a > b > c > d", 3, 4), ("a", "a"): ("a", 0, 0), ("d", "a"): ("d > c > b > a", 3, 4)}


def test_paths_from_both_ends(spark):
    """Against a plain search on random graphs, for odd and even bounds."""
    import random

    pick = random.Random(6)
    rows = [(a, b, "R", pick.randint(1, 9)) for a, b in {tuple(pick.sample("abcdefghijklmnop", 2)) for _ in range(22)}]
    near = {}
    for a, b, _, w in rows:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = max(w, near.get(x, {}).get(y, 0))
    wanted = [(a, b) for a in "abcdef" for b in "aghijklmnopz"]
    edges, asked = spark.createDataFrame(rows, "src string, dst string, rel string, weight long"), spark.createDataFrame(wanted, "src string, dst string")
    for most in (0, 1, 3, 4):
        want = {}
        for a, b in wanted:
            level, seen = {a: [a]}, {a}
            for hop in range(most + 1):
                if b in level:
                    path = level[b]
                    want[a, b] = (" > ".join(path), hop, sum(near[x][y] for x, y in zip(path, path[1:])))
                    break
                after = {}
                for node, path in level.items():
                    for y in near.get(node, {}):
                        if y not in seen and (y not in after or path + [y] < after[y]):
                            after[y] = path + [y]
                level, seen = after, seen | set(after)
        got = {(r.src, r.dst): (r.path, r.hops, r.total_weight) for r in graph.shortest_path(edges, asked, most).collect()}
        assert got == want


def test_subtrees_are_ranges(spark):
    paths = spark.createDataFrame([("a", "/a"), ("b", "/a/b"), ("c", "/a/b/c"), ("d", "/a b"), ("e", "/a/z"), ("f", "/q"), ("x", None)], "id string, path string")
    got = {r.id: (r.place, r.last) for r in folders.folder_intervals(paths).collect()}
    assert got == {"a": (1, 4), "b": (2, 3), "c": (3, 3), "e": (4, 4), "d": (5, 5), "f": (6, 6)}
    sums = folders.subtree_sums(folders.folder_intervals(paths), spark.createDataFrame([("c", 2), ("c", 3), ("e", 1), ("f", 7), ("gone", 9)], "id string, n long"))
    assert {r.id: r.n for r in sums.collect()} == {"a": 6, "b": 5, "c": 5, "e": 1, "d": 0, "f": 7}


def test_merge_equals_rebuild(spark):
    mentions = spark.createDataFrame([(d, p, n, "t", d) for d in range(6) for p, n in enumerate(["Acme Inc", "Bolt", f"E{d % 3}"])], "doc_id long, position int, name string, type string, created_at long")
    relations = spark.createDataFrame([(d, 0, "The Acme", "Bolt", "made of", None, f"d{d}", d) for d in range(6)], "doc_id long, position int, source string, target string, type string, confidence double, description string, created_at long")
    v, _, e = graph.rebuild_graph(mentions, relations)
    v1, _, e1 = graph.rebuild_graph(mentions.filter("doc_id < 3"), relations.filter("doc_id < 3"))
    v2, e2 = graph.merge_graph(v1, e1, mentions.filter("doc_id >= 3"), relations.filter("doc_id >= 3"))
    assert sorted(map(str, v.collect())) == sorted(map(str, v2.select(v.columns).collect())) and sorted(map(str, e.collect())) == sorted(map(str, e2.select(e.columns).collect()))
    assert e.first().rel == "MADE_OF" and e.first().confidence == 0.5


def test_changes_equal_a_rebuild(spark):
    """Documents come, change and go; the first of a name goes and the next takes its place; an end becomes known and unknown again."""
    import random

    pick = random.Random(8)
    names = ["Acme Inc", "acme", "The Acme", "Bolt", "Bolt GmbH", "Cog", "Dash"]
    make = lambda d: ([(d, p, pick.choice(names[: 5 + d % 3]), pick.choice(["t", None]), pick.randint(0, 9)) for p in range(pick.randint(0, 4))], [(d, p, pick.choice(names), pick.choice(names), "r", None, f"d{d}{p}", pick.randint(0, 9)) for p in range(pick.randint(0, 3))])
    frames = lambda held: (spark.createDataFrame([r for m, _ in held.values() for r in m], "doc_id long, position int, name string, type string, created_at long"), spark.createDataFrame([r for _, s in held.values() for r in s], "doc_id long, position int, source string, target string, type string, confidence double, description string, created_at long"))
    held = {d: make(d) for d in range(12)}
    state = graph.graph_state(*frames(held))
    for gone, come in (([0, 1, 2, 3], [2, 20]), ([d for d in range(4, 12)] + [99], [5, 6]), (list(range(30)), [])):
        new = {d: make(d) for d in come}
        held = {d: x for d, x in held.items() if d not in gone} | new
        state = graph.change_graph(state, spark.createDataFrame([(d,) for d in gone], "doc_id long"), *frames(new))
        for ours, theirs in zip(graph.visible_graph(state), graph.rebuild_graph(*frames(held))):
            assert sorted(map(str, ours.select(theirs.columns).collect())) == sorted(map(str, theirs.collect()))


def test_costs(spark):
    rows = spark.createDataFrame([(1, "p", "small-1", 1000, 500), (2, "p", "large-2", 1000, 1000), (3, "q", "x", 5, 5)], "id int, provider string, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([(1, "p", "small*", 0.003, 0.015), (2, "p", "large-?", 0.015, 0.075)], "priority int, provider string, glob string, input_price double, output_price double")
    assert [round(r.estimated, 6) for r in ledger.estimate_cost(rows, prices).orderBy("id").collect()] == [0.0105, 0.09, 0.0]


def test_rate_limit_windows_open_with_a_request(spark):
    times = [0, 10, 59, 60, 61, 300, 301, 361]
    rows = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)] + [(99, "other", 5)], "id long, key string, s long").selectExpr("id", "key", "timestamp_seconds(s) AS created_at")
    got = {r.id: (r.nth, r.allowed, r.remaining, r.reset_in) for r in ledger.rate_limit(rows, "key", 2, 60).collect()}
    assert got == {0: (1, True, 1, 60), 1: (2, True, 0, 50), 2: (3, False, 0, 1), 3: (1, True, 1, 60), 4: (2, True, 0, 59), 5: (1, True, 1, 60), 6: (2, True, 0, 59), 7: (1, True, 1, 60), 99: (1, True, 1, 60)}


def test_cursor_keeps_ties(spark):
    rows = spark.createDataFrame([(i, 7 if i < 5 else i) for i in range(12)], "id long, v long")
    seen, after = [], None
    while True:
        page = registry.list_rows(rows, "v", "id", 4, after=after).orderBy(F.desc("v"), F.desc("id")).collect()
        seen += [r.id for r in page]
        if not page or not page[0].has_more:
            break
        after = registry.encode_cursor(page[-1].v, page[-1].id)
    assert seen == [11, 10, 9, 8, 7, 4, 3, 2, 1, 0, 6, 5]


def test_search_forms(spark):
    docs = spark.createDataFrame([(1, "Red apple", "s", "green pear and red plum", True), (2, "Pear", "s", "an apple that is green", True), (3, "Old", "s", "red apple", False), (4, "Mixed", "s", "apple red", True)], "doc_id long, title string, summary string, body string, is_current boolean")
    posts = search.build_postings(docs)
    ask = lambda text: sorted(r.doc_id for r in search.keyword_search(spark.createDataFrame([(1, text)], "query_id long, text string"), posts).collect())
    assert ask("red apple") == [1, 4] and ask('"red apple"') == [1] and ask("plum OR pear") == [1, 2] and ask("apple -green") == [4] and ask("the") == [] and ask('"apple red"') == [4]
    snippet = spark.createDataFrame([("A red, RED apple",)], "t string").select(search.highlight(F.col("t"), F.array(F.lit("red")), 5).alias("s")).first().s
    assert snippet == "A <mark>red,</mark> <mark>RED</mark> apple"
    long = " ".join(["red" if i in (3, 5, 9, 40, 41, 80) else f"w{i}" for i in range(100)])
    got = spark.createDataFrame([(long,), ("no hit here",), ("",), (None,)], "t string").select(search.highlight(F.col("t"), F.array(F.lit("red")), 5).alias("s")).collect()
    piece = lambda a, b: " ".join("<mark>red</mark>" if i in (3, 5, 9, 40, 41, 80) else f"w{i}" for i in range(a, b))
    assert [r.s for r in got] == [f"{piece(0, 10)} ... {piece(35, 45)}", "no hit here", "", None]


def test_stems(spark):
    from millrace.functions.stems import stem, stem_sql

    pairs = dict(x.split(":") for x in """contracts:contract running:run happily:happili nationalization:nation relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper
        feudalism:feudal hopefulness:hope formality:formal triplicate:triplic goodness:good revival:reviv adjustable:adjust replacement:replac controlling:control rolling:roll hopping:hop hoping:hope cries:cri ties:tie by:by
        say:say cry:cri kiwis:kiwi gas:gas gaps:gap consistently:consist knightly:knight agreed:agre feed:feed plastered:plaster sing:sing sized:size filing:file failing:fail decisiveness:decis conformably:conform
        differently:differ analogously:analog adoption:adopt probate:probat rate:rate roll:roll boys:boy enjoyed:enjoy caresses:caress bus:bus arguments:argument databases:databas queries:queri apologies:apolog
        y:y ly:ly été:été 1990s:1990s""".split())
    words = spark.createDataFrame([(w,) for w in pairs] + [(None,)], "term string")
    assert {r.term: r.stem for r in words.withColumn("stem", stem(F.col("term"))).collect()} == pairs | {None: None}
    import duckdb

    listed = ", ".join(f"('{w}')" for w in pairs)
    assert dict(duckdb.sql(f"WITH v(term) AS (VALUES {listed}) SELECT term, stem FROM ({stem_sql('v')})").fetchall()) == pairs


def test_other_forms_of_a_word_are_found(spark):
    docs = spark.createDataFrame([(1, "Contracts were signed"), (2, "a contract"), (3, "contracting parties sign"), (4, "contra")], "doc_id long, body string").selectExpr("doc_id", "'' AS title", "'' AS summary", "body", "true AS is_current")
    asked = spark.createDataFrame([(1, "contract"), (2, '"contracted party"'), (3, "contracts -signing")], "query_id long, text string")
    hits = search.keyword_search(asked, search.build_postings(docs), 5).collect()
    assert sorted((r.query_id, r.doc_id) for r in hits) == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 2)]


def test_full_body(spark):
    docs = spark.createDataFrame([(1, "T", "S", [("H", "hs", ["p1", "p2"])], [("Ann", "boss"), ("Bob", None)], ["q"])], "doc_id long, title string, summary string, sections array<struct<heading:string,summary:string,key_points:array<string>>>, people array<struct<name:string,role:string>>, key_quotes array<string>")
    cited = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, citation_index int, source_locator string")
    body = citations.assemble_full_markdown(docs, cited).first().body_markdown
    assert body == "# T\n\nS\n\n## H\n\nhs\n- p1\n- p2\n\n## People\n\n- Ann (boss)\n- Bob\n\n## Key quotes\n\n> q\n\n## Citations\n\n[1] a\n[2] b"


def test_all_entities_of_a_document_are_partners(spark):
    names = {1: [f"N{i:04}" for i in range(2 * graph.PAIR_BLOCK + 50)], 2: ["N0500", "N0561", "Zed"], 3: ["N0500", "N0561"], 4: ["Zed", "N0010"], 5: ["Alone"]}
    rows = [(d, [(n, "person", "", 1) for n in ns]) for d, ns in names.items()]
    docs = spark.createDataFrame(rows, "doc_id long, entities array<struct<name:string,type:string,context:string,mentions:int>>").selectExpr("doc_id", "'t' AS title", "timestamp'2024-01-01' AS created_at", "true AS is_current", "entities")
    got = {r.canonical: r.partners for r in graph.entity_network(docs, 2).collect()}
    together = {}
    for ns in names.values():
        for a in ns:
            for b in ns:
                if a != b:
                    together.setdefault(a.lower(), {}).setdefault(b.lower(), []).append(1)
    assert got == {n.lower(): ",".join(sorted(together.get(n.lower(), {}), key=lambda b: (-len(together[n.lower()][b]), b))[:2]) for ns in names.values() for n in ns}


def test_rate_limit_of_steady_traffic(spark):
    import random

    pick, width, rows = random.Random(3), 60_000_000, []
    for key, n, span in (("steady", 3000, 200), ("sparse", 300, 5000), ("even", 0, 0), (None, 50, 20)):
        rows += [(len(rows) + i, key, 1_700_000_000_000_000 + pick.randrange(span * 60) * 1_000_000 + pick.choice((0, 0, 100_000))) for i in range(n)]
    rows += [(len(rows) + i, "even", 1_700_000_000_100_000 + i * width + d) for i, d in enumerate([0] * 100 + [-1, 0, 1])]
    frame = spark.createDataFrame(rows, "id long, key string, us long").selectExpr("id", "key", "timestamp_micros(us) AS created_at")
    found = ledger.rate_limit(frame, "key", 4, 60)
    want, state = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        start, n = state.get(key, (None, 0))
        start, n = (t, 1) if start is None or t >= start + width else (start, n + 1)
        state[key], want[i] = (start, n), (key, n, n <= 4, max(0, 4 - n), -((t - start - width) // 1_000_000))
    assert {r.id: tuple(r)[1:] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan  # no group of a key's history in one task


def test_words_after_ten_thousand_characters_are_found(spark):
    far = "filler " * 3000
    docs = spark.createDataFrame([(1, far + "late red bird"), (2, "late bird"), (3, "late " + far + "banned")], "doc_id long, body string").selectExpr("doc_id", "'' AS title", "'' AS summary", "body", "true AS is_current")
    asked = spark.createDataFrame([(1, "late"), (2, '"red bird"'), (3, "late -banned")], "query_id long, text string")
    hits = search.keyword_search(asked, search.build_postings(docs), 5).collect()
    assert sorted((r.query_id, r.doc_id) for r in hits) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)]


def test_paths_of_any_depth(spark):
    rows = [("f0", "n0", None)] + [(f"f{i}", f"n{i}", f"f{i - 1}") for i in range(1, 150)] + [("x", "x", "y"), ("y", "y", "x"), ("z", "z", "nowhere"), ("w", "w", "x"), ("r", "r", None), ("s", "s", "r")]
    got = {r.id: r.path for r in folders.folder_paths(spark.createDataFrame(rows, "id string, name string, parent_id string")).collect()}
    assert len(got) == len(rows) and all(got[f"f{i}"] == "".join(f"/n{k}" for k in range(i + 1)) for i in range(150))
    assert [got[k] for k in "xyzwrs"] == [None, None, None, None, "/r", "/r/s"]
    assert folders.folder_paths(spark.createDataFrame([], "id string, name string, parent_id string")).count() == 0


def test_digest_shows_the_first_names(spark):
    paths = spark.createDataFrame([("a", "/a"), ("b", "/a/b"), ("c", "/a/c")], "id string, path string")
    files = spark.createDataFrame([(f"{k}{i:03}", k, "processed", None) for k in "bc" for i in range(200)] + [("a0", "b", "failed", None)], "filename string, folder_id string, status string, deleted_at timestamp")
    got = {r.id: (r.file_count, r.files, r.depth) for r in folders.folder_digest(paths, files).collect()}
    five = lambda k: ",".join(f"{k}{i:03}" for i in range(5))
    assert got == {"a": (400, five("b"), 1), "b": (200, five("b"), 2), "c": (200, five("c"), 2)}


def test_budget_runs_across_ranges(spark):
    rows = [(k, i, (i * 7) % 5 if i % 11 else None) for k in ("a", "b", None) for i in range(300)] + [("c", 0, 9)]
    frame = spark.createDataFrame(rows, "key string, at int, tokens_used long").repartition(5)
    got = sorted((str(r.key), r["at"], r.spent_before) for r in ledger.run_until_budget(frame, "key", ["at"], 100).collect())
    want = []
    for key in ("a", "b", None, "c"):
        spent = 0
        for k, i, n in rows:
            if k == key:
                if spent < 100:
                    want.append((str(k), i, spent))
                spent += n or 0
    assert got == sorted(want)


def test_routes_have_no_limit(spark):
    routes = spark.createDataFrame([(i, f"model-{i}", f"p{i}") for i in range(12_000)] + [(20_000, "model-*", "any"), (5, "zz?", "q")], "priority int, glob string, provider string")
    asked = spark.createDataFrame([(1, None, "model-11999", None), (2, None, "model-x", None), (3, None, "zz1", None), (4, None, "other", None), (5, "sum", None, None), (6, None, None, None), (7, None, "m", "named")], "id int, purpose string, model string, provider string")
    got = {r.id: (r.model, r.provider, r.how) for r in ledger.resolve_routes(asked, spark.createDataFrame([("sum", "model-3")], "purpose string, model string"), routes, ["back"]).collect()}
    assert got == {1: ("model-11999", "p11999", "route"), 2: ("model-x", "any", "route"), 3: ("zz1", "q", "route"), 4: ("other", "back", "fallback"), 5: ("model-3", "p3", "route"), 6: (None, None, "unresolved"), 7: ("m", "named", "explicit")}


def test_needles_meet_only_texts_with_their_words(spark):
    import random

    pick = random.Random(4)
    alphabet = "ab \n-.th\u00e9"
    hays = [(i, i % 7, "".join(pick.choice(alphabet) for _ in range(60))) for i in range(120)]
    needles = [(i, "".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 7)))) for i in range(60)] + [(100, "..."), (101, "the"), (102, "- "), (103, hays[0][2][5:40])]
    got = search.containing(spark.createDataFrame(needles, "query_id long, needle string"), spark.createDataFrame(hays, "doc_id long, created_at long, hay string"))
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == sorted((q, d) for q, n in needles for d, _, h in hays if n in h)


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    v = np.random.default_rng(1).normal(size=(60, 5))
    v[3] = 0
    rows = spark.createDataFrame([(i, x.tolist(), i) for i, x in enumerate(v)] + [(99, None, 99)], "id long, embedding array<double>, created_at long")
    asked, corpus = rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "doc_id")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    scores = unit @ unit.T
    for before in (None, "created_at"):
        got = {}
        for r in search.semantic_search(asked, corpus, 4, before=before).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.doc_id
        want = {q: dict(enumerate(sorted((d for d in range(60) if d != 3 and (before is None or d < q)), key=lambda d, q=q: (-scores[q, d], d))[:4], 1)) for q in range(60) if q != 3}
        assert got == {q: w for q, w in want.items() if w}
    assert search.semantic_search(asked.limit(0), corpus, 4).count() == 0


def test_words_that_stand_together_score_higher(spark):
    docs = spark.createDataFrame([(1, "red one two three apple"), (2, "one two three red apple"), (3, "red red apple zzz"), (4, "red")], "doc_id long, body string").selectExpr("doc_id", "'' AS title", "'' AS summary", "body", "true AS is_current")
    hits = search.keyword_search(spark.createDataFrame([(1, "red apple"), (2, "red")], "query_id long, text string"), search.build_postings(docs), 5).collect()
    assert {r.doc_id: r.score for r in hits if r.query_id == 1} == {1: 0.5, 2: 0.8, 3: 1.2} and {r.doc_id: r.score for r in hits if r.query_id == 2} == {1: 0.2, 2: 0.2, 3: 0.4, 4: 0.2}


def test_counts_by_a_vocabulary(spark, tmp_path):
    import base64

    from millrace.functions.tokens import rank_counter

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    count = rank_counter(str(tmp_path / "ranks"), r"\S+|\s+")
    rows = spark.createDataFrame([("abc ab c",), ("",), (None,), ("\u00e9",)], "t string")
    assert [r.n for r in rows.select(count(F.col("t")).alias("n")).collect()] == [5, 0, 0, 2]
