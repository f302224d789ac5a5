"""Walks between all of two sets, and the graph they need, against the forms that list pairs and keep more."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import network
from millrace.plans import testbed as t


@pytest.mark.parametrize("seed", range(2))
def test_paths_between_equal_those_of_listed_pairs(spark, seed):
    pick = random.Random(seed)
    hubs = [f"h{i}" for i in range(4)]
    edges = {(f"t{i:02}", h) for i in range(12) for h in hubs[: 2 + i % 2]} | {tuple(pick.sample([f"v{i}" for i in range(14)] + hubs, 2)) for _ in range(16)} | {("v1", "v1"), ("y", "z")}
    table = spark.createDataFrame([(a, b, "R", pick.randrange(1, 9)) for a, b in sorted(edges)], "src string, dst string, rel string, weight long")
    mentions = spark.createDataFrame([("t00", 1), ("y", 1), ("v2", 2)], "canonical string, doc_id long")
    names = sorted({x for e in edges for x in e}) + ["alone"]
    sources, targets = (spark.createDataFrame([(n,) for n in names if pick.random() < 0.8], f"{c} string") for c in ("src", "dst"))
    for most, said in ((0, None), (1, None), (2, None), (4, None), (4, mentions)):
        want = graph.shortest_path(table, sources.crossJoin(targets), most, said).collect()
        got = graph.paths_between(table, sources, targets, most, said).collect()
        assert len(want) > 10 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_twins_are_one_pair_of_classes(spark, monkeypatch):
    """60 x 60 pairs of vertices with the same neighbours walk as one: no table of the pairs is made on the way."""
    sizes = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, **o: sizes.append((out := keep(df, name, **o)).count()) or out)
    edges = spark.createDataFrame([(f"{s}{i:02}", h, "R", i) for s in "ab" for i in range(60) for h in ("g", "h")], "src string, dst string, rel string, weight long")
    ends = [edges.filter(F.startswith("src", F.lit(s))).select(F.col("src").alias(c)).distinct() for s, c in (("a", "src"), ("b", "dst"))]
    rows = graph.paths_between(edges, *ends).collect()
    assert len(rows) == 3600 and {r.path for r in rows} == {f"a{i:02} > g > b{k:02}" for i in range(60) for k in range(60)}
    assert all(r.total_weight == int(r.src[1:]) + int(r.dst[1:]) for r in rows) and max(sizes) == 480


def test_walked_graph(spark, small):
    vertices = graph.build_vertices(t.mentions(spark, small))
    names, edges = network._walked(spark, small)
    assert sorted(r.canonical for r in names.collect()) == sorted(r.canonical for r in vertices.collect())
    whole = graph.build_edges(t.relations(spark, small), vertices).select(*edges.columns)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, whole.collect()))


def test_names_without_a_key_are_no_vertices(spark):
    mentions = spark.createDataFrame([(1, 1, n, None, None) for n in ("The  Acme, Inc.", "acme", None, " ", "The ", "Ltd.")], "doc_id long, position int, name string, type string, created_at timestamp")
    assert sorted(r.canonical for r in graph.entity_names(mentions).collect()) == sorted(r.canonical for r in graph.build_vertices(mentions).collect())
