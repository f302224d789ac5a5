"""Walks that vertices with the same neighbours share, against plain forms."""

import random
from collections import defaultdict

import pytest

from millrace.operators import graph


def _hops(near, start):
    found, level, hop = {start: 0}, [start], 0
    while level:
        hop += 1
        level = sorted({b for a in level for b in near[a]} - found.keys())
        found |= dict.fromkeys(level, hop)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_twins_have_the_walks_of_each_alone(spark, seed):
    pick = random.Random(seed)
    hubs = [f"h{i}" for i in range(4)]
    edges = {(f"t{i}", h) for i in range(12) for h in hubs[: 2 + i % 2]} | {tuple(pick.sample([f"v{i}" for i in range(14)] + hubs, 2)) for _ in range(16)} | {("v1", "v1")}
    weight = {e: pick.randrange(1, 9) for e in sorted(edges)}
    table = spark.createDataFrame([(a, b, "R", w) for (a, b), w in weight.items()], "src string, dst string, rel string, weight long")
    near, heavy = defaultdict(set), {}
    for (a, b), w in weight.items():
        if a != b:
            for x, y in ((a, b), (b, a)):
                near[x].add(y)
                heavy[x, y] = max(w, heavy.get((x, y), 0))
    names = sorted(near) + ["alone"]
    seeds = spark.createDataFrame([(n,) for n in names], "seed string")
    for depth in (1, 2, 3, 5):
        got = sorted((r.seed, r.node, r.hop) for r in graph.neighbors(table, seeds, depth).collect())
        assert got == sorted((n, m, h) for n in names for m, h in _hops(near, n).items() if 0 < h <= depth)
    wanted = spark.createDataFrame([(a, b) for a in names for b in names], "src string, dst string")
    for most in (1, 3, 4):
        want = {}
        for a in names:
            paths, level = {a: (a,)}, [a]
            for _ in range(most):
                new = {}
                for x in level:
                    for y in near[x] - paths.keys():
                        new[y] = min(new.get(y, (chr(0x10FFFF),)), (*paths[x], y))
                paths |= new
                level = list(new)
            want |= {(a, b): (" > ".join(p), len(p) - 1, sum(heavy[x, y] for x, y in zip(p, p[1:]))) for b, p in paths.items()}
        got = graph.shortest_path(table, wanted, most).collect()
        assert len(got) == len(want) and {(r.src, r.dst): (r.path, r.hops, r.total_weight) for r in got} == want


def test_equal_neighbours_are_one_walk(spark):
    """The frontier of many seeds with the same neighbours is as long as that of one."""
    pairs = spark.createDataFrame([(a, b) for i in range(30) for a, b in ((f"s{i:02}", "h"), ("h", f"s{i:02}"), (f"s{i:02}", "g"), ("g", f"s{i:02}"))] + [("x", "h"), ("h", "x")], "a string, b string")
    got = {r["end"]: r["class"] for r in graph._twins(pairs, pairs.selectExpr("a AS end")).collect()}
    assert got == {f"s{i:02}": "s00" for i in range(30)} | {"x": "x", "h": "h", "g": "g"}
