"""Sums over trailing windows against a plain form."""

import random
from collections import defaultdict

from millrace.operators import ledger


def test_token_budget_adds_up_no_window_twice(spark):
    pick = random.Random(5)
    rows = [(pick.choice(["a", "b", None]), pick.choice([None, *range(0, 300_000, 1777), 3599, 3600, 86399, 86400, -5]), pick.choice([None, 1, 7, 1000])) for _ in range(700)] + [("n", 5, None), ("n", 90_000, 3), ("n", 180_000, None)]
    table = spark.createDataFrame(rows, "service string, at long, used long").selectExpr("service", "timestamp_seconds(at) AS created_at", "used")
    sums = defaultdict(list)
    for k, at, used in rows:
        sums[k, at] += [] if used is None else [used]
    total = lambda parts: sum(x for p in parts for x in p) if any(parts) else None
    want = []
    for (k, at), used in sums.items():
        there = [[v for (q, s), v in sums.items() if q == k and (s is None if at is None else s is not None and at - width < s <= at)] for width in (3600, 86400)]
        hour, day = map(total, there)
        want.append((k, at, total([used]), hour, day, None if day is None else day < 5000))
    got = ledger.token_budget(table, "service", 5000, tokens="used")
    assert got.columns == ["service", "second", "tokens", "last_hour", "last_day", "under_limit"]
    assert sorted(map(str, ((r.service, r.second, r.tokens, r.last_hour, r.last_day, r.under_limit) for r in got.collect()))) == sorted(map(str, want))
    assert "RangeFrame, -86399" not in got._jdf.queryExecution().toString()
