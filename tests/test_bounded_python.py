"""What Python workers hold: pieces of a batch, not all that comes of it."""

import pandas as pd
import pytest

from millrace.operators import nearest
from millrace.sources import extract as X


class _Shared:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("timed", [False, True])
def test_a_scan_holds_a_bounded_number_of_candidates(monkeypatch, timed):
    import numpy as np

    pick = np.random.default_rng(1)
    v = pick.normal(size=(3000, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    batch = pd.DataFrame({"id": range(3000), "v": list(v), "t": np.arange(3000.0), "cell": np.arange(3000) % 300})
    ids, queries, times, most, cut = list(range(40)), v[:40], np.arange(40.0) * 50, [], nearest._cut
    monkeypatch.setattr(nearest, "_cut", lambda rows, k: (most.append(len(rows)), cut(rows, k))[1])
    got = pd.concat(nearest._scan(iter([batch]), _Shared((ids, queries, times, np.ones((40, 300), bool))), 5, timed))
    assert max(most) <= 5 * 5 * 40
    for q in ids:
        scores = queries[q] @ v.T
        rows = [i for i in range(3000) if not timed or i < times[q]]
        want = sorted(rows, key=lambda i: (-scores[i], i))[:5]
        assert got[got.q == q].id.tolist() == want


def test_files_are_cut_in_slices(spark):
    """No more blocks at a time than those of a slice of files, nulls and unknown files among them."""
    text = "# Head\n\npara one\n\n" + "x" * 400_000
    rows = [(i, None if i == 3 else text, "a.bin" if i == 4 else "a.md", None) for i in range(12)]
    files = spark.createDataFrame(rows, "file_id long, content string, filename string, content_type string").coalesce(1)
    got = {r.file_id: r.blocks for r in X.extract(files).collect()}
    assert got[3] is None and got[4] is None and len(got) == 12
    assert [(b.content[:8], b.block_type, b.position, b.metadata) for b in got[11]] == [("Head", "heading", 0, {"level": "1", "section_start": "True"}), ("para one", "paragraph", 1, {}), ("x" * 8, "paragraph", 2, {})]
    plan = X.extract(files)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
