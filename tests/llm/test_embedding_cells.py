"""Cells only where they leave products out; blocks in pieces, against all products."""

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import embedding


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_only_where_they_help():
    pick = np.random.default_rng(3)
    spread = _unit(pick.normal(size=(4000, 64)))
    assert len(embedding.useful_cells(spread, 40, 0.98, 60_000)) == 1
    near = _unit(np.repeat(_unit(pick.normal(size=(40, 64))), 100, axis=0) + pick.normal(size=(4000, 64)) * 0.01)
    assert len(embedding.useful_cells(near, 40, 0.98, 60_000)) == 40


@pytest.mark.parametrize("piece", [(7, 16), (64, 5), (1024, 4096)])
@pytest.mark.parametrize("two", [False, True])
def test_blocks_in_pieces(monkeypatch, piece, two):
    monkeypatch.setattr(embedding, "PIECE", piece)
    pick = np.random.default_rng(4)
    centre = pick.normal(size=(12, 16))
    v = (centre[pick.integers(0, 12, 150)] + pick.normal(size=(150, 16)) * 0.12).astype(np.float32)
    part, home, whole, copies, rep = pick.integers(0, 2, 150) * two, pick.random(150) < 0.7, pick.random(150) < 0.8, pick.integers(1, 4, 150), pick.permutation(1000)[:150]
    rows = pa.table({"p": [0] * 150, "q": [int(two)] * 150, "part": part, "at_home": home, "in_part": whole, "rep": rep, "copies": copies, "v": pa.array(v.tolist(), pa.list_(pa.float32()))})
    got = {r["rep"]: r for r in embedding._compare(rows, 0.98).to_pylist()}
    u = _unit(v.astype(float))
    link = (u @ u.T >= 0.98) & (home[:, None] | home) & (whole[:, None] | whole) & ((part[:, None] != part) if two else True)
    np.fill_diagonal(link, False)
    low = rep.copy()
    while ((new := np.minimum(low, np.where(link, low, 10**6).min(axis=1))) != low).any():
        low = new
    assert {r: (x["links"], x["root"]) for r, x in got.items()} == {rep[i]: ((link[i] * copies).sum(), low[i]) for i in range(150) if link[i].any()}


def test_vectors_in_all_directions_stay_in_their_label(spark, monkeypatch):
    """No cells; a label of 2,000 rows is two blocks of 1,024 rows at most."""
    monkeypatch.setattr(embedding, "BLOCK", 16)
    pick = np.random.default_rng(5)
    v = pick.normal(size=(2500, 16)).astype(np.float32)
    v[1250:1300] = v[:50] + 0.01
    label = np.arange(2500) % 1250 % 5 == 0
    data = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<float>, label int")
    u = _unit(v.astype(float))
    link = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in embedding.near_duplicates(data, cell_rows=40).collect()}
    assert link.sum() >= 80 and len(got) == 2500
    assert all((got[i].n_links, got[i].component_id) == (link[i].sum(), min(i, *np.nonzero(link[i])[0], i)) for i in range(2500))
