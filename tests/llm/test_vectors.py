"""Vector operators against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from corpusloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"
ODD = [(900, None, 1, ""), (901, [], 1, ""), (902, [0.0] * 8, 1, ""), (903, [float("nan")] * 8, 1, ""), (904, [None] * 8, 1, ""), (905, [float("inf")] + [0.0] * 7, 1, ""), (906, [1.0] * 8, None, ""), (907, [1.0] * 3, 1, "")]


def data(n=160, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.3, 2.0])).astype(np.float32).tolist(), i % 2, "") for i in range(n)]
    return rows + [(n, rows[0][1], 0, ""), (n + 2, rows[0][1], 0, "")]


@pytest.mark.parametrize("tile", [16, 2048])
def test_dedup(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = data()
    got = {r["vec_id"]: r for r in vectors.embedding_dedup(spark.createDataFrame(rows + ODD, SCHEMA)).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.array([r[0] for r in rows])
    for _ in rows:
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(rows))])
    assert link.any()
    assert all(got[r[0]]["n_links"] == link[i].sum() and got[r[0]]["component_id"] == comp[i] for i, r in enumerate(rows))
    assert all(got[r[0]]["n_links"] == 0 and got[r[0]]["component_id"] == r[0] and got[r[0]]["kept"] for r in ODD)


def test_dedup_edges(spark):
    assert vectors.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, "")]
    got = sorted((str(r[0]), r[1], r[2]) for r in vectors.embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("3", 2, 1), ("None", 0, None)]


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 40)), rng.normal(size=(60, 40)) * rng.choice([1e-3, 1.0], size=(60, 40))
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    qa, qb = vectors.Quantised(ua), vectors.Quantised(ub)
    near = (qa.code.astype(float) * qa.scale[:, None]) @ (qb.code.astype(float) * qb.scale[:, None]).T
    bound = qa.norm[:, None] * qb.error[None, :] + qa.error[:, None] * (qb.norm + qb.error)[None, :]
    assert (np.abs(near - ua @ ub.T) <= bound + 1e-12).all()


@pytest.mark.parametrize("sizes", [(3, 16), (2048, 8192)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "QUERIES", sizes[0])
    monkeypatch.setattr(vectors, "CANDIDATES", sizes[1])
    rows = data(200)
    odd = [r for r in ODD if r[0] not in (906,)]
    got = sorted(tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(rows + odd, SCHEMA), block=3).select("query_id", "rank", "vec_id", "score").collect())
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)).astype(int)
    ids = np.array([r[0] for r in rows])
    want = []
    for i, q in zip(ids, x, strict=True):
        if i % 50 == 0:
            s = x @ q
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
            want += [(i, n, ids[j], s[j]) for n, j in enumerate(best, 1)]
    got = [g for g in got if g[0] <= 202]
    assert got == sorted(want)


def test_top_k_edges(spark):
    assert vectors.exact_top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1e30, 1.0], 1, ""), (1, [-1e30, 2.0], 1, ""), (2, [0.5, 0.5], 1, "")]
    got = [tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").select("vec_id", "score").collect()]
    assert [g[0] for g in got] == [2, 1] and got[1][1] == -(2**63)  # fewer than five candidates; scores beyond a long are its ends
    huge = [(0, [1e307, 1.0], 1, ""), (1, [-1e307, 2.0], 1, ""), (2, [1e307, 0.5], 1, ""), (3, [0.5, 0.5], 1, "")]
    got = [tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(huge, SCHEMA.replace("float", "double"))).orderBy("rank").select("vec_id", "score").collect()]
    assert got[0] == (2, 2**63 - 1) and got[1][0] == 3 and got[2] == (1, -(2**63))
    many = [(50, [1.0, float(i)], 1, "") for i in range(30)]  # one id in all rows has no other candidates
    assert vectors.exact_top_k(spark.createDataFrame(many, SCHEMA)).count() == 0


def test_dedup_extreme_magnitudes(spark):
    rows = [(i, [x, x], 1, "") for i, x in enumerate((1e200, 1e200, 1e-200, 1e-200, 5e-324))] + [(9, [1e200, -1e200], 1, "")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.embedding_dedup(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 9: (0, 9)}


@pytest.mark.parametrize("tile", [4, 2048])
def test_dedup_repeated_ids(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BYTES", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2, 4))
    rows = [(int(rng.integers(0, 12)), (base[i % 2] + 0.3 * rng.integers(-1, 2, 4)).tolist(), str(i % 3 and 1), "") for i in range(60)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links string")).collect()}
    want = {r[0]: 0 for r in rows}
    for i, x, a, _ in rows:
        for j, y, b, _ in rows:
            want[i] += i != j and a == b and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    assert got == want and max(want.values())


def test_bounds_prune():
    """Under half of the candidates enter the last block, on vectors of no structure."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    columns, ids, last = np.ascontiguousarray(x.T), np.arange(2000), []
    for i in range(0, 2000, 50):
        entered = []
        got, s = vectors.top_block(ids, i, x[i], 5, columns, (x**2).sum(axis=1), 8, entered)
        full = x @ x[i]
        full[i] = -np.inf
        assert s.tolist() == sorted(full, reverse=True)[:5]
        last.append(entered[-1] / entered[0])
    assert np.mean(last) < 0.05
