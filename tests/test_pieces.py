"""Tiles are worked off in pieces: no distance matrix of a tile, no sort of its rows, the same neighbours."""

import numpy as np
import pytest

from corpuslens.functions import tiles
from corpuslens.operators import complexity as cx
from corpuslens.operators import vectors as vec


def block(rng, n, lo):
    v = np.round(rng.normal(size=(n, 3)), 1)
    v[n // 2:] = v[: n - n // 2]  # copies: equal distances go by place
    return tiles.Block(np.arange(lo, lo + n), rng.integers(0, 3, n), v, {"fold": rng.integers(0, 4, n)})


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
@pytest.mark.parametrize("apart", [None, "fold"])
def test_nearest_by_pieces(monkeypatch, metric, apart):
    monkeypatch.setattr(tiles, "PIECE", 7)
    rng = np.random.default_rng(1)
    a, b = block(rng, 40, 0), block(rng, 33, 100)
    b.v[5] = np.nan  # no neighbour of anyone
    for q, s, same in ((a, b, False), (b, a, False), (a, a, True)):
        d = tiles.METRICS[metric](q.v, s.v)
        d[(q.id[:, None] == s.id[None]) | (q.extra["fold"][:, None] == s.extra["fold"][None] if apart else False)] = np.nan
        want = tiles.smallest_k(d, 4)
        r, c, dist = tiles.nearest_k(q, s, 4, metric, same, apart)
        assert sorted(zip(r, c)) == sorted(zip(*want)) and np.allclose(dist, d[r, c], atol=1e-9)


def test_pieces_meet_each_pair_once_and_stay_small(monkeypatch):
    monkeypatch.setattr(tiles, "PIECE", 7)
    rng = np.random.default_rng(2)
    a, b = block(rng, 40, 0), block(rng, 33, 100)
    for s, same in ((b, False), (a, True)):
        squares, seen = tiles.Squares(a, s), np.zeros((len(a), len(s)), int)
        for i, j, both in tiles.pieces(a, s, same):
            d = squares(i, j)
            assert d.size <= 49 and np.array_equal(tiles.rounded_root(d), tiles.euclid(a.v[i], s.v[j]))
            seen[i, j] += 1
            if same and both:
                seen[j, i] += 1
        assert (seen == 1).all()


def test_a_bit_tile_times_a_vector():
    rng = np.random.default_rng(3)
    for ni, nj in ((5, 13), (300, 16), (1, 1)):
        m, v = rng.random((ni, nj)) < 0.4, rng.random(nj)
        raw = np.packbits(m, axis=1).tobytes()
        assert np.allclose(cx._times(raw, ni, nj, v), m @ v) and np.array_equal(cx._bits(raw, ni, nj), m)


def test_descriptors_by_pieces_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MIN_ROWS", 20)
    rng = np.random.default_rng(4)
    v, y = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    v[80:] = v[:10]
    p = spark.createDataFrame([("d", "s", i, int(y[i]), v[i].tolist()) for i in range(90)],
                              "dataset_id string, space string, doc_id long, label int, v array<double>")
    d = tiles.euclid(v, v)
    np.fill_diagonal(d, np.nan)
    alike = y[:, None] == y[None]
    for r in vec.distance_profile(p, "euclid").collect():
        x = np.delete(d[r.doc_id], r.doc_id)
        assert (r.n, r.nearest, r.farthest) == (89, x.min(), x.max()) and abs(r.mean - x.mean()) < 1e-9
    near = cx.nearest_by_class(p)
    other = np.nanmin(np.where(alike, np.nan, d), axis=1)
    assert {r.doc_id: r.other for r in near.collect()} == dict(enumerate(other))
    inside = (np.where(np.isnan(d), 0.0, d) < other[:, None]).sum()  # a row itself counts, if its enemy is apart
    assert abs(cx.lsc(p, near).first().cx_lsc - (1 - inside / 8100)) < 1e-12


def kruskal(v):
    i, j = np.triu_indices(len(v), 1)
    d = np.round(np.sqrt(((v[i] - v[j]) ** 2).sum(axis=1)), 10)
    root, tree = list(range(len(v))), set()
    for e in np.lexsort((j, i, d)):
        x, y = root[i[e]], root[j[e]]
        if d[e] > 0 and x != y:
            root = [x if r == y else r for r in root]
            tree.add((int(i[e]), int(j[e])))
    return tree


@pytest.mark.parametrize("one", [131_072, 6])
def test_spanning_tree_of_tiles(spark, monkeypatch, one):
    """Tiles are gone through once; rounds over edges and groups of edges give the same tree."""
    monkeypatch.setattr(tiles, "MIN_ROWS", 20)
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(70, 2)), 1)  # equal distances
    v[65:] = v[:5]  # no edge between copies
    p = spark.createDataFrame([("d", "s", i, i % 2, v[i].tolist()) for i in range(70)],
                              "dataset_id string, space string, doc_id long, label int, v array<double>")
    calls, run = [], cx.tile_run
    monkeypatch.setattr(cx, "tile_run", lambda *a, **k: calls.append(1) or run(*a, **k))
    rows = cx.spanning_tree(p, one=one).collect()
    assert {(r.a, r.b) for r in rows} == kruskal(v) and len(rows) == len(kruskal(v)) and len(calls) == 1
    assert all((r.label_a, r.label_b) == (r.a % 2, r.b % 2) for r in rows)


@pytest.mark.parametrize("dense", [1, 40, 10**9])
def test_products_of_rare_and_frequent_terms(monkeypatch, dense):
    """Each way of multiplying alone and both together; the dense product holds frequent terms only."""
    monkeypatch.setattr(vec, "DENSE", dense)
    monkeypatch.setattr(vec, "PRODUCTS", 5)
    monkeypatch.setattr(vec, "TERM_CHUNK", 3)
    rng = np.random.default_rng(8)
    a, b = (np.where(rng.random((n, 30)) < np.linspace(0.02, 0.9, 30), rng.random((n, 30)), 0.0) for n in (11, 9))
    b[4] = 0.0
    trip = [(i, j * 7, m[i, j]) for m in (a, b) for i, j in [np.nonzero(m)]]
    assert np.allclose(vec.sparse_similarity(*trip[0], *trip[1], 11, 9), a @ b.T)


def test_a_pair_of_sparse_blocks_is_multiplied_once(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MIN_ROWS", 10)
    rng = np.random.default_rng(9)
    w = np.where(rng.random((40, 12)) < 0.3, rng.random((40, 12)), 0.0)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    docs = spark.createDataFrame([("d", i, str(i % 3)) for i in range(40)], "dataset_id string, doc_id long, label string")
    rows = spark.createDataFrame([("d", int(i), str(i % 3), f"t{j}", float(w[i, j])) for i, j in zip(*np.nonzero(w))],
                                 "dataset_id string, doc_id long, label string, term string, w double").drop("label")
    d = np.round(1 - w @ w.T, 10)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in vec.knn_sparse(rows, docs, 3).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.nbr
    assert got == {i: dict(enumerate(np.lexsort((np.arange(40), d[i]))[:3].tolist(), 1)) for i in range(40)}
