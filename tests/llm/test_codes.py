"""Vector codes against brute force in Python integers."""

import math
import random

import numpy as np
import pytest

from corpuslens.llm import codes as C
from corpuslens.llm.common import Scratch


def brute(rows, parts=8, entries=16, rounds=6):
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in rows]
    width = min(set(sizes), key=lambda w: (-sizes.count(w), w))
    rows = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if len(v) == width]
    cut = [p * width // parts for p in range(parts + 1)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][a:b] for r in rows[:entries]] for a, b in zip(cut, cut[1:])]
    d2 = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, book: min((d2(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [[] for _ in book]
            for _, v, _ in rows:
                x = v[cut[p]:cut[p + 1]]
                mine[near(x, book)[1]].append(x)
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(mine, book)]
    out = []
    for i, v, lab in rows:
        found = [near(v[cut[p]:cut[p + 1]], book) for p, book in enumerate(books)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab])
    of = {}
    for _, _, e, lab in out:
        of[lab] = of.get(lab, 0) + e
    return sorted(((i, c, e, of[lab]) for i, c, e, lab in out), key=str), books


def vectors(n, width, seed, grid=None):
    rng = random.Random(seed)
    one = lambda: rng.choice(grid) if grid else rng.gauss(0, 0.3)
    return [(rng.randrange(10_000) if k % 9 else None, [np.float32(one()).item() for _ in range(width)], rng.choice([1, 2, 3, None])) for k in range(n)]


def check(spark, rows, **kw):
    d = spark.createDataFrame([(9, i, v, lab, "x") for i, v, lab in rows], "part int, vec_id long, embedding array<float>, label int, codes string").repartition(3)
    out, books = C.compress(d, Scratch(spark, "t"), **kw)
    got = sorted(((r.vec_id, r.codes.hex(), r.error, r.label_error) for r in out.collect()), key=str)
    want, wanted = brute(rows, **kw)
    assert [b.tolist() for b in books] == wanted
    assert got == want


def test_compress(spark):
    rows = vectors(300, 16, 1)
    rows += [rows[3]] * 150 + [(1, None, 1), (0, [None] * 16, 1), (2, [float("nan")] * 16, 2), (3, [float("inf")] + [0.0] * 15, 2), (4, [0.5] * 8, 1), (5, [], 1)]
    check(spark, rows)


@pytest.mark.parametrize("n,width,kw", [(200, 19, {}), (5, 8, {}), (120, 12, {"parts": 3, "entries": 4, "rounds": 2}), (60, 5, {"rounds": 1})])
def test_shapes(spark, n, width, kw):
    """Lengths that the parts do not divide, fewer vectors than entries, values on a grid with many ties."""
    check(spark, vectors(n, width, n, grid=[-0.5, -0.25, 0.0, 0.25]), **kw)


def test_empty(spark):
    d = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for x in (d, d.limit(0)):
        out, _ = C.compress(x, Scratch(spark, "t"))
        assert out.count() == 0 and out.columns == ["vec_id", "label", "codes", "error", "label_error"]


@pytest.mark.parametrize("bundle", [1, 7, 4096])
def test_walk(monkeypatch, bundle):
    """Every leaf once, in order, whatever the bundles."""
    monkeypatch.setattr(C, "BUNDLE", bundle)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 3, (500, 4))
    x = x[np.lexsort(x.T[::-1])]
    book = rng.integers(-3, 3, (6, 4))
    first, entry, dist = C.nearest(x, book)
    leaves, at = np.unique(x, axis=0, return_index=True)
    assert first.tolist() == at.tolist()
    full = ((leaves[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert entry.tolist() == full.argmin(axis=1).tolist() and dist.tolist() == full.min(axis=1).tolist()
