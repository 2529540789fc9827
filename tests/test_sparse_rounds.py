"""Sparse neighbours dealt in several rounds and slices are those of one brute-force pass, and shuffle files do not pile up."""

import math
import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuslens.functions import tiles
from corpuslens.operators import vectors as vec


def brute(texts, k):
    n = len(texts)
    tf = [Counter(t.split()) for t in texts]
    df = Counter(w for c in tf for w in c)
    words = [w for w in df if df[w] >= 2]
    x = np.array([[(1 + math.log(c[w])) * (math.log((1 + n) / (1 + df[w])) + 1) if c[w] else 0.0 for w in words] for c in tf])
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x / np.where(length > 0, length, 1)
    d = np.round(1 - x @ x.T, 10) + 0.0
    return {(i, p + 1): j for i in range(n) for p, j in enumerate(sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k])}


def test_rounds_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = {key: [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(n)] for key, n in (("a", 90), ("b", 7))}
    docs = spark.createDataFrame([(key, i, t, str(i % 3)) for key, v in texts.items() for i, t in enumerate(v)],
                                 "dataset_id string, doc_id long, text string, label string")
    monkeypatch.setattr(tiles, "MIN_ROWS", 8)
    for name, value in (("SPARSE_ROWS", 32), ("PAIR_ROWS", 5), ("ROUND_ROWS", 200), ("SLICE_ROWS", 40)):
        monkeypatch.setattr(vec, name, value)
    rounds = []
    monkeypatch.setattr(vec, "dropped", lambda df, f=vec.dropped: (rounds.append(1), f(df)))
    w = vec.tfidf(docs, numbered=True)
    got = {key: {} for key in texts}
    for r in vec.knn_sparse(w, docs, 4).collect():
        got[r.dataset_id][(r.doc_id, r.pos)] = r.nbr
    assert len(rounds) >= 2
    for key, v in texts.items():
        want = brute(v, 4)
        assert {at: (got[key].get(at), x) for at, x in want.items() if got[key].get(at) != x} == {} and len(got[key]) == len(want)
    # without numbers of terms, and with the written terms dropped afterwards
    again = vec.knn_sparse(vec.tfidf(docs), docs, 4, last=True)
    assert {(r.dataset_id, r.doc_id, r.pos): r.nbr for r in again.collect()} == {(key, *at): x for key, v in got.items() for at, x in v.items()}


def test_numbers_of_terms(spark):
    docs = spark.createDataFrame([("a", 1, "xx yy zz", "p"), ("a", 2, "xx yy", "q"), ("b", 1, "xx xx", "p"), ("b", 3, "xx", "p")],
                                 "dataset_id string, doc_id long, text string, label string")
    got = vec.tfidf(docs, numbered=True).groupBy("dataset_id").agg(F.array_sort(F.collect_set(F.struct("term", "tid"))).alias("x")).collect()
    assert {r.dataset_id: ({t.term for t in r.x}, sorted(t.tid for t in r.x)) for r in got} == {"a": ({"xx", "yy"}, [1, 2]), "b": ({"xx"}, [1])}


def test_a_block_of_one_row():
    """A row that only meets itself has no neighbours."""
    a = tiles.Block(np.array([7]), np.array(["x"]), np.ones((1, 3)), {})
    assert [len(x) for x in tiles.nearest_k(a, a, 1, "cosine", True)] == [0, 0, 0]


def test_stored_leaves_no_shuffle_files(spark):
    from corpuslens.session import CLEANUP, dropped, stored

    before = spark.conf.get(CLEANUP, None)
    t = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert t.count() == 7 and spark.conf.get(CLEANUP, None) == before
    folder = t._stored.toUri().getPath()
    assert os.path.isdir(folder)
    dropped(t)
    assert not os.path.exists(folder)
