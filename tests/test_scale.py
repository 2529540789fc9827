"""What must not grow with folds, blocks or readers: copies of terms and of vectors, passes over pairs."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuslens.functions import tiles
from corpuslens.operators import complexity as cx
from corpuslens.operators import landmark as lm


def centroids(rows, cfg, assign, min_df):
    """Nearest centroid by the formulas; a document of several rows counts with each."""
    tf = {}
    for i, t in rows:
        tf.setdefault(i, Counter()).update(t.split())
    mine = [(i, y, r) for c, i, y, r in assign if c == cfg]
    train = [(i, y) for i, y, r in mine if r == "train"]
    df = Counter(w for i, _ in train for w in tf[i])
    idf = {w: math.log((1 + len(train)) / (1 + n)) + 1 for w, n in df.items() if n >= min_df}
    times = Counter(i for i, _, _ in mine)

    def weights(i):
        raw = {w: (1 + math.log(n)) * idf[w] for w, n in tf[i].items() if w in idf}
        size = math.sqrt(times[i] * sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}
    cent = {y: Counter() for _, y in train}
    for i, y in train:
        cent[y].update({w: x / sum(1 for _, z in train if z == y) for w, x in weights(i).items()})
    tests = Counter(i for i, _, r in mine if r == "test")
    out = []
    for i, y, r in mine:
        if r == "test":
            w = weights(i)
            d = {c: round(sum(x * x for x in m.values()) - 2 * tests[i] * sum(x * m[k] for k, x in w.items()), 10) for c, m in cent.items()}
            out.append((i, y, min((x, c) for c, x in d.items())[1]))
    return sorted(out)


def test_terms_are_stored_once_for_all_folds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(12)], 6)) + (" left" if i % 3 else " right right")) for i in range(40)]
    rows += [rows[7], rows[8], (90, "never seen")]
    label = {i: "a" if i % 3 else "b" for i, _ in rows}
    assign = [(str(c), i, label[i], "test" if k % 5 == c else "train") for c in range(5) for k, (i, _) in enumerate(rows)]
    docs = spark.createDataFrame([("d", i, t) for i, t in rows], "dataset_id string, doc_id long, text string")
    roles = spark.createDataFrame([("d", *a) for a in assign], "dataset_id string, cfg string, doc_id long, label string, role string")
    terms, sizes, keep = lm.corpus_terms(docs), [], lm.stored

    def stored(df):
        sizes.append(df.count())
        return keep(df)
    monkeypatch.setattr(lm, "stored", stored)
    got = lm.nc_tfidf(terms, roles).collect()
    for c in range(5):
        assert sorted((r.doc_id, r.label, r.pred) for r in got if r.cfg == str(c)) == centroids(rows, str(c), assign, 2)
    # the roles; documents, terms and norms do not come once per fold
    assert max(sizes[1:]) <= len({i for i, _ in rows}) and len(sizes) == 5


def test_a_corpus_has_few_blocks_and_tiles_their_own_tasks(spark):
    many = spark.range(100_000).select(F.lit("d").alias("dataset_id"), F.col("id").alias("doc_id"))
    assert tiles.with_blocks(many, ["dataset_id"]).first()["_nb"] <= 8  # a row is copied once per block
    some = spark.range(2100).select(F.lit("d").alias("dataset_id"), F.col("id").alias("doc_id"), F.lit(0).alias("label"),
                                    F.array(F.rand(1), F.rand(2)).alias("v"))

    def kernel(q, s, d):
        from pyspark import TaskContext
        assert d.size <= tiles.CELLS
        return {"part": [TaskContext.get().partitionId()], "pairs": [int((~np.isnan(d)).sum())]}
    got = tiles.tile_apply(some, ["dataset_id"], kernel, "part int, pairs long").collect()
    assert sum(r.pairs for r in got) == 2100 * 2099 and len({r.part for r in got}) > 16


def test_pairs_are_gone_through_once_per_reader(spark, monkeypatch):
    p = spark.createDataFrame([("d", "s", i, i % 2, [float(i), float(i * i % 7)]) for i in range(30)],
                              "dataset_id string, space string, doc_id long, label int, v array<double>")
    eps = cx.distance_quantile(p)
    v = np.array([[i, i * i % 7] for i in range(30)], float)
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 10)
    assert abs(eps.first()["eps"] - np.quantile(d[np.triu_indices(30, 1)], 0.15)) < 1e-9
    plan = cx.lsc(p, cx.nearest_by_class(p))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in eps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1  # the count inside the limits; the limits are there already
