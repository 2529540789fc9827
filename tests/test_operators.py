"""Operators on small fixtures against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import analysis as an
from corpuslens.operators import complexity as cx
from corpuslens.operators import forest as fo
from corpuslens.operators import landmark as lm
from corpuslens.operators import prep
from corpuslens.operators import protocol as pr
from corpuslens.operators import rank as rk
from corpuslens.operators import text as tx
from corpuslens.operators import vectors as vec


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)) + np.repeat(np.eye(3, 6) * 2, 20, axis=0)
    v[1] = v[0]  # a zero-distance pair
    y = np.repeat([0, 1, 2], 20)
    rows = [("d", "s", i, int(y[i]), [float(x) for x in v[i]]) for i in range(60)]
    return v, y, spark.createDataFrame(
        rows, "dataset_id string, space string, doc_id long, label int, v array<double>").persist()


def distances(v):
    return np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 10)


def test_clean_and_gate(spark):
    d = spark.createDataFrame(
        [("d", 0, " a ", "x"), ("d", 1, "a", "y"), ("d", 2, "NaN", "x"), ("d", 3, " ", "x"), ("d", 4, None, "x"),
         ("d", 5, "b", None), ("d", 6, "c", "x")], "dataset_id string, doc_id long, text string, label string")
    got = sorted((r.doc_id, r.text, r.label) for r in prep.clean_text_label(d).collect())
    assert got == [(0, "a", "x"), (6, "c", "x")]
    counts = prep.class_counts(prep.clean_ids(d))
    g = prep.gate(counts, prep.plan_rare(counts, 1), 1, 1, 0.1).first()
    assert not g.kept and g.reason == "fewer than two classes"


def test_floor_and_cap_quotas(spark):
    plan = spark.createDataFrame([("d", "a", 900, 900, 0), ("d", "b", 50, 50, 1), ("d", "c", 50, 50, 2)],
                                 "dataset_id string, label string, cnt long, orig long, first_seen long")
    q = {r.label: r.cnt for r in prep.plan_floor(plan, 0.1).collect()}
    # the smallest class allows 450 others: 450/950 of 900 and of 50
    assert q == {"a": 426, "b": 50, "c": 24}
    c = {r.label: r.cnt for r in prep.plan_cap(plan, 333).collect()}
    assert sum(c.values()) == 333 and c["a"] == 300


def test_pca_matches_numpy(cloud):
    v, _, p = cloud
    z = (v - v.mean(0)) / v.std(0)
    val = np.linalg.eigvalsh(np.cov(z.T, bias=True))[::-1]
    ax = cx.principal_axes(p).first()
    assert np.allclose(ax.variances, val / val.sum())
    got = {r.doc_id: r.v for r in cx.pca_space(p).collect()}
    w = np.array([got[i] for i in range(60)])
    assert np.allclose(distances(w), distances(z), atol=1e-8)


def test_graph_measures(cloud):
    v, y, p = cloud
    d = distances(v)
    iu = np.triu_indices(60, 1)
    eps = np.quantile(d[iu], 0.15)
    e = cx.distance_quantile(p)
    assert abs(e.first().eps - eps) < 1e-9
    a = ((d <= round(eps, 10)) & (y[:, None] == y[None]) & ~np.eye(60, dtype=bool)).astype(float)
    blocks, tiles = cx.graph_tiles(p, e)
    assert abs(cx.density(p, tiles).first().cx_density - (1 - a.sum() / (60 * 59))) < 1e-9
    deg, tri = a.sum(1), np.diag(a @ a @ a)
    cc = np.where(deg >= 2, tri / np.where(deg >= 2, deg * (deg - 1), 1), 0)
    assert abs(cx.clustering(p, tiles).first().cx_clscoef - (1 - cc.mean())) < 1e-9
    val, vecs = np.linalg.eigh(a)
    h = np.abs(vecs[:, -1])
    assert abs(cx.hubs(p, blocks, tiles).first().cx_hubs - (1 - (h / h.max()).mean())) < 1e-4


def test_spanning_tree(cloud):
    v, y, p = cloud
    d = np.where(distances(v) > 0, distances(v), np.inf)
    seen, cost, cross = {0}, 0.0, set()
    while len(seen) < 60:
        s = sorted(seen)
        o = [j for j in range(60) if j not in seen]
        i, j = divmod(int(d[np.ix_(s, o)].argmin()), len(o))
        cost += d[s[i], o[j]]
        if y[s[i]] != y[o[j]]:
            cross |= {s[i], o[j]}
        seen.add(o[j])
    tree = cx.spanning_tree(p).collect()
    assert len(tree) == 59 and abs(sum(r.dist for r in tree) - cost) < 1e-6
    assert len({i for r in tree if r.label_a != r.label_b for i in (r.a, r.b)}) == len(cross)


def test_tiles_agree_with_brute_force(cloud, monkeypatch):
    """Several blocks give what one block gives."""
    from corpuslens.functions import tiles
    v, _, p = cloud
    monkeypatch.setattr(tiles, "MIN_ROWS", 8)
    got = {}
    for r in vec.knn(p, 3, "euclid").collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.nbr
    d = distances(v) + np.diag([np.inf] * 60)
    for i in range(60):
        assert [got[i][k] for k in (1, 2, 3)] == list(np.lexsort((np.arange(60), d[i]))[:3])


def test_singleton_class_n2_and_no_lexicon(spark):
    p = spark.createDataFrame([("d", "s", 0, 0, [0.0]), ("d", "s", 1, 1, [1.0]), ("d", "s", 2, 1, [3.0])],
                              "dataset_id string, space string, doc_id long, label int, v array<double>")
    # nearest same: 0 (none), 2, 2; nearest other: 1, 1, 3
    r = 4.0 / 5.0
    assert abs(cx.n2(cx.nearest_by_class(p)).first().cx_n2 - r / (1 + r)) < 1e-12
    docs = spark.createDataFrame([("d", 0, "a b", "x", 0)], "dataset_id string, doc_id long, text string, language string, label int")
    lex = spark.createDataFrame([("en", "a", 1, "c")], "language string, lemma string, n_words int, category string")
    r = tx.lexicon_rates(docs, lex).first()
    assert (r.hl_doc_rate, r.hl_token_rate, r.hl_class_gap, r.hl_category_entropy) == (0, 0, 0, 0)


def test_short_curve_has_no_slope(spark):
    c = spark.createDataFrame([("d", 25, 0.5)], "dataset_id string, size int, f1 double")
    assert lm.curve_slope(c, "s").first().s == 0.0


def test_tied_scores_keep_column_order(spark):
    s = spark.createDataFrame([("d", "b", 1, 2.0), ("d", "a", 2, 2.0), ("d", "c", 3, 1.0)],
                              "dataset_id string, algorithm string, alg_ord int, score double")
    assert [r.algorithm for r in rk.recommended_order(s).orderBy("pos").collect()] == ["c", "b", "a"]


def test_linkage_against_greedy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 12)) @ rng.normal(size=(12, 12))
    rho = np.abs(np.corrcoef(x.T))
    f = [f"f{i:02d}" for i in range(12)]
    m = spark.createDataFrame([(f[i], f[j], float(rho[i, j])) for i in range(12) for j in range(i + 1, 12)],
                              "f string, g string, rho double")
    for at in (0.4, 0.7):
        groups = [[i] for i in range(12)]
        while len(groups) > 1:
            d, a, b = min((np.mean([1 - rho[i, j] for i in g for j in h]), n, o)
                          for n, g in enumerate(groups) for o, h in enumerate(groups) if n < o)
            if d > at:
                break
            groups[a] += groups.pop(b)
        got = {}
        for r in an.linkage_clusters(m, spark.createDataFrame([(n,) for n in f], "feature string"), at).collect():
            got.setdefault(r.cluster_id, set()).add(r.feature)
        assert sorted(map(sorted, got.values())) == sorted(sorted(f[i] for i in g) for g in groups)


def test_near_duplicates_are_dropped_in_order(spark):
    sel = spark.createDataFrame([(1, "a", "base", True, "r"), (2, "b", "new", True, "r"), (3, "c", "new", True, "r")],
                                "cluster_id int, feature string, origin string, kept boolean, reason string")
    m = spark.createDataFrame([("a", "b", 0.99), ("a", "c", 0.1), ("b", "c", -0.99)], "f string, g string, rho double")
    got = {r.feature: (r.kept, r.reason) for r in an.drop_near_duplicates(sel, m).collect()}
    # c nearly equals b, but b is gone by then
    assert got["a"][0] and not got["b"][0] and got["c"][0] and got["b"][1].endswith("_of_a")


@pytest.fixture(scope="module")
def meta(spark):
    rng = np.random.default_rng(1)
    ids = [f"d{i}" for i in range(8)]
    x = [(i, f"f{j}", float(rng.normal())) for i in ids for j in range(3)]
    p = [(i, a, n + 1, float(rng.random())) for i in ids for n, a in enumerate("abc")]
    X = spark.createDataFrame(x, "dataset_id string, feature string, value double").persist()
    P = spark.createDataFrame(p, "dataset_id string, algorithm string, alg_ord int, value double").persist()
    g = pr.self_groups(P)
    return X, P, rk.ranks(P).persist(), pr.training_pairs(g).persist()


def grown(meta, lam, perf=None, ranked=None, trees=2):
    X, P, R, train = meta
    cfg = {"t": dict(kind="hybrid", lam=lam)}
    s = fo.recommend(X, perf or P, ranked or R, train, cfg, trees)
    return {(r.dataset_id, r.algorithm): r.score for r in s.collect()}


def test_forest_same_seed_is_identical(meta):
    a = grown(meta, 0.5)
    assert a == grown(meta, 0.5) and len(a) == 24


def test_forest_lambda_one_ignores_scores(meta):
    """With lambda 1 the splits, and so the predicted ranks, depend on ranks alone."""
    X, P, R, train = meta
    changed = R.withColumn("value", F.col("value") * F.col("alg_ord") + 5)
    assert grown(meta, 1.0) == grown(meta, 1.0, ranked=changed)


def test_leave_out_by_subtraction(meta):
    _, _, R, train = meta
    g = pr.self_groups(R)
    got = {(r.dataset_id, r.algorithm): r.score for r in rk.average_rank(R, g).collect()}
    rows = R.collect()
    for h in {r.dataset_id for r in rows}:
        mean = {a: np.mean([r["rank"] for r in rows if r.algorithm == a and r.dataset_id != h]) for a in "abc"}
        for a in "abc":
            less = sum(m < mean[a] for m in mean.values())
            same = sum(m == mean[a] for m in mean.values())
            assert got[(h, a)] == less + (same + 1) / 2
    leak = pr.leakage(train, g).collect()
    assert all(r.own_rows == 0 and r.group_rows == 0 and r.n_train == 7 for r in leak)
