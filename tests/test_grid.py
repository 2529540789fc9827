"""The treatment grid: masks hold in every tree, selection sees the training set only."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import forest as fo
from corpuslens.operators import protocol as pr
from corpuslens.operators import rank as rk


@pytest.fixture(scope="module")
def world(spark):
    n = 9
    perf = [(f"c{i}", a, k + 1, float((i * (k + 3)) % 7 + 0.1 * k)) for i in range(n) for k, a in enumerate("pqr")]
    perf = spark.createDataFrame(perf, "dataset_id string, algorithm string, alg_ord int, value double").persist()
    x = [(f"c{i}", f"f{j}", float((i * (j + 2)) % 5) + (0.3 * i if j == 1 else 0)) for i in range(n) for j in range(4)]
    x = spark.createDataFrame(x, "dataset_id string, feature string, value double")
    grp = spark.createDataFrame([(f"c{i}", f"g{i // 2}") for i in range(n)], "dataset_id string, grp string")
    return x, perf, rk.ranks(perf).persist(), grp


def test_masks_hold(spark, world):
    x, perf, ranked, grp = world
    train = pr.training_pairs(grp)
    variants = spark.createDataFrame([("base", "f0"), ("base", "f1"), ("new", "f2"), ("sel", "f0"), ("sel", "f1"), ("sel", "f2"), ("sel", "f3")],
                                     "variant string, feature string")
    chosen = fo.selected_features(x, perf, ranked, train, k=2, trees=3)
    per = {(r.holdout_id, r.feature) for r in chosen.collect()}
    assert len(per) == 18
    masks = fo.feature_masks({"a|base": "base", "a|new": "new", "a|sel": "sel"}, variants, chosen, train)
    got = {(r.cfg, r.holdout_id, r.feature) for r in masks.collect()}
    assert {(h, f) for c, h, f in got if c == "a|sel"} == per and {f for c, _, f in got if c == "a|new"} == {"f2"}
    y, n_y = fo.hybrid_targets(perf, ranked, train, {"a|base": 0.5, "a|new": 0.5, "a|sel": 0.5})
    rows = fo.training_rows(y, 3)
    _, splits = fo.grow(x, y, n_y, rows, {c: 0 for c in ("a|base", "a|new", "a|sel")}, {c: 1 for c in ("a|base", "a|new", "a|sel")}, masks)
    used = {(r.cfg, r.holdout_id, r.feature) for r in splits.select("cfg", "holdout_id", "feature").distinct().collect()}
    assert used and used <= got


def test_selection_ignores_the_holdout(spark, world):
    """What a hold-out's own rows say changes nothing in its selection."""
    x, perf, ranked, grp = world
    train = pr.training_pairs(grp)
    other = perf.withColumn("value", F.when(F.col("dataset_id").isin("c0", "c1"), -F.col("value")).otherwise(F.col("value")))
    a, b = (fo.selected_features(x, p, rk.ranks(p), train, k=2, trees=3).filter("holdout_id = 'c0'").orderBy("place").collect() for p in (perf, other))
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_grid_has_all_treatments(spark, world):
    x, perf, ranked, grp = world
    variants = spark.createDataFrame([("base", "f0"), ("base", "f1"), ("ext", "f0"), ("ext", "f1"), ("ext", "f3"), ("sel", "f0"), ("sel", "f1"), ("sel", "f2")],
                                     "variant string, feature string")
    s = fo.treatment_grid(x, perf, ranked, pr.training_pairs(grp), variants, trees=2, keep=2, selection_trees=2)
    per = s.groupBy("treatment").agg(F.count("*").alias("n")).collect()
    assert {r.treatment for r in per} == {f"{k}|{v}" for k in fo.KINDS for v in ("base", "ext", "sel")} and {r.n for r in per} == {27}
