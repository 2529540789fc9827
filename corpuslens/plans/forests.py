"""Forest recommenders and importances over the event corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import analysis as an
from corpuslens.operators import forest as fo
from corpuslens.operators import matrix as mx
from corpuslens.operators import protocol as pr
from corpuslens.operators import rank as rk
from corpuslens.plans.descriptive import DENSE, SPARSE, clean_long, features, near_dup_drop
from corpuslens.plans.registry import query, rounded
from corpuslens.sources import bindings as b

TREES = 10  # per hold-out; a parameter of every operator


def inputs(spark, sf, grp=None):
    perf = b.performance(b.scores(spark, sf)).persist()
    train = pr.training_pairs(pr.self_groups(b.groups(spark, sf)) if grp is None else grp)
    return clean_long(spark, sf), perf, rk.ranks(perf).persist(), train


def _one(spark, sf, name, kind, lam):
    x, perf, r, train = inputs(spark, sf)
    return rounded(fo.recommend(x, perf, r, train, {name: dict(kind=kind, lam=lam)}, TREES), "score")


@query("forest_p")
def forest_p(spark, sf):
    return _one(spark, sf, "forest_p", "perf", 0.0)


@query("forest_r")
def forest_r(spark, sf):
    return _one(spark, sf, "forest_r", "rank", 1.0)


@query("forest_hybrid")
def forest_hybrid(spark, sf):
    return _one(spark, sf, "forest_hybrid", "hybrid", 0.5)


@query("lambda_sweep")
def lambda_sweep(spark, sf):
    """Mean Spearman per lambda; all values grow in the same levels."""
    x, perf, r, train = inputs(spark, sf)
    lams = {f"{v:.2f}": v for v in (0.0, 0.25, 0.5, 0.75, 1.0)}
    s = fo.recommend(x, perf, r, train, {c: dict(kind="hybrid", lam=v) for c, v in lams.items()}, TREES)
    out = pr.summary(pr.evaluate(s, perf, r)).withColumn("lam", F.col("treatment").cast("double"))
    best = pr.best_setting(out).select("lam", F.lit(True).alias("best"))
    return rounded(out.join(best, "lam", "left").select(
        "lam", "mean_spearman", "mean_auc_loss", F.coalesce("best", F.lit(False)).alias("best")),
        "mean_spearman", "mean_auc_loss")


KEEP, SELECTION_TREES = 36, 10


def grid(spark, sf, grp=None):
    """Average rank and the three forests on six variants of the columns: nineteen treatments."""
    grp = pr.self_groups(b.groups(spark, sf)) if grp is None else grp
    x, perf, r, train = inputs(spark, sf, grp)
    cat = features(spark, sf).join(x.select("feature").distinct(), "feature", "left_semi")
    kept = near_dup_drop(spark, sf).filter("kept").select("feature")
    s = fo.treatment_grid(x, perf, r, train, mx.variants(cat, kept).persist(), TREES, KEEP, SELECTION_TREES)
    ar = rk.average_rank(r, grp).withColumn("treatment", F.lit("average_rank"))
    out = pr.summary(pr.evaluate(s.unionByName(ar.select(s.columns)), perf, r))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query("treatment_grid")
def treatment_grid(spark, sf):
    """All treatments, each hold-out's source left out."""
    return grid(spark, sf, b.groups(spark, sf))


@query("treatment_grid_lodo")
def treatment_grid_lodo(spark, sf):
    """All treatments, only the hold-out itself left out."""
    return grid(spark, sf)


@query("selected_features")
def selected_features(spark, sf):
    x, perf, r, train = inputs(spark, sf)
    return fo.selected_features(x, perf, r, train, k=5, trees=TREES)


def targets(spark, sf):
    return an.meta_targets(rk.ranks(b.performance(b.scores(spark, sf))), SPARSE, DENSE)


def impurity(spark, sf):
    return fo.impurity_importance(clean_long(spark, sf), targets(spark, sf), trees=TREES, seeds=2)


@query("importance_impurity")
def importance_impurity(spark, sf):
    return rounded(impurity(spark, sf), "importance")


@query("importance_perm")
def importance_perm(spark, sf):
    out = fo.permutation_importance(clean_long(spark, sf), targets(spark, sf), trees=5, folds=4, repeats=2)
    return rounded(out, "importance")


@query("importance_family")
def importance_family(spark, sf):
    return rounded(an.importance_family(impurity(spark, sf), features(spark, sf)), "imp_sum", "share")


@query("importance_top")
def importance_top(spark, sf):
    return rounded(an.top_features(impurity(spark, sf)), "importance")
