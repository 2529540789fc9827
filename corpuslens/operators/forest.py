"""Multi-output forests grown level by level, for all hold-outs and trees at once.

Keys of every table: (cfg, holdout_id, tree, node). ``cfg`` is a treatment or a
lambda; the hold-out is a key, so there is no loop over hold-outs or trees. The
row to be predicted travels with the training rows at weight 0, so a prediction
is the mean of the leaf it ends in.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.ranking import avg_rank
from corpuslens.session import cut

TREE = ["cfg", "holdout_id", "tree"]
NODE = [*TREE, "node"]
SEED = 0


def _key(*cols):
    return F.md5(F.concat_ws(":", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols]))


def hybrid_targets(perf: DataFrame, ranked: DataFrame, train: DataFrame, lambdas: dict) -> tuple[DataFrame, int]:
    """(cfg, holdout_id, dataset_id, y0..): P and R z-scored on each training set and
    scaled so that the sum of squares is lam * SS(R) + (1 - lam) * SS(P)."""
    m = ranked.select("alg_ord").distinct().count()
    v = ranked.select("dataset_id", "alg_ord", F.col("value").alias("p"), F.col("rank").alias("r")).join(
        train.select("holdout_id", F.col("train_id").alias("dataset_id")), "dataset_id")
    w = Window.partitionBy("holdout_id", "alg_ord")

    def z(c):
        sd = F.stddev_pop(c).over(w)
        return (F.col(c) - F.avg(c).over(w)) / F.when(sd < 1e-12, F.lit(1.0)).otherwise(sd)
    v = v.withColumns({"p": z("p"), "r": z("r")})
    wide = v.groupBy("holdout_id", "dataset_id").agg(*[
        F.max(F.when(F.col("alg_ord") == i + 1, F.col(c))).alias(f"{c}{i}") for c in ("p", "r") for i in range(m)])
    lam = F.explode(F.array(*[F.struct(F.lit(c).alias("cfg"), F.lit(float(x)).alias("lam")) for c, x in lambdas.items()]))
    wide = wide.withColumn("_c", lam)
    a, b = F.sqrt(1 - F.col("_c.lam")), F.sqrt(F.col("_c.lam"))
    return wide.select(
        F.col("_c.cfg").alias("cfg"), "holdout_id", "dataset_id",
        *[(a * F.coalesce(f"p{i}", F.lit(0.0))).alias(f"y{i}") for i in range(m)],
        *[(b * F.coalesce(f"r{i}", F.lit(0.0))).alias(f"y{m + i}") for i in range(m)]), 2 * m


def bootstrap(y: DataFrame, trees: int, seed=SEED) -> DataFrame:
    """(cfg, holdout_id, tree, dataset_id, w): n hashed draws with replacement per tree.
    Draws do not depend on cfg, so treatments share them."""
    h = ["cfg", "holdout_id"]
    num = y.select(*h, "dataset_id").withColumn(
        "_i", F.row_number().over(Window.partitionBy(*h).orderBy("dataset_id")) - 1)
    size = num.groupBy(*h).agg(F.count(F.lit(1)).alias("_n"))
    draws = (
        size.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "holdout_id", "tree", "_d"), F.col("_n")).cast("int"))
        .groupBy(*TREE, "_i").agg(F.count(F.lit(1)).alias("w")))
    return draws.join(num, [*h, "_i"]).select(*TREE, "dataset_id", F.col("w").cast("double").alias("w"))


def grow(x: DataFrame, y: DataFrame, n_y: int, rows: DataFrame, mtry: dict, min_leaf: dict,
         allowed: DataFrame | None = None, max_depth: int | None = None, seed=SEED):
    """Grow all trees. Returns (members, splits).

    ``x`` (dataset_id, feature, value); ``y`` (cfg, holdout_id, dataset_id, y0..);
    ``rows`` (cfg, holdout_id, tree, dataset_id, w, pf, partner): training rows with
    w > 0 and rows to predict with w = 0, which read feature ``pf`` from ``partner``.
    A level is one aggregate by (node, feature, value), a running sum along the
    value, and a min over the candidate splits. Both sides need the minimum leaf
    weight, and a split must gain more than 1e-9 of the node's sum of squares.
    """
    ys = [f"y{i}" for i in range(n_y)]
    feats = x.select("feature").distinct()
    n_feat = feats.count()
    members = cut(rows.withColumn("node", F.lit(1).cast("long")).withColumn("live", F.lit(True)))
    y = y.withColumn("q", reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in ys])).persist()
    own_x = not x.is_cached
    x = x.persist()
    by_cfg = F.create_map(*[F.lit(v) for c, k in mtry.items() for v in (c, k if k else n_feat)])
    leaf_of = F.create_map(*[F.lit(v) for c, k in min_leaf.items() for v in (c, float(k))])
    one = feats.groupBy(F.lit(1).alias("_o")).agg(F.collect_list("feature").alias("_fs"))
    splits = None
    for depth in itertools.count():
        if depth == max_depth:
            break
        if depth > 61:
            raise RuntimeError("a tree is deeper than 61 levels; node numbers end there")
        train = members.filter("live and w > 0").join(y, ["cfg", "holdout_id", "dataset_id"])
        nodes = train.groupBy(*NODE).agg(F.sum("w").alias("W")).filter(F.col("W") >= 2 * leaf_of[F.col("cfg")])
        cand = nodes.withColumn("_o", F.lit(1)).join(one, "_o").select(*NODE, F.explode("_fs").alias("feature"))
        if allowed is not None:
            cand = cand.join(allowed, ["cfg", "holdout_id", "feature"], "left_semi")
        pick = Window.partitionBy(*NODE).orderBy(_key(F.lit(str(seed)), "holdout_id", "tree", "node", "feature"))
        cand = cand.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= by_cfg[F.col("cfg")]).drop("_r")
        cells = train.join(cand, NODE).join(x, ["dataset_id", "feature"]).groupBy(*NODE, "feature", "value").agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("q")).alias("q"),
            *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ys])
        along = Window.partitionBy(*NODE, "feature").orderBy("value")
        run = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        s = cells.select(*NODE, "feature", "value", F.lead("value").over(along).alias("nv"),
                         *[F.sum(c).over(run).alias(f"l_{c}") for c in ("w", "q", *ys)],
                         *[F.sum(c).over(whole).alias(f"a_{c}") for c in ("w", "q", *ys)])

        def ss(pre):
            return pre("q") - reduce(lambda a, b: a + b, [pre(c) * pre(c) for c in ys]) / pre("w")
        left = ss(lambda c: F.col(f"l_{c}"))
        right = ss(lambda c: F.col(f"a_{c}") - F.col(f"l_{c}"))
        parent = ss(lambda c: F.col(f"a_{c}"))
        leaf = leaf_of[F.col("cfg")]
        s = s.filter(F.col("nv").isNotNull() & (F.col("l_w") >= leaf) & (F.col("a_w") - F.col("l_w") >= leaf))
        best = s.select(*NODE, "feature", ((F.col("value") + F.col("nv")) / 2).alias("threshold"),
                        F.round(left + right, 9).alias("score"), parent.alias("parent")).groupBy(*NODE).agg(
            F.min(F.struct("score", "feature", "threshold", "parent")).alias("b")).select(*NODE, "b.*")
        best = cut(best.filter((F.col("parent") > 1e-12) & (
            F.col("score") < F.col("parent") - 1e-9 * F.greatest(F.lit(1.0), F.col("parent")))))
        if best.limit(1).count() == 0:
            break
        level = best.select(*NODE, "feature", "threshold", (F.col("parent") - F.col("score")).alias("gain"))
        splits = level if splits is None else splits.unionByName(level)
        j = members.join(best.select(*NODE, "feature", "threshold"), NODE, "left")
        j = j.withColumn("_x", F.when(F.col("feature") == F.col("pf"), F.col("partner")).otherwise(F.col("dataset_id")))
        vx = x.select(F.col("dataset_id").alias("_x"), "feature", "value")
        members = cut(j.join(vx, ["_x", "feature"], "left").select(
            *TREE, "dataset_id", "w", "pf", "partner",
            F.when(F.col("feature").isNull() | ~F.col("live"), F.col("node")).otherwise(
                F.col("node") * 2 + (F.col("value") > F.col("threshold")).cast("long")).alias("node"),
            (F.col("feature").isNotNull() & F.col("live")).alias("live")))
    if splits is None:
        splits = best.select(*NODE, "feature", "threshold", F.lit(0.0).alias("gain")).limit(0)
    # all that is returned has been written out
    y.unpersist()
    if own_x:
        x.unpersist()
    return members, splits


def training_rows(y: DataFrame, trees: int, seed=SEED) -> DataFrame:
    return bootstrap(y, trees, seed).withColumns({"pf": F.lit(""), "partner": F.col("dataset_id")})


def query_rows(queries: DataFrame, trees: int) -> DataFrame:
    """Rows to predict, (cfg, holdout_id, dataset_id[, pf, partner]), once per tree at weight 0."""
    q = queries if "pf" in queries.columns else queries.withColumns({"pf": F.lit(""), "partner": F.col("dataset_id")})
    return q.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(
        *TREE, "dataset_id", F.lit(0.0).alias("w"), "pf", "partner")


def leaf_means(members: DataFrame, values: DataFrame, by, cols) -> DataFrame:
    """Mean over trees of the raw values in the leaf of each query row.
    ``values`` is (dataset_id, by.., cols..)."""
    tr = members.filter("w > 0").join(values, "dataset_id")
    leaf = tr.groupBy(*NODE, *by).agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in cols])
    q = members.filter("w = 0").select(*NODE, "dataset_id", "pf", "partner")
    return q.join(leaf, NODE).groupBy("cfg", "holdout_id", "dataset_id", "pf", "partner", *by).agg(
        *[F.avg(c).alias(c) for c in cols])


def recommend(x: DataFrame, perf: DataFrame, ranked: DataFrame, train: DataFrame, cfgs: dict,
              trees=100, allowed: DataFrame | None = None, seed=SEED) -> DataFrame:
    """(treatment, dataset_id, algorithm, alg_ord, score), lower is better.

    ``cfgs`` maps a treatment to dict(kind, lam): 'perf' ranks by predicted score
    (all features, leaf 1), 'rank' scores by predicted rank (all features, leaf 1),
    'hybrid' mixes both in the split (square-root many features, leaf 3).
    """
    n_feat = x.select("feature").distinct().count()
    y, n_y = hybrid_targets(perf, ranked, train, {c: s["lam"] for c, s in cfgs.items()})
    y = cut(y)
    hold = y.select("cfg", "holdout_id").distinct().withColumn("dataset_id", F.col("holdout_id"))
    rows = training_rows(y, trees, seed).unionByName(query_rows(hold, trees))
    mtry = {c: max(1, int(n_feat ** 0.5)) if s["kind"] == "hybrid" else 0 for c, s in cfgs.items()}
    leaf = {c: 3 if s["kind"] == "hybrid" else 1 for c, s in cfgs.items()}
    members, _ = grow(x, y, n_y, rows, mtry, leaf, allowed, seed=seed)
    return scored(members, ranked, {c: s["kind"] for c, s in cfgs.items()})


def importance(splits: DataFrame, keys=("cfg", "holdout_id")) -> DataFrame:
    """(keys, feature, importance): gains normalised per tree, averaged over trees."""
    per = splits.groupBy(*keys, "tree", "feature").agg(F.sum("gain").alias("g"))
    tot = F.sum("g").over(Window.partitionBy(*keys, "tree"))
    n = per.select(*keys, "tree").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("s", F.col("g") / tot).groupBy(*keys, "feature").agg(F.sum("s").alias("s")).join(
        n, list(keys)).select(*keys, "feature", (F.col("s") / F.col("n")).alias("importance"))


def selected_features(x: DataFrame, perf: DataFrame, ranked: DataFrame, train: DataFrame, k=36, trees=500,
                      seed=SEED) -> DataFrame:
    """(holdout_id, feature, place): top ``k`` by importance for the ranks, inside each
    training set."""
    y, n_y = hybrid_targets(perf, ranked, train, {"sel": 1.0})
    y = cut(y)
    _, splits = grow(x, y, n_y, training_rows(y, trees, seed), {"sel": 0}, {"sel": 1}, seed=seed)
    w = Window.partitionBy("holdout_id").orderBy(F.col("importance").desc(), "feature")
    return importance(splits).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(
        "holdout_id", "feature", "place")


KINDS = {"forest_p": dict(kind="perf", lam=0.0), "forest_r": dict(kind="rank", lam=1.0), "forest_hybrid": dict(kind="hybrid", lam=0.5)}


def feature_masks(treatments: dict, variants: DataFrame, selected: DataFrame, holds: DataFrame) -> DataFrame:
    """(cfg, holdout_id, feature): what each treatment may split on. ``treatments`` maps a name to its variant;
    'sel' takes the hold-out's own selection, every other variant is the same for all hold-outs."""
    of = F.create_map(*[F.lit(v) for kv in treatments.items() for v in kv])
    names = holds.select("holdout_id").distinct().withColumn("cfg", F.explode(F.array(*[F.lit(t) for t in treatments])))
    names = names.withColumn("variant", of[F.col("cfg")])
    fixed = names.filter("variant <> 'sel'").join(variants, "variant").select("cfg", "holdout_id", "feature")
    own = names.filter("variant = 'sel'").join(selected.select("holdout_id", "feature"), "holdout_id").select("cfg", "holdout_id", "feature")
    return fixed.unionByName(own)


def treatment_grid(x: DataFrame, perf: DataFrame, ranked: DataFrame, train: DataFrame, variants: DataFrame, trees=100,
                   keep=36, selection_trees=500, seed=SEED) -> DataFrame:
    """(treatment, dataset_id, algorithm, alg_ord, score) of the three forests on every variant of the columns.

    ``variants`` (variant, feature) as ``matrix.variants`` gives them. The columns of 'sel' are the ``keep`` most
    important ones of a forest grown on each hold-out's training set alone; the masks are a
    table of the plan, so all treatments and hold-outs grow in the same levels.
    """
    sizes = {r.variant: r.n for r in variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).collect()}
    treatments = {f"{kind}|{v}": v for kind in KINDS for v in sorted(sizes)}
    chosen = cut(selected_features(x, perf, ranked, train, keep, selection_trees, seed))
    allowed = cut(feature_masks(treatments, variants, chosen, train))
    y, n_y = hybrid_targets(perf, ranked, train, {t: KINDS[t.split("|")[0]]["lam"] for t in treatments})
    y = cut(y)
    hold = y.select("cfg", "holdout_id").distinct().withColumn("dataset_id", F.col("holdout_id"))
    rows = training_rows(y, trees, seed).unionByName(query_rows(hold, trees))
    kinds = {t: KINDS[t.split("|")[0]]["kind"] for t in treatments}
    width = {t: min(keep, sizes[v]) if v == "sel" else sizes[v] for t, v in treatments.items()}
    mtry = {t: max(1, int(width[t] ** 0.5)) if k == "hybrid" else 0 for t, k in kinds.items()}
    members, _ = grow(x, y, n_y, rows, mtry, {t: 3 if k == "hybrid" else 1 for t, k in kinds.items()}, allowed, seed=seed)
    return scored(members, ranked, kinds)


def scored(members: DataFrame, ranked: DataFrame, kinds: dict) -> DataFrame:
    """Scores of the rows to predict: predicted ranks, or for kind 'perf' the ranks of predicted values."""
    v = ranked.select("dataset_id", "algorithm", "alg_ord", "value", "rank")
    p = leaf_means(members, v, ["algorithm", "alg_ord"], ["value", "rank"])
    p = avg_rank(p.withColumn("value", F.round("value", 9)), ["cfg", "holdout_id"], "value", "_pr", descending=True)
    of = F.create_map(*[F.lit(t) for kv in kinds.items() for t in kv])
    return p.select(F.col("cfg").alias("treatment"), "dataset_id", "algorithm", "alg_ord",
                    F.when(of[F.col("cfg")] == "perf", F.col("_pr")).otherwise(F.round("rank", 9)).alias("score"))


def impurity_importance(x: DataFrame, targets: DataFrame, trees=500, seeds=10, min_leaf=2) -> DataFrame:
    """(target, feature, importance): one forest per target and seed, averaged.
    ``targets`` is (dataset_id, target, value); the seed is the hold-out key."""
    y = targets.withColumn("holdout_id", F.explode(F.array(*[F.lit(str(s)) for s in range(seeds)]))).select(
        F.col("target").alias("cfg"), "holdout_id", "dataset_id", F.col("value").alias("y0"))
    names = [r[0] for r in targets.select("target").distinct().collect()]  # one short name per target
    _, splits = grow(x, cut(y), 1, training_rows(y, trees), {t: 0 for t in names}, {t: min_leaf for t in names})
    return importance(splits).groupBy(F.col("cfg").alias("target"), "feature").agg(
        (F.sum("importance") / seeds).alias("importance"))


def permutation_importance(x: DataFrame, targets: DataFrame, trees=500, folds=5, repeats=5, min_leaf=2,
                           seed=SEED) -> DataFrame:
    """(target, feature, importance): rise of the mean absolute error when a feature's
    test values change places, averaged over folds and repeats.

    The shuffled rows go down the trees with the others: a row reads the shuffled
    feature from its partner in the same test fold.
    """
    ids = targets.select("dataset_id").distinct()
    place = F.row_number().over(Window.orderBy(_key(F.lit(str(seed)), "dataset_id"))) - 1
    ids = ids.withColumn("fold", (place % folds).cast("string"))
    t = targets.join(ids, "dataset_id").withColumn("holdout_id", F.explode(F.array(*[F.lit(str(f)) for f in range(folds)])))
    y = cut(t.filter("fold <> holdout_id").select(F.col("target").alias("cfg"), "holdout_id", "dataset_id",
                                                  F.col("value").alias("y0")))
    names = [r[0] for r in targets.select("target").distinct().collect()]
    # partners: the places of one order read by the places of another
    w0 = Window.partitionBy("fold").orderBy("dataset_id")
    own = ids.withColumn("i", F.row_number().over(w0))
    reps = own.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).join(
        x.select("feature").distinct().groupBy(F.lit(1).alias("_o")).agg(F.collect_list("feature").alias("fs"))
        .drop("_o"), how="inner").withColumn("pf", F.explode("fs")).drop("fs")
    w1 = Window.partitionBy("fold", "rep", "pf").orderBy(_key("rep", "pf", "dataset_id"))
    mixed = reps.withColumn("j", F.row_number().over(w1)).select(
        "fold", "rep", "pf", F.col("j").alias("i"), F.col("dataset_id").alias("partner"))
    pairs = reps.select("fold", "rep", "pf", "i", "dataset_id").join(mixed, ["fold", "rep", "pf", "i"])
    plain = own.select(F.col("fold").alias("holdout_id"), "dataset_id", F.lit("").alias("pf"),
                       F.col("dataset_id").alias("partner"))
    shuf = pairs.select(F.col("fold").alias("holdout_id"), "dataset_id", "pf", "partner").distinct()
    q = plain.unionByName(shuf).withColumn("cfg", F.explode(F.array(*[F.lit(n) for n in names])))
    rows = training_rows(y, trees, seed).unionByName(query_rows(q, trees))
    members, _ = grow(x, y, 1, rows, {n: 0 for n in names}, {n: min_leaf for n in names}, seed=seed)
    pred = leaf_means(members, targets.select("dataset_id", F.col("target").alias("_t"), "value"), ["_t"], ["value"])
    pred = pred.filter("_t = cfg").withColumnRenamed("value", "pred").join(
        targets.select("dataset_id", F.col("target").alias("cfg"), F.col("value").alias("true")), ["dataset_id", "cfg"])
    err = pred.withColumn("e", F.abs(F.col("pred") - F.col("true")))
    base = err.filter("pf = ''").groupBy("cfg", "holdout_id").agg(F.avg("e").alias("b"))
    e2 = err.filter("pf <> ''").join(pairs.withColumnRenamed("fold", "holdout_id"), ["holdout_id", "pf", "dataset_id", "partner"])
    per = e2.groupBy("cfg", "holdout_id", "pf", "rep").agg(F.avg("e").alias("e")).join(base, ["cfg", "holdout_id"])
    return per.groupBy(F.col("cfg").alias("target"), F.col("pf").alias("feature")).agg(
        F.avg(F.col("e") - F.col("b")).alias("importance"))
