"""Descriptor analysis: targets, association, redundancy, selection and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.stats import bh_fdr, spearman
from corpuslens.session import cut

# Clusters are cut at |rho| >= 0.7; near-duplicates start at 0.98.
CUT = 0.3
DUPLICATE = 0.98
# Catalogue groups behind a cost group (others are their own group).
COST_GROUPS = {
    "base_balance": ["simple", "balance"],
    "base_text": ["lexical", "social_media"],
    "base_mutual_info": ["info_theory"],
    "base_embedding": ["separability"],
    "base_manifest": ["manifest"],
    "shared_knn": [],
}


def meta_targets(ranked: DataFrame, sparse, dense) -> DataFrame:
    """(dataset_id, target, value): a rank per method, best score and paradigm gap."""
    a = ranked.groupBy("dataset_id").agg(
        F.max("value").alias("best_f1"),
        (F.max(F.when(F.col("algorithm").isin(*sparse), F.col("value")))
         - F.max(F.when(F.col("algorithm").isin(*dense), F.col("value")))).alias("paradigm_gap"))
    return ranked.select("dataset_id", F.col("algorithm").alias("target"), F.col("rank").alias("value")).unionByName(
        a.unpivot(["dataset_id"], ["best_f1", "paradigm_gap"], "target", "value"))


def best_method(ranked: DataFrame) -> DataFrame:
    """Method with the top score; ties go to the first column."""
    return ranked.groupBy("dataset_id").agg(
        F.max_by("algorithm", F.struct(F.col("value"), -F.col("alg_ord"))).alias("best_algo"))


def association(x: DataFrame, targets: DataFrame, cat: DataFrame) -> DataFrame:
    """(feature, target, origin, rho, p, q): q-values inside each origin block."""
    t = targets.select("dataset_id", "target", F.col("value").alias("_y"))
    s = spearman(x.join(t, "dataset_id"), ["feature", "target"], "value", "_y")
    return bh_fdr(s.join(cat.select("feature", "origin"), "feature"), ["origin"]).drop("n")


def importance_family(imp: DataFrame, cat: DataFrame) -> DataFrame:
    """(target, family, imp_sum, share) per family, and the share of all new features."""
    j = imp.join(cat, "feature")
    total = F.sum("imp_sum").over(Window.partitionBy("target"))
    fam = j.groupBy("target", "origin", F.col("grp").alias("family")).agg(F.sum("importance").alias("imp_sum"))
    fam = fam.withColumn("share", F.when(total > 0, F.col("imp_sum") / total).otherwise(0.0))
    new = fam.groupBy("target").agg(
        F.sum(F.when(F.col("origin") == "new", F.col("imp_sum")).otherwise(0.0)).alias("imp_sum"),
        F.sum(F.when(F.col("origin") == "new", F.col("share")).otherwise(0.0)).alias("share"))
    return fam.drop("origin").unionByName(new.select("target", F.lit("total_new").alias("family"), "imp_sum", "share"))


def top_features(imp: DataFrame, k=10) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.col("importance").desc(), "feature")
    return imp.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def symmetric(matrix: DataFrame) -> DataFrame:
    """Both directions of (f, g, rho), as |rho|."""
    m = matrix.select("f", "g", F.abs("rho").alias("rho"))
    return m.unionByName(m.select(F.col("g").alias("f"), F.col("f").alias("g"), "rho"))


def max_correlation(matrix: DataFrame, cat: DataFrame) -> DataFrame:
    """Per new feature: largest |rho| to a base feature and its name, and to a new one."""
    o = cat.select("feature", "origin")
    j = symmetric(matrix).join(o.withColumnRenamed("feature", "f").withColumnRenamed("origin", "of"), "f").join(
        o.withColumnRenamed("feature", "g").withColumnRenamed("origin", "og"), "g").filter("of = 'new'")
    # equal correlations (to 12 digits) name the first feature
    base = F.when(F.col("og") == "base", F.struct((-F.round("rho", 12)).alias("r"), "g"))
    best = F.max(F.when(F.col("og") == "base", F.col("rho")))
    return j.groupBy(F.col("f").alias("feature")).agg(
        best.alias("max_abs_rho_base"), F.min(base)["g"].alias("max_abs_rho_base_feature"),
        F.max(F.when(F.col("og") == "new", F.col("rho"))).alias("max_abs_rho_new"))


def linkage_clusters(matrix: DataFrame, features: DataFrame, cut_at=CUT) -> DataFrame:
    """(feature, cluster_id): average linkage on 1 - |rho|, cut at ``cut_at``.

    Every round merges all pairs that are each other's nearest within the cut.
    Average linkage is reducible, so this gives the same cut as merging one pair
    at a time, in few rounds. Works on the table of feature pairs.
    """
    d = cut(symmetric(matrix).select(F.col("f").alias("a"), F.col("g").alias("b"),
                                     F.greatest(F.lit(0.0), 1 - F.col("rho")).alias("d"),
                                     F.lit(1).alias("na"), F.lit(1).alias("nb")))
    member = features.select("feature", F.col("feature").alias("c"))
    while True:  # every round merges a pair at least
        near = d.filter(F.col("d") <= cut_at).groupBy("a").agg(F.min(F.struct(
            "d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("m"))
        # mutual choices: both ends picked the same (d, lo, hi)
        pairs = cut(near.groupBy(F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi")).agg(
            F.count(F.lit(1)).alias("n")).filter("n = 2"))
        if pairs.limit(1).count() == 0:
            break
        member = member.join(pairs.select(F.col("hi").alias("c"), "lo"), "c", "left").select(
            "feature", F.coalesce("lo", "c").alias("c"))
        pa_ = pairs.select(F.col("hi").alias("a"), F.col("lo").alias("ta"))
        pb_ = pairs.select(F.col("hi").alias("b"), F.col("lo").alias("tb"))
        moved = d.join(pa_, "a", "left").join(pb_, "b", "left").select(
            F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "d", "na", "nb",
            F.col("a").alias("_a"), F.col("b").alias("_b")).filter("a <> b")
        w = F.col("na") * F.col("nb")
        d = cut(moved.groupBy("a", "b").agg(
            (F.sum(F.col("d") * w) / F.sum(w)).alias("d"),
            F.aggregate(F.collect_set(F.struct("_a", "na")), F.lit(0), lambda s, x: s + x["na"]).alias("na"),
            F.aggregate(F.collect_set(F.struct("_b", "nb")), F.lit(0), lambda s, x: s + x["nb"]).alias("nb")))
    return member.select("feature", F.dense_rank().over(Window.orderBy("c")).alias("cluster_id"))


def composition(clusters: DataFrame, cat: DataFrame) -> DataFrame:
    """(cluster_id, size, composition)."""
    j = clusters.join(cat, "feature").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("origin")).alias("o"))
    return j.select("cluster_id", "size", F.when(F.col("o") == F.array(F.lit("base")), "base_only").when(
        F.col("o") == F.array(F.lit("new")), "new_only").otherwise("mixed").alias("composition"))


def cluster_summary(comp: DataFrame, max_corr: DataFrame) -> DataFrame:
    """One row: cluster counts by composition and shares of strongly correlated new features."""
    def n(kind):
        return F.sum((F.col("composition") == kind).cast("long"))
    a = comp.agg(F.count(F.lit(1)).alias("n_clusters"), n("base_only").alias("n_base_only"),
                 n("new_only").alias("n_new_only"), n("mixed").alias("n_mixed"))
    b = max_corr.agg(F.avg((F.col("max_abs_rho_base") >= 0.7).cast("int")).alias("frac_ge_07"),
                     F.avg((F.col("max_abs_rho_base") >= 0.9).cast("int")).alias("frac_ge_09"))
    one = F.lit(1)
    return a.withColumn("_k", one).join(b.withColumn("_k", one), "_k").drop("_k")


def representatives(clusters: DataFrame, matrix: DataFrame, cat: DataFrame, group_cost: DataFrame) -> DataFrame:
    """(cluster_id, feature, origin, kept, reason): a singleton stays; else the base
    member with the largest mean |rho| to its cluster; else the cheapest group's member."""
    c = clusters.join(cat, "feature").join(group_cost, "grp", "left")
    s = symmetric(matrix).withColumnRenamed("f", "feature")
    g = clusters.select(F.col("feature").alias("g"), "cluster_id")
    mean = s.join(clusters, "feature").join(g, ["g", "cluster_id"]).groupBy("feature").agg(F.avg("rho").alias("mean_rho"))
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))
    has_base = F.max((F.col("origin") == "base").cast("int")).over(Window.partitionBy("cluster_id"))
    j = c.join(mean, "feature", "left").withColumn("_size", size).withColumn("_base", has_base)
    cost = F.when(F.col("origin") == "base", F.lit(0.0)).otherwise(F.coalesce("mean_seconds", F.lit(float("inf"))))
    w = Window.partitionBy("cluster_id").orderBy(
        (F.col("origin") == "base").desc(), cost, F.round("mean_rho", 12).desc(), "feature")
    j = j.withColumn("kept", F.row_number().over(w) == 1)
    reason = (F.when(~F.col("kept"), "dropped_redundant_in_cluster").when(F.col("_size") == 1, "singleton_cluster")
              .when(F.col("_base") == 1, "cluster_representative_base_medoid")
              .otherwise("cluster_representative_new_lowest_cost"))
    return j.select("cluster_id", "feature", "origin", "kept", reason.alias("reason"))


def drop_near_duplicates(selection: DataFrame, matrix: DataFrame, at=DUPLICATE) -> DataFrame:
    """Second pass in cluster order: a kept feature goes if it nearly equals one kept
    before. The order matters, so the list of representatives (one short row) is
    folded; its partners come from the pair table."""
    close = symmetric(matrix).filter(F.col("rho") >= at).groupBy(F.col("f").alias("feature")).agg(
        F.collect_set("g").alias("near"))
    reps = selection.filter("kept").join(close, "feature", "left").select(
        "cluster_id", "feature", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    order = reps.groupBy().agg(F.array_sort(F.collect_list(F.struct("cluster_id", "feature", "near"))).alias("l"))
    start = F.struct(F.array().cast("array<string>").alias("kept"),
                     F.array().cast("array<struct<feature:string,of:string>>").alias("gone"))

    def step(acc, x):
        # the first kept one it duplicates, in keeping order
        of = F.get(F.filter(acc["kept"], lambda k: F.array_contains(x["near"], k)), F.lit(0))
        return F.struct(
            F.when(of.isNull(), F.concat(acc["kept"], F.array(x["feature"]))).otherwise(acc["kept"]).alias("kept"),
            F.when(of.isNull(), acc["gone"]).otherwise(F.concat(acc["gone"], F.array(F.struct(
                x["feature"].alias("feature"), of.alias("of"))))).alias("gone"))

    gone = order.select(F.explode(F.aggregate("l", start, step, lambda a: a["gone"])).alias("g")).select("g.*")
    return selection.join(gone, "feature", "left").select(
        "cluster_id", "feature", "origin", (F.col("kept") & F.col("of").isNull()).alias("kept"),
        F.when(F.col("of").isNotNull(), F.concat(F.lit(f"dropped_duplicate_ge_{at}_of_"), "of")).otherwise(
            F.col("reason")).alias("reason"))


def group_cost(cost: DataFrame) -> DataFrame:
    return cost.groupBy("grp").agg(F.avg("seconds").alias("mean_seconds"))


def cost_by_group(cost: DataFrame, cat: DataFrame) -> DataFrame:
    """Total, mean per corpus and per feature of each cost group."""
    table = F.create_map(*[v for g, to in COST_GROUPS.items()
                           for v in (F.lit(g), F.array(*[F.lit(t) for t in to]).cast("array<string>"))])
    per = cost.groupBy("grp").agg(F.sum("seconds").alias("total_seconds"))
    n = cost.select("dataset_id").distinct().agg(F.count(F.lit(1)).alias("n_datasets")).withColumn("_k", F.lit(1))
    per = per.withColumn("_k", F.lit(1)).join(n, "_k").drop("_k")
    sizes = cat.groupBy(F.col("grp").alias("cg"), "origin").agg(F.count(F.lit(1)).alias("nf"))
    mapped = per.select("grp", F.explode_outer(F.coalesce(F.try_element_at(table, F.col("grp")), F.array("grp"))).alias("cg"))
    feats = mapped.join(sizes, "cg", "left").groupBy("grp").agg(
        F.coalesce(F.sum("nf"), F.lit(0)).alias("n_features"),
        F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("_o"))
    j = per.join(feats, "grp")
    mean = F.col("total_seconds") / F.col("n_datasets")
    return j.select(
        "grp", F.when(F.col("_o") != "", F.col("_o")).when(F.col("grp").startswith("base_"), "base").otherwise(
            "new").alias("origin"),
        "n_features", "total_seconds", mean.alias("mean_seconds_per_dataset"),
        F.when(F.col("n_features") > 0, mean / F.col("n_features")).alias("seconds_per_feature"))
