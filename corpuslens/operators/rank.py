"""Ranks and the rank-only recommenders.

A recommender returns (dataset_id, algorithm, alg_ord, score); lower is better.
``grp`` names what is held out together: the corpus itself for
leave-one-corpus-out, its source for leave-one-source-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.ranking import avg_rank, pick_key
from corpuslens.functions.stats import paired_signed_rank


def ranks(perf: DataFrame) -> DataFrame:
    """Rank of each method per corpus, 1 = best, ties averaged."""
    return avg_rank(perf, ["dataset_id"], "value", "rank", descending=True)


def recommended_order(scored: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Place of each method by score; equal scores keep the column order."""
    w = Window.partitionBy(*keys).orderBy("score", "alg_ord")
    return scored.withColumn("pos", F.row_number().over(w))



def _leave_out_sums(values: DataFrame, grp: DataFrame, col: str) -> DataFrame:
    """(grp, algorithm, alg_ord, s, n): sum and count over everything outside grp.

    Total minus own group: the fact table is read once, whatever the number of
    hold-outs.
    """
    own = (values.join(grp, "dataset_id").groupBy("grp", "algorithm", "alg_ord")
           .agg(F.sum(col).alias("s"), F.count(col).alias("n")))
    total = own.groupBy("algorithm", "alg_ord").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return own.join(total, ["algorithm", "alg_ord"]).select(
        "grp", "algorithm", "alg_ord",
        (F.col("ts") - F.col("s")).alias("s"), (F.col("tn") - F.col("n")).alias("n"))


def average_rank(r: DataFrame, grp: DataFrame) -> DataFrame:
    """Mean training rank, re-ranked. Ranks are half-integers, so subtraction is exact."""
    mean = _leave_out_sums(r, grp, "rank").filter("n > 0").withColumn("m", F.col("s") / F.col("n"))
    out = avg_rank(mean, ["grp"], "m", "score")
    return grp.join(out.select("grp", "algorithm", "alg_ord", "score"), "grp").drop("grp")


def median_rank(r: DataFrame, grp: DataFrame) -> DataFrame:
    """Median training rank, re-ranked.

    Ranks take at most 2m values, so the leave-out median comes from a
    histogram: total counts minus the held-out group's counts, then a running
    sum over the rank values.
    """
    own = r.join(grp, "dataset_id").groupBy("grp", "algorithm", "alg_ord", "rank").agg(
        F.count(F.lit(1)).alias("n"))
    total = own.groupBy("algorithm", "alg_ord", "rank").agg(F.sum("n").alias("tn"))
    hist = (
        own.select("grp", "algorithm").distinct().join(total, "algorithm")
        .join(own.drop("alg_ord"), ["grp", "algorithm", "rank"], "left")
        .withColumn("c", F.col("tn") - F.coalesce("n", F.lit(0))).filter("c > 0")
    )
    run = Window.partitionBy("grp", "algorithm").orderBy("rank")
    cum = hist.withColumn("cum", F.sum("c").over(run)).withColumn(
        "all", F.sum("c").over(Window.partitionBy("grp", "algorithm")))
    med = cum.groupBy("grp", "algorithm", "alg_ord").agg(
        ((F.min(F.when(F.col("cum") >= F.floor((F.col("all") + 1) / 2), F.col("rank")))
          + F.min(F.when(F.col("cum") >= F.floor((F.col("all") + 2) / 2), F.col("rank")))) / 2
         ).alias("m"))
    out = avg_rank(med, ["grp"], "m", "score")
    return grp.join(out.select("grp", "algorithm", "alg_ord", "score"), "grp").drop("grp")


def win_tensor(fold_scores: DataFrame, alpha=0.05) -> DataFrame:
    """(dataset_id, alg_i, alg_j, win): i beats j by an exact paired test over folds.

    Both sides meet on (corpus, fold); a group there is one fold's methods.
    """
    a = fold_scores.select("dataset_id", "fold", F.col("algorithm").alias("alg_i"),
                           F.col("value").alias("vi"))
    b = fold_scores.select("dataset_id", "fold", F.col("algorithm").alias("alg_j"),
                           F.col("value").alias("vj"))
    pairs = (
        a.join(b, ["dataset_id", "fold"]).filter("alg_i <> alg_j")
        .withColumn("d", F.round(F.col("vi") - F.col("vj"), 9))
    )
    test = paired_signed_rank(pairs, ["dataset_id", "alg_i", "alg_j"], "d")
    return test.select(
        "dataset_id", "alg_i", "alg_j",
        F.when((F.col("p") < alpha) & (F.col("mean_d") > 0), 1).otherwise(0).alias("win"))


def significant_wins(wins: DataFrame, grp: DataFrame, methods: DataFrame) -> DataFrame:
    """Training wins of each method; the score is minus the count, so lower is better."""
    w = wins.groupBy("dataset_id", F.col("alg_i").alias("algorithm")).agg(F.sum("win").alias("w"))
    w = w.join(methods, "algorithm")
    s = _leave_out_sums(w, grp, "w")
    return grp.join(s, "grp").select(
        "dataset_id", "algorithm", "alg_ord", (-F.col("s")).cast("double").alias("score"))


def random_order(perf: DataFrame, seed=42) -> DataFrame:
    """One permutation per corpus, as a sanity floor."""
    w = Window.partitionBy("dataset_id").orderBy(pick_key(seed, "dataset_id", "algorithm"))
    return perf.select("dataset_id", "algorithm", "alg_ord",
                       F.row_number().over(w).cast("double").alias("score"))
