"""Leave-one-out protocols: hold-out groups, leakage checks, scores and summaries.

The hold-out is a key, not a driver loop. ``scored`` is
(treatment, dataset_id, algorithm, alg_ord, score) with lower scores better.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.ranking import avg_rank
from corpuslens.functions.stats import pearson

# Where a provenance text names its source.
HUB_PATTERN = r"HF dataset ([\p{L}\p{N}_./-]+)"
LOCAL_PATTERN = r"local files? \[?'?(/[^,'\]]+)"


def self_groups(datasets: DataFrame) -> DataFrame:
    """Leave-one-corpus-out: every corpus is its own group."""
    return datasets.select("dataset_id").distinct().withColumn("grp", F.col("dataset_id"))


def source_groups(manifest: DataFrame, merges: DataFrame) -> DataFrame:
    """Source per corpus after the manual merge table (source, merged)."""
    return manifest.join(merges, "source", "left").select(
        "dataset_id", F.coalesce("merged", "source").alias("grp"))


def source_key(provenance: str = "provenance"):
    """Hub id, else folder of the local file, else the whole text."""
    c = F.col(provenance)
    folder = F.regexp_extract(F.regexp_extract(c, LOCAL_PATTERN, 1), r"^(.*)/[^/]*$", 1)
    return (
        F.when(c.rlike(HUB_PATTERN),
               F.concat(F.lit("hf:"), F.lower(F.regexp_extract(c, HUB_PATTERN, 1))))
        .when(c.rlike(LOCAL_PATTERN),
              F.concat(F.lit("localdir:"), F.when(folder == "", "/").otherwise(folder)))
        .otherwise(F.concat(F.lit("unk:"), c))
    )


def source_collisions(manifest: DataFrame) -> DataFrame:
    """Provenance keys that appear under more than one source."""
    return (
        manifest.select(source_key().alias("source_key"), "source").distinct()
        .groupBy("source_key").agg(
            F.count(F.lit(1)).alias("n_sources"),
            F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))
        .filter("n_sources > 1")
    )


def training_sizes(grp: DataFrame) -> DataFrame:
    """(dataset_id, n_train): corpora outside the held-out group, by subtraction."""
    own = grp.groupBy("grp").agg(F.count(F.lit(1)).alias("own"))
    total = own.agg(F.sum("own").alias("total"))
    return grp.join(own, "grp").join(total).select(
        "dataset_id", "grp", (F.col("total") - F.col("own")).alias("n_train"))


def training_pairs(grp: DataFrame) -> DataFrame:
    """(holdout_id, train_id) for learners that need the training rows themselves."""
    h = grp.select(F.col("dataset_id").alias("holdout_id"), F.col("grp").alias("h_grp"))
    t = grp.select(F.col("dataset_id").alias("train_id"), F.col("grp").alias("t_grp"))
    return h.join(t, F.col("h_grp") != F.col("t_grp"))


def leakage(train: DataFrame, grp: DataFrame) -> DataFrame:
    """Per hold-out: training size, own id in training, same-group ids in training."""
    g1 = grp.select(F.col("dataset_id").alias("holdout_id"), F.col("grp").alias("hg"))
    g2 = grp.select(F.col("dataset_id").alias("train_id"), F.col("grp").alias("tg"))
    return (
        train.join(g1, "holdout_id").join(g2, "train_id").groupBy("holdout_id")
        .agg(F.count(F.lit(1)).alias("n_train"),
             F.sum((F.col("holdout_id") == F.col("train_id")).cast("long")).alias("own_rows"),
             F.sum((F.col("hg") == F.col("tg")).cast("long")).alias("group_rows"))
    )


def spearman_scores(scored: DataFrame, true_ranks: DataFrame, keys=("treatment",)) -> DataFrame:
    """Spearman of predicted and true order, per treatment and corpus."""
    k = [*keys, "dataset_id"]
    j = scored.join(true_ranks.select("dataset_id", "algorithm", "rank"), ["dataset_id", "algorithm"])
    j = avg_rank(avg_rank(j, k, "score", "_p"), k, "rank", "_t")
    return j.groupBy(*k).agg(F.coalesce(pearson("_p", "_t"), F.lit(0.0)).alias("spearman"))


def loss_curve(scored: DataFrame, perf: DataFrame, keys=("treatment",)) -> DataFrame:
    """(.., t, loss): best score minus the best among the first t recommended."""
    k = [*keys, "dataset_id"]
    j = scored.join(perf.select("dataset_id", "algorithm", "value"), ["dataset_id", "algorithm"])
    by_pos = Window.partitionBy(*k).orderBy("score", "alg_ord")
    so_far = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return j.select(*k, F.row_number().over(by_pos).alias("t"),
                    (F.max("value").over(whole) - F.max("value").over(so_far)).alias("loss"))


def auc_loss(curve: DataFrame, keys=("treatment",)) -> DataFrame:
    return curve.groupBy(*keys, "dataset_id").agg(
        F.avg("loss").alias("auc_loss"), F.max(F.when(F.col("t") == 1, F.col("loss"))).alias("loss_t1"))


def evaluate(scored: DataFrame, perf: DataFrame, true_ranks: DataFrame, keys=("treatment",)) -> DataFrame:
    """(treatment, dataset_id, spearman, auc_loss, loss_t1)."""
    return spearman_scores(scored, true_ranks, keys).join(
        auc_loss(loss_curve(scored, perf, keys), keys), [*keys, "dataset_id"])


def summary(per_dataset: DataFrame, keys=("treatment",)) -> DataFrame:
    """Means and sample deviations over corpora."""
    return per_dataset.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.avg("spearman").alias("mean_spearman"), F.stddev_samp("spearman").alias("std_spearman"),
        F.avg("auc_loss").alias("mean_auc_loss"), F.stddev_samp("auc_loss").alias("std_auc_loss"),
        F.avg("loss_t1").alias("loss_t1"))


def flag_split(per_dataset: DataFrame, flags: DataFrame, keys=("treatment",)) -> DataFrame:
    """Mean Spearman for flagged and other corpora, counts and the drop."""
    yes = F.col("flag") == 1
    return (
        per_dataset.join(flags, "dataset_id").groupBy(*keys).agg(
            F.avg(F.when(yes, F.col("spearman"))).alias("mean_flagged"),
            F.avg(F.when(~yes, F.col("spearman"))).alias("mean_other"),
            F.sum(yes.cast("long")).alias("n_flagged"), F.sum((~yes).cast("long")).alias("n_other"))
        .withColumn("drop", F.col("mean_flagged") - F.col("mean_other"))
    )


def compare_protocols(lodo: DataFrame, loso: DataFrame) -> DataFrame:
    a = lodo.select("treatment", F.col("mean_spearman").alias("lodo"))
    b = loso.select("treatment", F.col("mean_spearman").alias("loso"))
    return a.join(b, "treatment").withColumn("diff", F.col("loso") - F.col("lodo"))


def best_setting(summaries: DataFrame, setting="lam") -> DataFrame:
    """The setting with the best mean Spearman; ties go to the smallest setting."""
    return summaries.agg(
        F.max_by(setting, F.struct(F.col("mean_spearman"), -F.col(setting))).alias(setting),
        F.max("mean_spearman").alias("mean_spearman"))
