"""The descriptor matrix X in long form (dataset_id, feature, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the base groups.
BASE_GROUPS = {
    "simple": [
        "n_instances", "n_classes", "log_instances", "instances_per_class",
    ],
    "balance": [
        "majority_pct", "minority_pct", "imbalance_ratio", "class_entropy",
    ],
    "lexical": [
        "vocab_size", "log_vocab_size", "vocab_per_instance", "type_token_ratio", "hapax_ratio", "mean_doc_len_words",
        "std_doc_len_words", "mean_doc_len_chars", "mean_word_len",
    ],
    "social_media": [
        "pct_docs_with_mention", "mean_mentions_per_doc", "pct_docs_with_url", "pct_docs_with_hashtag",
        "mean_hashtags_per_doc", "pct_docs_with_emoji", "uppercase_char_ratio", "exclamation_rate", "elongation_rate",
        "pct_docs_with_profanity", "profanity_token_rate",
    ],
    "info_theory": [
        "mean_mutual_info", "max_mutual_info",
    ],
    "separability": [
        "centroid_cosine_gap", "knn1_disagreement", "silhouette_by_label",
    ],
    "manifest": [
        "is_english", "is_multilingual_row", "is_twitter",
    ],
}
# Prefixes of the new groups and of the cheap ones among them.
NEW_GROUPS = ("tok", "hl", "ch", "lm", "cx", "ih", "mt", "lc")
CHEAP_PREFIXES = ("tok_", "lm_", "lc_")


def assemble(parts: list[DataFrame]) -> DataFrame:
    """One row per corpus out of one-row-per-corpus groups."""
    return reduce(lambda a, b: a.join(b, "dataset_id"), parts)


def to_long(wide: DataFrame) -> DataFrame:
    cols = [c for c in wide.columns if c != "dataset_id"]
    return wide.select("dataset_id", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["dataset_id"], cols, "feature", "value")


def finite(c: Column) -> Column:
    """Null for nan and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def constant_columns(x: DataFrame) -> DataFrame:
    """(feature, kept, constant_value): at most one distinct value means dropped."""
    g = x.groupBy("feature").agg(
        F.min(finite(F.col("value"))).alias("lo"), F.max(finite(F.col("value"))).alias("hi"))
    kept = F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))
    return g.select("feature", kept.alias("kept"), F.when(~kept, F.col("lo")).alias("constant_value"))


def drop_constant(x: DataFrame) -> DataFrame:
    return x.join(constant_columns(x).filter("kept").select("feature"), "feature", "left_semi")


def impute(x: DataFrame) -> DataFrame:
    """(dataset_id, feature, value, imputed): missing cells take the exact column median."""
    c = x.withColumn("value", finite(F.col("value")))
    med = c.groupBy("feature").agg(F.percentile("value", F.lit(0.5)).alias("_med"))
    return c.join(med, "feature").select(
        "dataset_id", "feature", F.coalesce("value", "_med").alias("value"),
        F.col("value").isNull().alias("imputed"))


def imputed_counts(imputed: DataFrame) -> DataFrame:
    return imputed.groupBy("feature").agg(F.sum(F.col("imputed").cast("long")).alias("n_imputed")).filter("n_imputed > 0")


def extend(base: DataFrame, new: DataFrame) -> DataFrame:
    """Both matrices side by side. Ids found on one side only raise an error row:
    ``status`` is 'both', 'left_only' or 'right_only'."""
    a, b = base.withColumn("_a", F.lit(1)), new.withColumn("_b", F.lit(1))
    j = a.join(b, "dataset_id", "full_outer")
    return j.withColumn("status", F.when(F.col("_b").isNull(), "left_only").when(
        F.col("_a").isNull(), "right_only").otherwise("both")).drop("_a", "_b")


def catalogue(features: DataFrame, base_groups: dict | None = None) -> DataFrame:
    """(feature, origin, grp): base columns by name, new ones by their prefix."""
    group_of = {c: g for g, cols in (base_groups or BASE_GROUPS).items() for c in cols}
    table = F.create_map(*[F.lit(v) for kv in group_of.items() for v in kv])
    named = F.try_element_at(table, F.col("feature"))
    prefix = F.split_part("feature", F.lit("_"), F.lit(1))
    return features.select(
        "feature", F.when(named.isNotNull(), "base").when(prefix.isin(*NEW_GROUPS), "new").otherwise(
            "unknown").alias("origin"),
        F.coalesce(named, F.when(prefix.isin(*NEW_GROUPS), prefix), F.lit("unknown")).alias("grp"))


def variants(cat: DataFrame, filtered: DataFrame) -> DataFrame:
    """(variant, feature). 'sel' starts from all columns and is cut per hold-out later."""
    cheap = F.lit(False)
    for p in CHEAP_PREFIXES:
        cheap = cheap | F.col("feature").startswith(p)
    f = cat.join(filtered.select("feature", F.lit(True).alias("_kept")), "feature", "left")
    names = F.filter(F.array(
        F.when(F.col("origin") == "base", "base"), F.lit("ext"), F.when(F.col("_kept"), "filt"), F.lit("sel"),
        F.when(F.col("origin") == "new", "new"), F.when((F.col("origin") == "new") & cheap, "cheap")),
        lambda v: v.isNotNull())
    return f.select(F.explode(names).alias("variant"), "feature")


def ranges(x: DataFrame) -> DataFrame:
    return x.groupBy("feature").agg(
        F.min("value").alias("min"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("max"))


def slowest(cost: DataFrame, n=10) -> DataFrame:
    return cost.orderBy(F.col("seconds").desc(), "dataset_id", "grp").limit(n)
