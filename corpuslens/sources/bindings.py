"""Binding of the given tables to the corpus model.

``docs``   (dataset_id, doc_id, text, label)          one row per corpus member
``scores`` (dataset_id, algorithm, alg_ord, fold, value)  the fold-score fact table
``points`` (dataset_id, doc_id, space, label, v)      vectors keyed by document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

N_CORPORA = 20
N_FOLDS = 10
N_GROUPS = 7

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with its declared schema (nothing is inferred)."""
    return spark.read.schema(T.StructType.fromDDL(SCHEMAS[name])).parquet(
        f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    """Three corpora over one scan: language, quality and toxicity labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels")
    member = F.array(
        F.struct(F.lit("lang").alias("dataset_id"), F.col("lang").alias("label")),
        F.struct(F.lit("quality").alias("dataset_id"), F.col("quality").cast("string").alias("label")),
        F.struct(F.lit("toxic").alias("dataset_id"), F.col("toxic").cast("string").alias("label")),
    )
    return (
        d.join(lab, "doc_id", "left")
        .select("doc_id", "text", F.explode(member).alias("m"))
        .select("m.dataset_id", "doc_id", "text", "m.label")
        .filter(F.col("label").isNotNull())
    )


DOCS_SQL = """
docs AS (
  SELECT 'lang' AS dataset_id, doc_id, text, lang AS label FROM documents WHERE lang IS NOT NULL
  UNION ALL
  SELECT 'quality', d.doc_id, d.text, CAST(l.quality AS VARCHAR)
  FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL
  UNION ALL
  SELECT 'toxic', d.doc_id, d.text, CAST(l.toxic AS VARCHAR)
  FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL
)"""


def corpus_id(user="user_id"):
    return F.concat(F.lit("c"), F.lpad((F.col(user) % N_CORPORA).cast("string"), 2, "0"))


CORPUS_ID_SQL = f"'c' || lpad(CAST(user_id % {N_CORPORA} AS VARCHAR), 2, '0')"


def scores(spark, sf_dir) -> DataFrame:
    """Fold scores: mean event value per (corpus, method, fold)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    means = (
        e.groupBy(corpus_id().alias("dataset_id"), F.col("event_type").alias("algorithm"),
                  (F.col("event_id") % N_FOLDS).cast("int").alias("fold"))
        # values have two decimals: summed as whole cents the mean is exact, so equal
        # scores are equal whatever the summing order
        .agg((F.sum(F.round(F.col("value") * 100).cast("long")) / (F.count("value") * F.lit(100.0))
              ).alias("value"))
    )
    methods = means.select("algorithm").distinct().withColumn(
        "alg_ord", F.row_number().over(Window.orderBy("algorithm")))
    return means.join(methods, "algorithm").select(
        "dataset_id", "algorithm", "alg_ord", "fold", "value")


SCORES_SQL = f"""
means AS (
  SELECT {CORPUS_ID_SQL} AS dataset_id, event_type AS algorithm,
         CAST(event_id % {N_FOLDS} AS INTEGER) AS fold, 
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(value) * 100::DOUBLE) AS value
  FROM events GROUP BY ALL
),
methods AS (
  SELECT algorithm, CAST(row_number() OVER (ORDER BY algorithm) AS INTEGER) AS alg_ord
  FROM (SELECT DISTINCT algorithm FROM means)
),
scores AS (SELECT m.*, alg_ord FROM means m JOIN methods USING (algorithm))"""


def performance(fold_scores: DataFrame) -> DataFrame:
    """Long P: mean over folds."""
    return fold_scores.groupBy("dataset_id", "algorithm", "alg_ord").agg(
        F.avg("value").alias("value"))


P_SQL = SCORES_SQL + """,
p AS (
  SELECT dataset_id, algorithm, alg_ord, avg(value) AS value
  FROM scores GROUP BY ALL
)"""


def groups(spark, sf_dir) -> DataFrame:
    """Source group of each corpus."""
    return (
        table(spark, sf_dir, "events").select("user_id")
        .select((F.col("user_id") % N_CORPORA).alias("k")).distinct()
        .select(F.concat(F.lit("c"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("dataset_id"),
                F.concat(F.lit("g"), (F.col("k") % N_GROUPS).cast("string")).alias("grp"))
    )


GROUPS_SQL = f"""
grps AS (
  SELECT DISTINCT {CORPUS_ID_SQL} AS dataset_id,
         'g' || CAST((user_id % {N_CORPORA}) % {N_GROUPS} AS VARCHAR) AS grp
  FROM events
)"""


def points(spark, sf_dir) -> DataFrame:
    """Vectors in two spaces: all dimensions, and the first half of them."""
    e = table(spark, sf_dir, "embeddings")
    half = F.slice("embedding", 1, F.floor(F.size("embedding") / 2).cast("int"))
    both = F.array(
        F.struct(F.lit("full").alias("space"), F.col("embedding").alias("v")),
        F.struct(F.lit("half").alias("space"), half.alias("v")))
    return (
        e.select(F.lit("vec").alias("dataset_id"), F.col("vec_id").alias("doc_id"), "label",
                 F.explode(both).alias("b"))
        .select("dataset_id", "b.space", "doc_id", "label", F.col("b.v").cast("array<double>").alias("v"))
    )


POINTS_SQL = """
points AS (
  SELECT 'vec' AS dataset_id, 'full' AS space, vec_id AS doc_id, label,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  UNION ALL
  SELECT 'vec', 'half', vec_id, label,
         CAST(embedding AS DOUBLE[])[1:CAST(floor(len(embedding) / 2) AS INTEGER)] FROM embeddings
)"""
