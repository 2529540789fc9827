"""The profile of real corpora, and the matrix made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import landmark as lm
from corpuslens.operators import matrix as mx
from corpuslens.operators import profile as pf
from corpuslens.operators import vectors as vec
from corpuslens.plans import landmarks, textual, vectorial  # noqa: F401  (twins of the parts)
from corpuslens.plans.registry import SQL, query, rounded
from corpuslens.sources import bindings as b

def corpus():
    """A corpus of the profile: the documents of a source, labelled by language."""
    return F.concat(F.lit("c"), F.lpad(F.regexp_extract("source", r"(\d+)", 1), 2, "0"))


CORPUS_SQL = "'c' || lpad(regexp_extract(source, '(\\d+)', 1), 2, '0')"
DOCS_SQL = f"""
docs AS (SELECT {CORPUS_SQL} AS dataset_id, doc_id, text, lang AS label FROM documents WHERE lang IS NOT NULL)"""
POINTS_SQL = DOCS_SQL + """,
points AS (SELECT dataset_id, 'text' AS space, doc_id, docs.label, CAST(embedding AS DOUBLE[]) AS v FROM docs JOIN embeddings ON vec_id = doc_id)"""
COLUMNS = [c for g in mx.BASE_GROUPS.values() for c in g] + ["ch_zipf_slope", "lm_nc_tfidf", "lm_nc_dense"]


def _on(name, **as_):
    """A registered twin over the corpora of the profile."""
    q = SQL[name].replace(b.DOCS_SQL.strip(), DOCS_SQL.strip()).replace(b.POINTS_SQL.strip(), POINTS_SQL.strip())
    return f"(SELECT * {('RENAME (' + ', '.join(f'{k} AS {v}' for k, v in as_.items()) + ')') if as_ else ''} FROM ({q}))"


def _profile_sql():
    parts = [_on(n) for n in ("size_features", "balance", "vocab_stats", "length_stats", "social_marks", "uppercase_ratio", "word_list_rate",
                              "term_mi_neighbours", "zipf_slope")]
    parts += [_on(n) for n in ("centroid_gap", "nn1_disagreement", "silhouette")]
    # the twin of the dense landmark is kept apart by space, which is the corpus here
    dense = SQL["nc_dense_cv"].replace(b.POINTS_SQL.strip(), POINTS_SQL.strip().replace("SELECT dataset_id, 'text' AS space", "SELECT 'vec' AS dataset_id, dataset_id AS space"))
    parts += [_on("nc_tfidf_cv", f1="lm_nc_tfidf"), f"(SELECT space AS dataset_id, f1 AS lm_nc_dense FROM ({dense}))"]
    flags = f"""(SELECT {CORPUS_SQL} AS dataset_id, CAST(mode(lang) = 'en' AS INTEGER) AS is_english, CAST(mode(lang) <> 'en' AS INTEGER) AS is_multilingual_row,
  CAST(max(source) = 'src3' AS INTEGER) AS is_twitter FROM documents GROUP BY 1)"""
    return f"SELECT dataset_id, {', '.join(COLUMNS)} FROM " + "\nLEFT JOIN ".join([parts[0], *[f"{p} p{i} USING (dataset_id)" for i, p in enumerate([*parts[1:], flags])]])


def profile_rows(spark, sf):
    d = b.table(spark, sf, "documents").filter("lang is not null")
    members = d.select(corpus().alias("dataset_id"), "doc_id", F.col("lang").alias("label"))
    vectors = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    manifest = d.groupBy(corpus().alias("dataset_id")).agg(
        F.mode("lang").alias("language"), F.when(F.max("source") == "src3", "twitter").otherwise("web").alias("platform"))
    return pf.profile(members, d.select("doc_id", "text"), vectors, manifest, textual.LIST).select("dataset_id", *COLUMNS)


@query("profile", _profile_sql())
def profile(spark, sf):
    """All base descriptors, the frequency slope and two landmarks of every source."""
    p = profile_rows(spark, sf)
    return rounded(p, *[c for c, t in p.dtypes if t == "double"])


_GROUP = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(c) for c in cols)}) THEN '{g}'" for g, cols in mx.BASE_GROUPS.items()) + " END"


@query("profile_matrix", f"""
WITH pr AS ({_profile_sql()}),
wide AS (SELECT dataset_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in COLUMNS)} FROM pr),
xl AS (SELECT dataset_id, feature, value FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(COLUMNS)}))),
kept AS (SELECT feature, median(value) AS med FROM xl GROUP BY 1 HAVING count(DISTINCT value) > 1)
SELECT dataset_id, feature, CASE WHEN {_GROUP} IS NOT NULL THEN 'base' ELSE 'new' END AS origin, coalesce({_GROUP}, split_part(feature, '_', 1)) AS grp,
       round(coalesce(value, med), 6) + 0 AS value, value IS NULL AS imputed FROM xl JOIN kept USING (feature)""")
def profile_matrix(spark, sf):
    """The profile as a clean matrix: constant columns gone, missing cells imputed."""
    x = mx.impute(mx.drop_constant(mx.to_long(profile_rows(spark, sf))))
    cat = mx.catalogue(x.select("feature").distinct())
    return rounded(x.join(cat, "feature").select("dataset_id", "feature", "origin", "grp", "value", "imputed"), "value")


# ---------------------------------------------------------------- one corpus in two spaces: documents that have a vector

VDOCS_SQL = f"""
docs AS (SELECT {CORPUS_SQL} AS dataset_id, doc_id, text, lang AS label FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang IS NOT NULL)"""


def _both(name, space="'text' AS space", key="dataset_id"):
    """A registered twin on the documents with vectors; ``key`` names the corpus in ``points``."""
    points = VDOCS_SQL + f""",
points AS (SELECT {key} AS dataset_id, {space}, doc_id, docs.label, CAST(embedding AS DOUBLE[]) AS v FROM docs JOIN embeddings ON vec_id = doc_id)"""
    return "(" + SQL[name].replace(b.DOCS_SQL.strip(), VDOCS_SQL.strip()).replace(b.POINTS_SQL.strip(), points.strip()) + ")"


def two_spaces(spark, sf):
    """(docs, points) of the same documents: texts, and their vectors."""
    d = b.table(spark, sf, "documents").filter("lang is not null").select(corpus().alias("dataset_id"), "doc_id", "text", F.col("lang").alias("label"))
    v = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    both = d.join(v, "doc_id").persist()
    return both.drop("v"), both.select("dataset_id", F.lit("text").alias("space"), "doc_id", "label", "v")


@query("kdn_gap_tfidf_dense", f"""
SELECT dataset_id, {textual.rd('s.kdn', 'kdn_tfidf')}, {textual.rd('d.kdn', 'kdn_dense')}, round(s.kdn - d.kdn, 5) + 0 AS kdn_gap
FROM {_both("kdn_tfidf")} s JOIN {_both("kdn")} d USING (dataset_id)""")
def kdn_gap_tfidf_dense(spark, sf):
    """Disagreeing neighbours among TF-IDF rows against those among vectors."""
    docs, points = two_spaces(spark, sf)
    sparse = vec.kdn(vec.same_label_counts(vec.knn_sparse(vec.tfidf(docs), docs, 5), ["dataset_id"]), ["dataset_id"])
    dense = vec.kdn(vec.same_label_counts(vec.knn(points)), ["dataset_id"])
    j = sparse.select("dataset_id", F.col("kdn").alias("kdn_tfidf")).join(dense.select("dataset_id", F.col("kdn").alias("kdn_dense")), "dataset_id")
    j = rounded(j, "kdn_tfidf", "kdn_dense")
    return rounded(j.withColumn("kdn_gap", F.col("kdn_tfidf") - F.col("kdn_dense")), "kdn_gap", digits=5)


_LM_DENSE = _both("nc_dense_cv", "dataset_id AS space", "'vec'")


@query("landmark_gap_dense_tfidf", f"""
SELECT s.dataset_id, s.f1 AS lm_nc_tfidf, d.f1 AS lm_nc_dense, round(d.f1 - s.f1, 5) + 0 AS lm_nc_gap
FROM {_both("nc_tfidf_cv")} s JOIN {_LM_DENSE} d ON d.space = s.dataset_id""")
def landmark_gap_dense_tfidf(spark, sf):
    """Nearest centroid on vectors against nearest centroid on TF-IDF rows, on the same folds."""
    docs, points = two_spaces(spark, sf)
    sparse = rounded(lm.nc_tfidf_cv(docs), "f1").withColumnRenamed("f1", "lm_nc_tfidf")
    dense = rounded(lm.nc_dense_cv(points), "f1").select("dataset_id", F.col("f1").alias("lm_nc_dense"))
    return rounded(sparse.join(dense, "dataset_id").withColumn("lm_nc_gap", F.col("lm_nc_dense") - F.col("lm_nc_tfidf")), "lm_nc_gap", digits=5)
