"""Vector and complexity descriptors over the embeddings and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import complexity as cx
from corpuslens.operators import vectors as vec
from corpuslens.plans.registry import cte, query, rounded
from corpuslens.plans.textual import TERMS, rd
from corpuslens.sources import bindings as b

PAIRS_SQL = b.POINTS_SQL + """,
pairs AS (
  SELECT x.dataset_id, x.space, x.doc_id, x.label, y.doc_id AS nbr, y.label AS nbr_label,
         round(greatest(1 - list_cosine_similarity(x.v, y.v), 0), 10) AS cos_d,
         round(list_distance(x.v, y.v), 10) AS euc_d
  FROM points x JOIN points y ON x.dataset_id = y.dataset_id AND x.space = y.space AND x.doc_id <> y.doc_id
)"""
KNN_SQL = PAIRS_SQL + """,
knn AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, space, doc_id ORDER BY cos_d, nbr) AS pos FROM pairs
),
same AS (
  SELECT dataset_id, space, doc_id, label, count(*) AS k,
         sum(CASE WHEN label = nbr_label THEN 1 ELSE 0 END) AS same
  FROM knn WHERE pos <= 5 GROUP BY ALL
)"""


@query("embedding_source", cte(b.POINTS_SQL, select=f"""
SELECT space, doc_id, label, CAST(len(v) AS INTEGER) AS dims, {rd('list_sum(v)', 'total')} FROM points"""))
def embedding_source(spark, sf):
    return rounded(b.points(spark, sf).select(
        "space", "doc_id", "label", F.size("v").alias("dims"),
        F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


@query("unit_vectors", cte(b.POINTS_SQL, """
u AS (SELECT space, doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM points)""", select=f"""
SELECT space, doc_id, {rd('v[1] / greatest(n, 1e-12)', 'first')}, {rd('v[-1] / greatest(n, 1e-12)', 'last')},
       {rd('n / greatest(n, 1e-12)', 'norm')} FROM u"""))
def unit_vectors(spark, sf):
    u = vec.unit_points(b.points(spark, sf))
    return rounded(u.select("space", "doc_id", F.element_at("v", 1).alias("first"),
                            F.element_at("v", -1).alias("last"), vec.norm(F.col("v")).alias("norm")),
                   "first", "last", "norm")


TFIDF_SQL = b.DOCS_SQL + f""",
tf AS (SELECT dataset_id, doc_id, label, term, count(*) AS tf FROM (
  SELECT dataset_id, doc_id, label, unnest({TERMS}) AS term FROM docs) GROUP BY ALL),
df AS (SELECT dataset_id, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2),
dn AS (SELECT dataset_id, count(*) AS n FROM docs GROUP BY 1),
w0 AS (SELECT tf.*, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w0
       FROM tf JOIN df USING (dataset_id, term) JOIN dn USING (dataset_id)),
w AS (SELECT dataset_id, doc_id, label, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY dataset_id, doc_id)) AS w FROM w0)"""


@query("tfidf", cte(TFIDF_SQL, select=f"""
SELECT dataset_id, term, count(*) AS df, {rd('sum(w)', 'total')}, {rd('max(w)', 'top')} FROM w GROUP BY ALL"""))
def tfidf(spark, sf):
    return rounded(vec.tfidf(b.docs(spark, sf)).groupBy("dataset_id", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("w").alias("total"), F.max("w").alias("top")), "total", "top")


def _profile_sql(col):
    return cte(PAIRS_SQL, select=f"""
SELECT space, doc_id, count(*) AS n, {rd(f'avg({col})', 'mean')}, {rd(f'min({col})', 'nearest')},
       {rd(f'max({col})', 'farthest')} FROM pairs GROUP BY ALL""")


@query("pair_dist_cosine", _profile_sql("cos_d"))
def pair_dist_cosine(spark, sf):
    return rounded(vec.distance_profile(b.points(spark, sf), "cosine").drop("dataset_id"), "mean", "nearest", "farthest")


@query("pair_dist_euclid", _profile_sql("euc_d"))
def pair_dist_euclid(spark, sf):
    return rounded(vec.distance_profile(b.points(spark, sf), "euclid").drop("dataset_id"), "mean", "nearest", "farthest")


@query("knn5", cte(KNN_SQL, select=f"""
SELECT space, doc_id, nbr, CAST(pos AS INTEGER) AS pos, {rd('cos_d', 'dist')} FROM knn WHERE pos <= 5"""))
def knn5(spark, sf):
    return rounded(vec.knn(b.points(spark, sf)).select("space", "doc_id", "nbr", "pos", "dist"), "dist")


TKNN_SQL = TFIDF_SQL + """,
sims AS (
  SELECT x.dataset_id, x.doc_id, y.doc_id AS nbr, sum(x.w * y.w) AS s
  FROM w x JOIN w y ON x.dataset_id = y.dataset_id AND x.term = y.term AND x.doc_id <> y.doc_id GROUP BY ALL
),
tk AS (
  SELECT x.dataset_id, x.doc_id, x.label, y.doc_id AS nbr, y.label AS nbr_label,
         round(1 - coalesce(s, 0), 10) AS dist,
         row_number() OVER (PARTITION BY x.dataset_id, x.doc_id ORDER BY round(1 - coalesce(s, 0), 10), y.doc_id) AS pos
  FROM docs x JOIN docs y ON x.dataset_id = y.dataset_id AND x.doc_id <> y.doc_id
  LEFT JOIN sims ON sims.dataset_id = x.dataset_id AND sims.doc_id = x.doc_id AND sims.nbr = y.doc_id
  QUALIFY pos <= 5
),
tsame AS (
  SELECT dataset_id, 'tfidf' AS space, doc_id, label, count(*) AS k,
         sum(CASE WHEN label = nbr_label THEN 1 ELSE 0 END) AS same FROM tk GROUP BY ALL
)"""


def tfidf_neighbours(spark, sf):
    d = b.docs(spark, sf)
    return vec.knn_sparse(vec.tfidf(d, numbered=True), d, 5, last=True)


@query("knn5_tfidf", cte(TKNN_SQL, select=f"""
SELECT dataset_id, doc_id, nbr, CAST(pos AS INTEGER) AS pos, {rd('dist', 'dist')} FROM tk"""))
def knn5_tfidf(spark, sf):
    return rounded(tfidf_neighbours(spark, sf).select("dataset_id", "doc_id", "nbr", "pos", "dist"), "dist")


_KDN = f"""
SELECT dataset_id, space, {rd('avg((k - same) / k)', 'kdn')},
       {rd('avg(CASE WHEN (k - same) / k > 0.5 THEN 1 ELSE 0 END)', 'hard_frac')}"""


@query("kdn", cte(KNN_SQL, select=_KDN + " FROM same GROUP BY ALL"))
def kdn(spark, sf):
    return rounded(vec.kdn(vec.same_label_counts(vec.knn(b.points(spark, sf)))), "kdn", "hard_frac")


@query("kdn_tfidf", cte(TKNN_SQL, select=_KDN + " FROM tsame GROUP BY ALL"))
def kdn_tfidf(spark, sf):
    s = vec.same_label_counts(tfidf_neighbours(spark, sf), ["dataset_id"]).withColumn("space", F.lit("tfidf"))
    return rounded(vec.kdn(s), "kdn", "hard_frac")


@query("kdn_gap", cte(KNN_SQL, select=f"""
SELECT dataset_id, {rd("avg(CASE WHEN space = 'half' THEN (k - same) / k END) - avg(CASE WHEN space = 'full' THEN (k - same) / k END)", 'kdn_gap')}
FROM same GROUP BY 1"""))
def kdn_gap(spark, sf):
    k = vec.kdn(vec.same_label_counts(vec.knn(b.points(spark, sf))))
    w = k.groupBy("dataset_id").pivot("space", ["full", "half"]).agg(F.first("kdn"))
    return rounded(w.select("dataset_id", (F.col("half") - F.col("full")).alias("kdn_gap")), "kdn_gap")


_SMALL = """
small AS (SELECT dataset_id, space, arg_min(label, (c, f)) AS label FROM (
  SELECT dataset_id, space, label, count(*) AS c, min(doc_id) AS f FROM {t} GROUP BY ALL) GROUP BY ALL)"""
_TYPO = """
SELECT dataset_id, space, """ + ", ".join(
    rd(f"avg(CASE WHEN same BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END)", n)
    for n, lo, hi in (("mt_safe", 4, 5), ("mt_borderline", 2, 3), ("mt_rare", 1, 1), ("mt_outlier", 0, 0)))
_MT = ["mt_safe", "mt_borderline", "mt_rare", "mt_outlier"]


@query("minority_typology", cte(KNN_SQL, _SMALL.format(t="same"),
                                select=_TYPO + " FROM same SEMI JOIN small USING (dataset_id, space, label) GROUP BY ALL"))
def minority_typology(spark, sf):
    return rounded(vec.minority_typology(vec.same_label_counts(vec.knn(b.points(spark, sf)))), *_MT)


@query("minority_typology_tfidf", cte(TKNN_SQL, _SMALL.format(t="tsame"),
                                      select=_TYPO + " FROM tsame SEMI JOIN small USING (dataset_id, space, label) GROUP BY ALL"))
def minority_typology_tfidf(spark, sf):
    s = vec.same_label_counts(tfidf_neighbours(spark, sf), ["dataset_id"]).withColumn("space", F.lit("tfidf"))
    return rounded(vec.minority_typology(s), *_MT)


@query("nn1_disagreement", cte(KNN_SQL, select=f"""
SELECT dataset_id, space, {rd('avg(CASE WHEN label <> nbr_label THEN 1 ELSE 0 END)', 'knn1_disagreement')}
FROM knn WHERE pos = 1 GROUP BY ALL"""))
def nn1_disagreement(spark, sf):
    return rounded(vec.nn1_disagreement(b.points(spark, sf)), "knn1_disagreement")


CENT_SQL = b.POINTS_SQL + """,
dims AS (SELECT dataset_id, space, doc_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM points),
cent AS (SELECT dataset_id, space, label, list(m ORDER BY dim) AS c FROM (
  SELECT dataset_id, space, label, dim, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY ALL)"""


@query("centroid_gap", cte(CENT_SQL, select=f"""
SELECT a.dataset_id, a.space, {rd('1 - avg(list_cosine_similarity(a.c, b.c))', 'centroid_cosine_gap')}
FROM cent a JOIN cent b ON a.dataset_id = b.dataset_id AND a.space = b.space AND a.label < b.label GROUP BY ALL"""))
def centroid_gap(spark, sf):
    return rounded(vec.centroid_gap(b.points(spark, sf)), "centroid_cosine_gap")


@query("silhouette", cte(PAIRS_SQL, """
md AS (SELECT dataset_id, space, doc_id, label, nbr_label, avg(cos_d) AS m FROM pairs GROUP BY ALL),
ab AS (
  SELECT dataset_id, space, doc_id, max(CASE WHEN label = nbr_label THEN m END) AS a,
         min(CASE WHEN label <> nbr_label THEN m END) AS b FROM md GROUP BY ALL
)""", select=f"""
SELECT dataset_id, space, {rd('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette_by_label')}
FROM ab GROUP BY ALL"""))
def silhouette(spark, sf):
    return rounded(vec.silhouette(b.points(spark, sf)), "silhouette_by_label")


# ---- complexity measures on the raw vectors

@query("fisher_f1", cte(CENT_SQL, """
cm AS (SELECT dataset_id, space, label, dim, avg(x) AS m, count(*) AS n FROM dims GROUP BY ALL),
gm AS (SELECT dataset_id, space, dim, avg(x) AS g FROM dims GROUP BY ALL),
num AS (SELECT dataset_id, space, dim, sum(n * (m - g) * (m - g)) AS num FROM cm JOIN gm USING (dataset_id, space, dim) GROUP BY ALL),
den AS (SELECT dataset_id, space, dim, sum((x - m) * (x - m)) AS den FROM dims JOIN cm USING (dataset_id, space, label, dim) GROUP BY ALL)""",
                        select=f"""
SELECT dataset_id, space, {rd('1 / (1 + max(CASE WHEN den > 1e-12 THEN num / den WHEN num > 1e-12 THEN 1e12 ELSE 0 END))', 'cx_f1')}
FROM num JOIN den USING (dataset_id, space, dim) GROUP BY ALL"""))
def fisher_f1(spark, sf):
    return rounded(cx.fisher_f1(b.points(spark, sf)), "cx_f1")


NEAR_SQL = PAIRS_SQL + """,
near AS (
  SELECT dataset_id, space, doc_id, min(CASE WHEN label = nbr_label THEN euc_d END) AS same,
         min(CASE WHEN label <> nbr_label THEN euc_d END) AS other, max(euc_d) AS far
  FROM pairs GROUP BY ALL
)"""


@query("n2", cte(NEAR_SQL, select=f"""
SELECT dataset_id, space, {rd('sum(same) / sum(other) / (1 + sum(same) / sum(other))', 'cx_n2')} FROM near GROUP BY ALL"""))
def n2(spark, sf):
    return rounded(cx.n2(cx.nearest_by_class(b.points(spark, sf))), "cx_n2")


@query("lsc", cte(NEAR_SQL, """
ins AS (SELECT dataset_id, space, count(*) AS c FROM pairs JOIN near USING (dataset_id, space, doc_id)
        WHERE euc_d < coalesce(other, near.far + 1) GROUP BY ALL),
own AS (SELECT dataset_id, space, count(*) AS n, sum(CASE WHEN coalesce(other, far + 1) > 0 THEN 1 ELSE 0 END) AS s FROM near GROUP BY ALL)""",
                  select=f"""
SELECT dataset_id, space, {rd('1 - (coalesce(c, 0) + s) / (n * n)', 'cx_lsc')} FROM own LEFT JOIN ins USING (dataset_id, space)"""))
def lsc(spark, sf):
    p = b.points(spark, sf)
    return rounded(cx.lsc(p, cx.nearest_by_class(p)), "cx_lsc")


# minimum spanning tree by Prim's rule, one vertex per recursion step
MST_SQL = b.POINTS_SQL + """,
prim AS (
  WITH RECURSIVE w(it, space, doc_id, best, frm, done) AS (
    SELECT 0, space, doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY space) THEN -1.0::DOUBLE ELSE 1e300::DOUBLE END,
           CAST(NULL AS BIGINT), false FROM points
    UNION ALL
    SELECT it + 1, w.space, w.doc_id,
           CASE WHEN NOT w.done AND w.doc_id <> c.cur AND e.d > 0 AND e.d < w.best THEN e.d ELSE w.best END,
           CASE WHEN NOT w.done AND w.doc_id <> c.cur AND e.d > 0 AND e.d < w.best THEN c.cur ELSE w.frm END,
           w.done OR w.doc_id = c.cur
    FROM w
    JOIN (SELECT space, arg_min(doc_id, best) AS cur FROM w WHERE NOT done GROUP BY space) c ON c.space = w.space
    JOIN (SELECT x.space, x.doc_id AS i, y.doc_id AS j, round(list_distance(x.v, y.v), 10) AS d
          FROM points x JOIN (SELECT p.* FROM points p JOIN (
            SELECT space, arg_min(doc_id, best) AS cur FROM w WHERE NOT done GROUP BY space) q
            ON p.space = q.space AND p.doc_id = q.cur) y ON x.space = y.space) e
      ON e.space = w.space AND e.i = w.doc_id
  )
  SELECT * FROM w WHERE it = (SELECT max(it) FROM w)
),
mst AS (SELECT space, doc_id AS i, frm AS j FROM prim WHERE frm IS NOT NULL)"""


@query("n1_mst", cte(MST_SQL, """
crossing AS (SELECT m.* FROM mst m JOIN points x ON x.space = m.space AND x.doc_id = i
             JOIN points y ON y.space = m.space AND y.doc_id = j WHERE x.label <> y.label),
touched AS (SELECT space, i AS doc_id FROM crossing UNION SELECT space, j FROM crossing)""", select=f"""
SELECT space, {rd('(SELECT count(*) FROM touched t WHERE t.space = p.space) / count(*)', 'cx_n1')}
FROM points p GROUP BY space"""))
def n1_mst(spark, sf):
    return rounded(cx.n1(b.points(spark, sf)).drop("dataset_id"), "cx_n1")


EPS_SQL = PAIRS_SQL + """,
eps AS (SELECT dataset_id, space, quantile_cont(euc_d, 0.15) AS eps FROM pairs WHERE doc_id < nbr GROUP BY ALL),
edges AS (SELECT dataset_id, space, doc_id AS a, nbr AS b FROM pairs JOIN eps USING (dataset_id, space)
          WHERE label = nbr_label AND euc_d <= round(eps, 10)),
sizes AS (SELECT dataset_id, space, count(*) AS n FROM points GROUP BY ALL)"""


def _graph(spark, sf):
    p = b.points(spark, sf)
    eps = cx.distance_quantile(p)
    return p, eps, *cx.graph_tiles(p, eps)


@query("eps_density", cte(EPS_SQL, select=f"""
SELECT dataset_id, space, {rd('max(eps)', 'eps')}, {rd('1 - count(a) / (max(n) * (max(n) - 1))', 'cx_density')}
FROM sizes JOIN eps USING (dataset_id, space) LEFT JOIN edges USING (dataset_id, space) GROUP BY ALL"""))
def eps_density(spark, sf):
    p, eps, _, tiles = _graph(spark, sf)
    return rounded(cx.density(p, tiles).join(eps, ["dataset_id", "space"]), "eps", "cx_density")


@query("clustering_coef", cte(EPS_SQL, """
deg AS (SELECT dataset_id, space, a, count(*) AS d FROM edges GROUP BY ALL),
tri AS (SELECT x.dataset_id, x.space, x.a, count(*) AS t FROM edges x
        JOIN edges y ON x.dataset_id = y.dataset_id AND x.space = y.space AND x.b = y.a
        JOIN edges z ON z.dataset_id = x.dataset_id AND z.space = x.space AND z.a = x.a AND z.b = y.b GROUP BY ALL),
cc AS (SELECT dataset_id, space, sum(CASE WHEN d >= 2 THEN coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) AS c
       FROM deg LEFT JOIN tri USING (dataset_id, space, a) GROUP BY ALL)""", select=f"""
SELECT dataset_id, space, {rd('1 - coalesce(c, 0) / n', 'cx_clscoef')} FROM sizes LEFT JOIN cc USING (dataset_id, space)"""))
def clustering_coef(spark, sf):
    p, _, _, tiles = _graph(spark, sf)
    return rounded(cx.clustering(p, tiles), "cx_clscoef")


# powers of A + I inside each class, the largest score 1; the classes of the largest eigenvalue hold the hubs
HUB_SQL = """
adj AS MATERIALIZED (SELECT points.dataset_id, points.space, label, a, b FROM edges JOIN points ON points.dataset_id = edges.dataset_id AND points.space = edges.space AND doc_id = a
                     UNION ALL SELECT dataset_id, space, label, doc_id, doc_id FROM points),
pw AS (
  WITH RECURSIVE h(it, dataset_id, space, label, doc_id, x, top) AS (
    SELECT 0, dataset_id, space, label, doc_id, 1.0::DOUBLE, 1.0::DOUBLE FROM points
    UNION ALL
    SELECT it, dataset_id, space, label, a, y / max(y) OVER z, max(y) OVER z FROM (
      SELECT h.it + 1 AS it, adj.dataset_id, adj.space, adj.label, adj.a, sum(h.x) AS y FROM h JOIN adj ON adj.dataset_id = h.dataset_id
        AND adj.space = h.space AND adj.b = h.doc_id WHERE h.it < 400 GROUP BY ALL) WINDOW z AS (PARTITION BY dataset_id, space, label)
  )
  SELECT * FROM h WHERE it = 400
),
cl AS (SELECT dataset_id, space, label, max(top) AS lam, sum(x) AS s FROM pw GROUP BY ALL),
lead AS (SELECT dataset_id, space, sum(s) AS s, max(lam) AS lam FROM (SELECT *, max(lam) OVER (PARTITION BY dataset_id, space) AS best FROM cl)
         WHERE lam >= best * (1 - 1e-9) GROUP BY ALL)"""


@query("hubs", cte(EPS_SQL, HUB_SQL, select=f"""
SELECT dataset_id, space, {rd('CASE WHEN lam <= 1.0 + 1e-12 THEN 1 ELSE 1 - s / n END', 'cx_hubs')} FROM sizes JOIN lead USING (dataset_id, space)"""))
def hubs(spark, sf):
    p, _, blocks, tiles = _graph(spark, sf)
    return rounded(cx.hubs(p, blocks, tiles), "cx_hubs")


@query("pca_space")
def pca_space(spark, sf):
    z = cx.pca_space(b.points(spark, sf))
    return rounded(z.select("space", "doc_id", F.size("v").alias("dims"), vec.norm(F.col("v")).alias("norm")), "norm")


@query("t_measures")
def t_measures(spark, sf):
    return rounded(cx.t_measures(cx.principal_axes(b.points(spark, sf))), "cx_t2", "cx_t3", "cx_t4")


@query("complexity")
def complexity(spark, sf):
    out = cx.complexity(b.points(spark, sf))
    return rounded(out, *[c for c in out.columns if c.startswith("cx_")])
