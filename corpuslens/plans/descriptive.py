"""Tests, descriptor matrix and descriptor analysis over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import stats as st
from corpuslens.operators import analysis as an
from corpuslens.operators import matrix as mx
from corpuslens.operators import rank as rk
from corpuslens.plans.ranking import R_SQL, SIGNED_RANK_SQL
from corpuslens.plans.registry import cte, query, rounded
from corpuslens.plans.textual import rd
from corpuslens.sources import bindings as b

# ---------------------------------------------------------------- tests


def treatments(spark, sf):
    """Methods as treatments, corpora as blocks."""
    return b.performance(b.scores(spark, sf)).select(
        "dataset_id", F.col("algorithm").alias("treatment"), "value")


@query("wilcoxon_exact", cte(R_SQL, SIGNED_RANK_SQL, select=f"""
SELECT dataset_id, alg_i, alg_j, n, CAST(w_pos AS DOUBLE) AS w_pos, CAST(w_neg AS DOUBLE) AS w_neg, {rd('p', 'p')} FROM tests"""))
def wilcoxon_exact(spark, sf):
    s = b.scores(spark, sf).select("dataset_id", "fold", "algorithm", "value")
    a = s.withColumnsRenamed({"algorithm": "alg_i", "value": "vi"})
    c = s.withColumnsRenamed({"algorithm": "alg_j", "value": "vj"})
    d = a.join(c, ["dataset_id", "fold"]).filter("alg_i <> alg_j").withColumn(
        "d", F.round(F.col("vi") - F.col("vj"), 9))
    t = st.paired_signed_rank(d, ["dataset_id", "alg_i", "alg_j"], "d")
    return rounded(t.select("dataset_id", "alg_i", "alg_j", "n", "w_pos", "w_neg", "p"), "p")


# normal tail by its power series with gamma functions; chi-square tail likewise
NORMAL = """(1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * k + 1) * ln(z) - ((k + 1) * ln(2)
  + lgamma(k + 1.5) - 0.5 * ln(pi())))) FROM range(0, 200) t(k)))"""
VSBASE_SQL = R_SQL + """,
df AS (
  SELECT x.algorithm AS treatment, x.dataset_id, x.value - y.value AS d
  FROM p x JOIN p y ON x.dataset_id = y.dataset_id AND y.algorithm = 'click' AND x.algorithm <> 'click'
),
sg AS (
  SELECT *, rank() OVER (PARTITION BY treatment ORDER BY abs(d))
         + (count(*) OVER (PARTITION BY treatment, abs(d)) - 1) / 2.0 AS rk,
         count(*) OVER (PARTITION BY treatment, abs(d)) AS t FROM df WHERE d <> 0
),
zz AS (
  SELECT treatment, count(*) AS n, abs((least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END))
         - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0
         - sum(t * t - 1) / 48.0)) AS z FROM sg GROUP BY 1
),
vs AS (
  SELECT treatment, avg(d) AS mean_d, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
         CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ties,
         CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM df GROUP BY 1
)"""


@query("wilcoxon_vs_base", cte(VSBASE_SQL, select=f"""
SELECT treatment, {rd('mean_d', 'mean_d')}, wins, ties, losses, {rd(NORMAL, 'p')} FROM vs JOIN zz USING (treatment)"""))
def wilcoxon_vs_base(spark, sf):
    t = treatments(spark, sf)
    base = t.filter("treatment = 'click'").select("dataset_id", F.col("value").alias("base"))
    d = t.filter("treatment <> 'click'").join(base, "dataset_id").withColumn("d", F.col("value") - F.col("base"))
    w = st.signed_rank_normal(d, ["treatment"], "d")
    return rounded(w.select("treatment", "mean_d", "wins", "ties", "losses", "p"), "mean_d", "p")


MEAN_SQL = R_SQL + """,
mr AS (SELECT algorithm AS treatment, avg(rank) AS mean_rank FROM r GROUP BY 1)"""


@query("mean_ranks", cte(MEAN_SQL, select=f"SELECT treatment, {rd('mean_rank', 'mean_rank')} FROM mr"))
def mean_ranks(spark, sf):
    return rounded(st.mean_ranks(treatments(spark, sf)), "mean_rank")


FRIED_SQL = R_SQL + """,
tie AS (SELECT sum(pow(c, 3) - c) AS tie FROM (SELECT count(*) AS c FROM r GROUP BY dataset_id, value)),
s AS (SELECT sum(rank) AS s, count(*) AS n FROM r GROUP BY algorithm),
f0 AS (SELECT count(*) AS k, max(n) AS n, sum(s * s) AS ss FROM s),
f AS (
  SELECT k, n, (12.0 / (k * n * (k + 1)) * ss - 3.0 * n * (k + 1)) / (1 - tie / (n * k * (k * k - 1.0))) AS chi2, k - 1 AS df
  FROM f0, tie
)"""


@query("friedman", cte(FRIED_SQL, select=f"""
SELECT k, n, {rd('chi2', 'chi2')}, df, {rd('''1 - (SELECT sum(exp((df / 2.0 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(df / 2.0 + i + 1)))
  FROM range(0, 300) t(i))''', 'p')} FROM f"""))
def friedman(spark, sf):
    return rounded(st.friedman(treatments(spark, sf)), "chi2", "p")


CD_SQL = MEAN_SQL + """,
cd AS (SELECT count(DISTINCT algorithm) AS k, count(DISTINCT dataset_id) AS n, 2.728::DOUBLE AS q,
       2.728 * sqrt(count(DISTINCT algorithm) * (count(DISTINCT algorithm) + 1) / (6.0 * count(DISTINCT dataset_id))) AS cd FROM r)"""


@query("nemenyi_cd", cte(CD_SQL, select=f"SELECT k, n, q, {rd('cd', 'cd')} FROM cd"))
def nemenyi_cd(spark, sf):
    return rounded(st.nemenyi_cd(treatments(spark, sf)), "cd")


@query("sig_pairs", cte(CD_SQL, select=f"""
SELECT a.treatment AS a, b.treatment AS b, {rd('abs(a.mean_rank - b.mean_rank)', 'diff')},
       abs(a.mean_rank - b.mean_rank) >= cd AS significant FROM mr a JOIN mr b ON a.treatment < b.treatment, cd"""))
def sig_pairs(spark, sf):
    t = treatments(spark, sf)
    return rounded(st.significant_pairs(st.mean_ranks(t), st.nemenyi_cd(t)).select("a", "b", "diff", "significant"), "diff")


@query("cliques", cte(CD_SQL, """
ps AS (SELECT *, row_number() OVER (ORDER BY mean_rank, treatment) AS pos FROM mr),
runs AS (SELECT x.pos AS first, max(y.pos) AS last FROM ps x JOIN ps y ON y.pos >= x.pos, cd
         WHERE y.pos = x.pos OR y.mean_rank - x.mean_rank < cd GROUP BY 1)""", select="""
SELECT CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, x.treatment AS best, y.treatment AS worst
FROM runs r JOIN ps x ON x.pos = first JOIN ps y ON y.pos = last
WHERE last > first AND NOT EXISTS (SELECT 1 FROM runs o WHERE o.first <= r.first AND o.last >= r.last
  AND (o.first, o.last) <> (r.first, r.last))"""))
def cliques(spark, sf):
    t = treatments(spark, sf)
    return st.cliques(st.mean_ranks(t), st.nemenyi_cd(t))


# ---------------------------------------------------------------- descriptor matrix
# columns: the mean of two-decimal values is taken over whole cents, as for the scores

BASE = ["n_instances", "log_instances", "majority_pct", "class_entropy", "mean_doc_len_chars", "std_doc_len_words"]
NEW = ["tok_mean_k", "tok_max_k", "lm_error_mean", "lm_click_mean", "lc_view_mean", "cx_p90", "hl_share_error",
       "ch_const", "ih_gap"]
GROUPS = {
    "simple": ["n_instances", "log_instances"],
    "balance": ["majority_pct", "class_entropy"],
    "lexical": ["mean_doc_len_chars", "std_doc_len_words"],
}


def descriptors(spark, sf):
    """Wide descriptor matrix of the event corpora, with one constant column and
    two missing cells."""
    e = b.table(spark, sf, "events").select(b.corpus_id().alias("dataset_id"), "event_type", "value",
                                            F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("k"))
    cents = F.round(F.col("value") * 100).cast("long")

    def mean(cond=None):
        c = cents if cond is None else F.when(cond, cents)
        return F.sum(c) / (F.count(c) * F.lit(100.0))
    kind = F.col("event_type")
    per = e.groupBy("dataset_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_instances"), F.log10(F.count(F.lit(1))).alias("log_instances"),
        mean().alias("mean_doc_len_chars"), F.stddev_pop("value").alias("std_doc_len_words"),
        (F.sum("k") / F.count("k")).alias("tok_mean_k"), F.max("k").alias("tok_max_k"),
        mean(kind == "error").alias("lm_error_mean"), mean(kind == "click").alias("lm_click_mean"),
        mean(kind == "view").alias("lc_view_mean"), F.percentile("value", F.lit(0.9)).alias("cx_p90"),
        (F.sum((kind == "error").cast("int")) / F.count(F.lit(1))).alias("hl_share_error"))
    cls = e.groupBy("dataset_id", "event_type").agg(F.count(F.lit(1)).alias("c")).groupBy("dataset_id").agg(
        (F.max("c") / F.sum("c")).alias("majority_pct"),
        (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("class_entropy"))
    j = mx.assemble([per, cls])
    return j.withColumn("ch_const", F.lit(1.0)).withColumn(
        "ih_gap", F.when(F.col("dataset_id").isin("c03", "c07"), F.lit(None)).otherwise(
            F.col("tok_max_k") - F.col("tok_mean_k"))).select("dataset_id", *BASE, *NEW)


def _m(kind=None):
    f = f" FILTER (WHERE event_type = '{kind}')" if kind else ""
    return f"CAST(sum(CAST(round(value * 100) AS BIGINT)){f} AS DOUBLE) / (count(value){f} * 100::DOUBLE)"


X_SQL = f"""
ev AS (SELECT {b.CORPUS_ID_SQL} AS dataset_id, event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k FROM events),
per AS (
  SELECT dataset_id, CAST(count(*) AS DOUBLE) AS n_instances, log10(count(*)) AS log_instances,
         {_m()} AS mean_doc_len_chars, stddev_pop(value) AS std_doc_len_words, sum(k) / count(k) AS tok_mean_k, max(k) AS tok_max_k,
         {_m('error')} AS lm_error_mean, {_m('click')} AS lm_click_mean, {_m('view')} AS lc_view_mean,
         quantile_cont(value, 0.9) AS cx_p90, count(*) FILTER (WHERE event_type = 'error') / count(*) AS hl_share_error
  FROM ev GROUP BY 1
),
clc AS (SELECT dataset_id, event_type, count(*) AS c FROM ev GROUP BY ALL),
cls AS (SELECT dataset_id, max(p) AS majority_pct, -sum(p * log2(p)) AS class_entropy
        FROM (SELECT *, c / sum(c) OVER (PARTITION BY dataset_id) AS p FROM clc) GROUP BY 1),
x AS (SELECT dataset_id, {", ".join(BASE)}, {", ".join(c for c in NEW if c not in ("ch_const", "ih_gap"))}, 1.0::DOUBLE AS ch_const,
      CASE WHEN dataset_id IN ('c03', 'c07') THEN NULL ELSE tok_max_k - tok_mean_k END AS ih_gap
      FROM per JOIN cls USING (dataset_id)),
xl AS (SELECT dataset_id, feature, value FROM x UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(BASE + NEW)}))),
med AS (SELECT feature, median(value) AS med FROM xl GROUP BY 1),
xi AS (SELECT dataset_id, feature, coalesce(value, med) AS value, value IS NULL AS imputed FROM xl JOIN med USING (feature)),
kept AS (SELECT feature FROM xl GROUP BY 1 HAVING count(DISTINCT value) > 1),
xk AS (SELECT * FROM xi SEMI JOIN kept USING (feature)),
cat AS (
  SELECT feature, CASE WHEN feature IN ({", ".join(f"'{c}'" for c in BASE)}) THEN 'base' ELSE 'new' END AS origin,
         CASE {" ".join(f"WHEN feature IN ({', '.join(repr(c) for c in cols)}) THEN '{g}'" for g, cols in GROUPS.items())}
         ELSE split_part(feature, '_', 1) END AS grp
  FROM (SELECT DISTINCT feature FROM xl)
)"""


def clean_long(spark, sf):
    """Imputed, without constant columns; small and used by several branches."""
    x = mx.to_long(descriptors(spark, sf))
    return mx.impute(mx.drop_constant(x)).drop("imputed").persist()


def features(spark, sf):
    return mx.catalogue(clean_long(spark, sf).select("feature").distinct(), GROUPS)


@query("assemble_x", cte(X_SQL, select="SELECT dataset_id, " + ", ".join(rd(c, c) for c in BASE + NEW) + " FROM x"))
def assemble_x(spark, sf):
    return rounded(descriptors(spark, sf), *BASE, *NEW)


@query("drop_constant", cte(X_SQL, select=f"""
SELECT feature, count(DISTINCT value) > 1 AS kept, {rd('CASE WHEN count(DISTINCT value) <= 1 THEN min(value) END', 'constant_value')}
FROM xl GROUP BY 1"""))
def drop_constant(spark, sf):
    return rounded(mx.constant_columns(mx.to_long(descriptors(spark, sf))), "constant_value")


@query("impute", cte(X_SQL, select=f"SELECT dataset_id, feature, {rd('value', 'value')}, imputed FROM xi"))
def impute(spark, sf):
    return rounded(mx.impute(mx.to_long(descriptors(spark, sf))), "value")


@query("extend", cte(X_SQL, select=f"""
SELECT dataset_id, {rd('n_instances', 'n_instances')}, {rd('tok_max_k', 'tok_max_k')},
       CASE WHEN dataset_id = 'c05' THEN 'left_only' ELSE 'both' END AS status
FROM x WHERE dataset_id <> 'c05' UNION ALL
SELECT dataset_id, {rd('n_instances', 'n_instances')}, NULL, 'left_only' FROM x WHERE dataset_id = 'c05'"""))
def extend(spark, sf):
    x = descriptors(spark, sf)
    return rounded(mx.extend(x.select("dataset_id", "n_instances"),
                             x.filter("dataset_id <> 'c05'").select("dataset_id", "tok_max_k")), "n_instances", "tok_max_k")


@query("catalogue", cte(X_SQL, select="SELECT feature, origin, grp FROM cat"))
def catalogue(spark, sf):
    return mx.catalogue(mx.to_long(descriptors(spark, sf)).select("feature").distinct(), GROUPS)


@query("variants", cte(X_SQL, select="""
SELECT 'base' AS variant, feature FROM cat WHERE origin = 'base' UNION ALL SELECT 'ext', feature FROM cat
UNION ALL SELECT 'sel', feature FROM cat UNION ALL SELECT 'filt', feature FROM kept
UNION ALL SELECT 'new', feature FROM cat WHERE origin = 'new'
UNION ALL SELECT 'cheap', feature FROM cat WHERE origin = 'new' AND split_part(feature, '_', 1) IN ('tok', 'lm', 'lc')"""))
def variants(spark, sf):
    x = mx.to_long(descriptors(spark, sf))
    return mx.variants(mx.catalogue(x.select("feature").distinct(), GROUPS),
                       mx.drop_constant(x).select("feature").distinct())


@query("ranges", cte(X_SQL, select=f"""
SELECT feature, {rd('min(value)', 'min')}, {rd('median(value)', 'median')}, {rd('max(value)', 'max')} FROM xi GROUP BY 1"""))
def ranges(spark, sf):
    return rounded(mx.ranges(mx.impute(mx.to_long(descriptors(spark, sf)))), "min", "median", "max")


# ---------------------------------------------------------------- analysis

SPARSE, DENSE = ["click", "error"], ["purchase", "signup", "view"]
T_SQL = f"""
tg AS (
  SELECT dataset_id, algorithm AS target, CAST(rank AS DOUBLE) AS value FROM r
  UNION ALL SELECT dataset_id, 'best_f1', max(value) FROM r GROUP BY 1
  UNION ALL SELECT dataset_id, 'paradigm_gap', max(value) FILTER (WHERE algorithm IN ('click', 'error'))
            - max(value) FILTER (WHERE algorithm IN ('purchase', 'signup', 'view')) FROM r GROUP BY 1
)"""


def ranked(spark, sf):
    return rk.ranks(b.performance(b.scores(spark, sf)))


@query("meta_targets", cte(R_SQL, T_SQL, select=f"SELECT dataset_id, target, {rd('value', 'value')} FROM tg"))
def meta_targets(spark, sf):
    return rounded(an.meta_targets(ranked(spark, sf), SPARSE, DENSE), "value")


@query("best_method", cte(R_SQL, select="SELECT dataset_id, arg_max(algorithm, (value, -alg_ord)) AS best_algo FROM r GROUP BY 1"))
def best_method(spark, sf):
    return an.best_method(ranked(spark, sf))


AVG_RANK = ("rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0")
ASSOC_SQL = f"""
xy AS (SELECT feature, target, xk.value AS vx, tg.value AS vy FROM xk JOIN tg USING (dataset_id)),
rr AS (SELECT feature, target, {AVG_RANK.format(k='feature, target', v='vx')} AS rx,
       {AVG_RANK.format(k='feature, target', v='vy')} AS ry FROM xy),
rho AS (SELECT feature, target, count(*) AS n, CASE WHEN stddev_pop(rx) = 0 OR stddev_pop(ry) = 0 THEN NULL ELSE corr(rx, ry) END AS c
        FROM rr GROUP BY ALL),
tt AS (SELECT *, atan(abs(c) * sqrt((n - 2) / (1 - c * c)) / sqrt(n - 2)) AS th, n - 2 AS nu FROM rho),
pp AS (
  SELECT feature, target, n, coalesce(c, 0) AS rho, CASE WHEN c IS NULL THEN 1 ELSE greatest(0, 1 -
    CASE WHEN nu % 2 = 0 THEN sin(th) * (SELECT sum(pow(cos(th), 2 * j) * exp(lgamma(j + 0.5) - 0.5 * ln(pi()) - lgamma(j + 1.0)))
                                         FROM range(0, 200) t(j) WHERE j <= nu / 2 - 1)
         ELSE 2 / pi() * (th + sin(th) * (SELECT sum(pow(cos(th), 2 * j + 1) * exp(0.5 * ln(pi()) + lgamma(j + 1.0) - ln(2) - lgamma(j + 1.5)))
                                         FROM range(0, 200) t(j) WHERE j <= (nu - 3) / 2)) END) END AS p FROM tt
)"""


@query("spearman_p", cte(R_SQL, X_SQL, T_SQL, ASSOC_SQL, select=f"SELECT feature, target, n, {rd('rho', 'rho')}, {rd('p', 'p')} FROM pp"))
def spearman_p(spark, sf):
    t = an.meta_targets(ranked(spark, sf), SPARSE, DENSE).withColumnRenamed("value", "_y")
    return rounded(st.spearman(clean_long(spark, sf).join(t, "dataset_id"), ["feature", "target"], "value", "_y"), "rho", "p")


BH_SQL = """
q0 AS (SELECT feature, target, origin, rho, p, p * count(*) OVER (PARTITION BY origin)
       / row_number() OVER (PARTITION BY origin ORDER BY p) AS raw FROM pp JOIN cat USING (feature)),
qq AS (SELECT *, greatest(0, least(1, min(raw) OVER (PARTITION BY origin ORDER BY p DESC
       RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS q FROM q0)"""
_ASSOC = f"SELECT feature, target, origin, {rd('rho', 'rho')}, {rd('p', 'p')}, {rd('q', 'q')} FROM qq"


def _association(spark, sf):
    t = an.meta_targets(ranked(spark, sf), SPARSE, DENSE)
    return an.association(clean_long(spark, sf), t, features(spark, sf))


@query("association", cte(R_SQL, X_SQL, T_SQL, ASSOC_SQL, BH_SQL, select=_ASSOC))
def association(spark, sf):
    return rounded(_association(spark, sf), "rho", "p", "q")


@query("bh_fdr", cte(R_SQL, X_SQL, T_SQL, ASSOC_SQL, BH_SQL, select=f"SELECT feature, target, {rd('q', 'q')} FROM qq"))
def bh_fdr(spark, sf):
    return rounded(_association(spark, sf).select("feature", "target", "q"), "q")


MATRIX_SQL = f"""
xr AS (SELECT dataset_id, feature, {AVG_RANK.format(k='feature', v='value')} AS rk FROM xk),
mat AS (SELECT a.feature AS f, b.feature AS g, corr(a.rk, b.rk) AS rho FROM xr a JOIN xr b USING (dataset_id)
        WHERE a.feature < b.feature GROUP BY ALL),
sym AS (SELECT f, g, abs(rho) AS rho FROM mat UNION ALL SELECT g, f, abs(rho) FROM mat)"""


def matrix(spark, sf):
    """Ranks of values rounded to 9 digits: equal columns then tie exactly."""
    return st.spearman_matrix(clean_long(spark, sf)).persist()


@query("spearman_matrix", cte(X_SQL, MATRIX_SQL, select=f"SELECT f, g, {rd('rho', 'rho')} FROM mat"))
def spearman_matrix(spark, sf):
    return rounded(matrix(spark, sf), "rho")


@query("max_corr", cte(X_SQL, MATRIX_SQL, select=f"""
SELECT f AS feature, {rd("max(rho) FILTER (WHERE b.origin = 'base')", 'max_abs_rho_base')},
       arg_min(g, (-round(rho, 12), g)) FILTER (WHERE b.origin = 'base') AS max_abs_rho_base_feature,
       {rd("max(rho) FILTER (WHERE b.origin = 'new')", 'max_abs_rho_new')}
FROM sym JOIN cat a ON a.feature = f JOIN cat b ON b.feature = g WHERE a.origin = 'new' GROUP BY 1"""))
def max_corr(spark, sf):
    return rounded(an.max_correlation(matrix(spark, sf), features(spark, sf)), "max_abs_rho_base", "max_abs_rho_new")


CUT = 0.6  # the event descriptors are weakly related; a wider cut gives clusters to look at


def clusters(spark, sf):
    cat = features(spark, sf)
    return an.linkage_clusters(matrix(spark, sf), cat.select("feature"), CUT), cat


# one merge a step: the two clusters of the smallest mean distance, the first by name among equals
LINK_SQL = f"""
dist AS MATERIALIZED (SELECT f, g, greatest(0, 1 - rho) AS d FROM sym),
merged AS (
  WITH RECURSIVE w(it, feature, c) AS (
    SELECT 0, feature, feature FROM (SELECT DISTINCT feature FROM xk)
    UNION ALL
    SELECT w.it + 1, w.feature, CASE WHEN w.c = m.hi THEN m.lo ELSE w.c END FROM w
    JOIN (SELECT arg_min(a, (d, a, b)) AS lo, arg_min(b, (d, a, b)) AS hi, min(d) AS d FROM (
      SELECT x.c AS a, y.c AS b, avg(dist.d) AS d FROM w x JOIN dist ON dist.f = x.feature JOIN w y ON dist.g = y.feature
      WHERE x.c < y.c GROUP BY ALL)) m ON m.d <= {CUT}
  )
  SELECT * FROM w WHERE it = (SELECT max(it) FROM w)
),
clus AS (SELECT feature, CAST(dense_rank() OVER (ORDER BY c) AS INTEGER) AS cluster_id FROM merged)"""


@query("linkage_clusters", cte(X_SQL, MATRIX_SQL, LINK_SQL, select="SELECT feature, cluster_id FROM clus"))
def linkage_clusters(spark, sf):
    return clusters(spark, sf)[0]


@query("cluster_summary", cte(X_SQL, MATRIX_SQL, LINK_SQL, """
comp AS (SELECT cluster_id, count(*) FILTER (WHERE origin = 'base') AS nb, count(*) FILTER (WHERE origin = 'new') AS nn FROM clus JOIN cat USING (feature) GROUP BY 1),
top AS (SELECT f, max(rho) FILTER (WHERE b.origin = 'base') AS r FROM sym JOIN cat a ON a.feature = f JOIN cat b ON b.feature = g WHERE a.origin = 'new' GROUP BY 1)""", select="""
SELECT count(*) AS n_clusters, count(*) FILTER (WHERE nn = 0) AS n_base_only, count(*) FILTER (WHERE nb = 0) AS n_new_only,
       count(*) FILTER (WHERE nb > 0 AND nn > 0) AS n_mixed, (SELECT avg(CASE WHEN r >= 0.7 THEN 1 ELSE 0 END) FROM top) AS frac_ge_07,
       (SELECT avg(CASE WHEN r >= 0.9 THEN 1 ELSE 0 END) FROM top) AS frac_ge_09 FROM comp"""))
def cluster_summary(spark, sf):
    c, cat = clusters(spark, sf)
    return an.cluster_summary(an.composition(c, cat), an.max_correlation(matrix(spark, sf), cat))


COST_SQL = f"""
cost AS (
  SELECT {b.CORPUS_ID_SQL} AS dataset_id, CASE event_type WHEN 'click' THEN 'base_text' WHEN 'error' THEN 'base_balance'
         WHEN 'purchase' THEN 'lm' WHEN 'signup' THEN 'shared_knn' ELSE 'tok' END AS grp, {_m()} AS seconds
  FROM events GROUP BY ALL
)"""


def cost(spark, sf):
    e = b.table(spark, sf, "events")
    names = {"click": "base_text", "error": "base_balance", "purchase": "lm", "signup": "shared_knn", "view": "tok"}
    g = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.col("event_type")]
    cents = F.round(F.col("value") * 100).cast("long")
    return e.groupBy(b.corpus_id().alias("dataset_id"), g.alias("grp")).agg(
        (F.sum(cents) / (F.count(cents) * F.lit(100.0))).alias("seconds"))


def selection(spark, sf):
    c, cat = clusters(spark, sf)
    return an.representatives(c, matrix(spark, sf), cat, an.group_cost(cost(spark, sf)))


REPR_SQL = """
gc AS (SELECT grp, avg(seconds) AS sec FROM cost GROUP BY 1),
mr AS (SELECT c.feature, avg(rho) AS m FROM clus c JOIN clus o ON o.cluster_id = c.cluster_id JOIN sym ON f = c.feature AND g = o.feature GROUP BY 1),
rp AS (SELECT cluster_id, feature, origin, count(*) OVER z AS size, max(CASE WHEN origin = 'base' THEN 1 ELSE 0 END) OVER z AS base,
       row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN origin = 'base' THEN 0 ELSE 1 END,
         CASE WHEN origin = 'base' THEN 0 ELSE coalesce(sec, 'inf'::DOUBLE) END, round(m, 12) DESC NULLS LAST, feature) = 1 AS kept
       FROM clus JOIN cat USING (feature) LEFT JOIN gc USING (grp) LEFT JOIN mr USING (feature) WINDOW z AS (PARTITION BY cluster_id)),
sel AS (SELECT cluster_id, feature, origin, kept, CASE WHEN NOT kept THEN 'dropped_redundant_in_cluster' WHEN size = 1 THEN 'singleton_cluster'
       WHEN base = 1 THEN 'cluster_representative_base_medoid' ELSE 'cluster_representative_new_lowest_cost' END AS reason FROM rp)"""
# the kept ones in order; each goes if it nearly equals one that stays before it
DROP_SQL = """
ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cluster_id, feature) AS k, feature FROM sel WHERE kept),
walk AS (
  WITH RECURSIVE s(k, stay, feature, dup) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
    UNION ALL
    SELECT o.k, CASE WHEN o.dup IS NULL THEN list_append(o.stay, o.feature) ELSE o.stay END, o.feature, o.dup FROM (
      SELECT ord.k, s.stay, ord.feature, list_filter(s.stay, lambda x: list_contains(near.l, x))[1] AS dup
      FROM s JOIN ord ON ord.k = s.k + 1 LEFT JOIN (SELECT f, list(g) AS l FROM sym WHERE rho >= 0.5 GROUP BY 1) near ON near.f = ord.feature) o
  )
  SELECT feature, dup FROM s WHERE dup IS NOT NULL
)"""


@query("representatives", cte(X_SQL, MATRIX_SQL, LINK_SQL, COST_SQL, REPR_SQL, select="SELECT * FROM sel"))
def representatives(spark, sf):
    return selection(spark, sf)


@query("near_dup_drop", cte(X_SQL, MATRIX_SQL, LINK_SQL, COST_SQL, REPR_SQL, DROP_SQL, select="""
SELECT cluster_id, feature, origin, kept AND dup IS NULL AS kept, CASE WHEN dup IS NOT NULL THEN 'dropped_duplicate_ge_0.5_of_' || dup ELSE reason END AS reason
FROM sel LEFT JOIN walk USING (feature)"""))
def near_dup_drop(spark, sf):
    return an.drop_near_duplicates(selection(spark, sf), matrix(spark, sf), at=0.5)


@query("slowest", cte(COST_SQL, select=f"""
SELECT dataset_id, grp, {rd('seconds', 'seconds')} FROM cost ORDER BY cost.seconds DESC, dataset_id, grp LIMIT 10"""))
def slowest(spark, sf):
    return rounded(mx.slowest(cost(spark, sf)), "seconds")


@query("cost_by_group", cte(X_SQL, COST_SQL, """
mp(grp, cg) AS (VALUES ('base_text', 'lexical'), ('base_text', 'social_media'), ('base_balance', 'simple'),
  ('base_balance', 'balance'), ('lm', 'lm'), ('tok', 'tok')),
nf AS (SELECT mp.grp, count(feature) AS n_features, array_to_string(list_sort(list_distinct(list(origin))), '+') AS o
       FROM mp LEFT JOIN cat ON cat.grp = cg GROUP BY 1),
tot AS (SELECT grp, sum(seconds) AS t FROM cost GROUP BY 1),
nd AS (SELECT count(DISTINCT dataset_id) AS n FROM cost)""", select=f"""
SELECT grp, CASE WHEN o IS NOT NULL AND o <> '' THEN o WHEN starts_with(grp, 'base_') THEN 'base' ELSE 'new' END AS origin,
       coalesce(n_features, 0) AS n_features, {rd('t', 'total_seconds')}, {rd('t / n', 'mean_seconds_per_dataset')},
       {rd('CASE WHEN n_features > 0 THEN t / n / n_features END', 'seconds_per_feature')}
FROM tot LEFT JOIN nf USING (grp), nd"""))
def cost_by_group(spark, sf):
    cat = mx.catalogue(mx.to_long(descriptors(spark, sf)).select("feature").distinct(), GROUPS)
    return rounded(an.cost_by_group(cost(spark, sf), cat), "total_seconds", "mean_seconds_per_dataset", "seconds_per_feature")


# ---------------------------------------------------------------- panel tables

@query("folds_to_p", cte(b.P_SQL, select="SELECT dataset_id, " + ", ".join(
    rd(f"max(value) FILTER (WHERE algorithm = '{a}')", a) for a in SPARSE + DENSE) + " FROM p GROUP BY 1"))
def folds_to_p(spark, sf):
    from corpuslens.operators.panel import to_wide
    return rounded(to_wide(b.scores(spark, sf), SPARSE + DENSE), *SPARSE, *DENSE)


@query("panel_report", cte(R_SQL, b.GROUPS_SQL, """
m AS (SELECT r.*, CASE WHEN grp IN ('g0', 'g1', 'g2') THEN 1 ELSE 0 END AS flag FROM r JOIN grps USING (dataset_id))""", select=f"""
SELECT algorithm, {rd('avg(value)', 'mean_score')}, {rd('avg(rank)', 'mean_rank')},
       {rd('avg(value) FILTER (WHERE flag = 1)', 'mean_flagged')}, {rd('avg(value) FILTER (WHERE flag = 0)', 'mean_other')}
FROM m GROUP BY 1"""))
def panel_report(spark, sf):
    from corpuslens.operators.panel import panel_report as op
    flags = b.groups(spark, sf).select("dataset_id", F.col("grp").isin("g0", "g1", "g2").alias("flag"))
    return rounded(op(ranked(spark, sf), flags), "mean_score", "mean_rank", "mean_flagged", "mean_other")


@query("panel_gap", cte(R_SQL, """
top2 AS (SELECT dataset_id, value, row_number() OVER (PARTITION BY dataset_id ORDER BY value DESC) AS rn FROM r),
gaps AS (SELECT dataset_id, max(value) - min(value) AS gap FROM top2 WHERE rn <= 2 GROUP BY 1)""", select=f"""
SELECT {rd('median(gap)', 'median_gap')}, {rd('avg(gap)', 'mean_gap')}, {rd('min(gap)', 'min_gap')}, {rd('max(gap)', 'max_gap')} FROM gaps"""))
def panel_gap(spark, sf):
    from corpuslens.operators.panel import best_gap
    return rounded(best_gap(ranked(spark, sf)), "median_gap", "mean_gap", "min_gap", "max_gap")


@query("folds_check", cte(b.P_SQL, """
mm AS (SELECT dataset_id, algorithm, sum(value) / count(value) AS m, count(*) AS c, count(*) FILTER (WHERE value IS NULL) AS z FROM scores GROUP BY ALL)""", select="""
SELECT dataset_id, CAST(sum(c) AS BIGINT) AS n_cells, CAST(sum(z) AS BIGINT) AS n_null, bool_and(abs(m - value) <= 1e-12) AS mean_ok
FROM mm JOIN p USING (dataset_id, algorithm) GROUP BY 1"""))
def folds_check(spark, sf):
    from corpuslens.operators.panel import check_folds
    s = b.scores(spark, sf)
    return check_folds(s, b.performance(s))
