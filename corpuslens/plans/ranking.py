"""Ranks, recommenders and leave-one-out protocols over the fold scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpuslens.operators import protocol as pr
from corpuslens.operators import rank as rk
from corpuslens.plans.registry import cte, query, rounded
from corpuslens.sources import bindings as b

R_SQL = b.P_SQL + """,
r AS (
  SELECT *, rank() OVER (PARTITION BY dataset_id ORDER BY value DESC)
         + (count(*) OVER (PARTITION BY dataset_id, value) - 1) / 2.0 AS rank
  FROM p
)"""
LODO_SQL = b.GROUPS_SQL + """,
g AS (SELECT dataset_id, dataset_id AS grp FROM grps)"""
LOSO_SQL = b.GROUPS_SQL + """,
g AS (SELECT dataset_id, grp FROM grps)"""


def _rerank(name, agg, table="r", col="rank", sign=""):
    """Oracle form of a rank recommender: a theta join, unlike the Spark plan."""
    return f"""
{name}_m AS (
  SELECT h.dataset_id, t.algorithm, t.alg_ord, {sign}{agg}(t.{col}) AS m
  FROM g h JOIN g tg ON h.grp <> tg.grp JOIN {table} t ON t.dataset_id = tg.dataset_id
  GROUP BY ALL
),
{name} AS (
  SELECT dataset_id, algorithm, alg_ord, CAST(rank() OVER (PARTITION BY dataset_id ORDER BY m)
         + (count(*) OVER (PARTITION BY dataset_id, m) - 1) / 2.0 AS DOUBLE) AS score
  FROM {name}_m
)"""


# exact signed-rank test: subsets of 1..n counted by their sum, by bit masks
SIGNED_RANK_SQL = """
nulls AS (
  SELECT n, w, sum(c) OVER (PARTITION BY n ORDER BY w) / pow(2, n) AS p_le FROM (
    SELECT n, coalesce(list_sum(list_transform(range(0, n), lambda i:
             CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END)), 0) AS w, count(*) AS c
    FROM range(1, 11) a(n) JOIN range(0, 1024) k(m) ON m < (1 << n) GROUP BY ALL)
),
pairs AS (
  SELECT x.dataset_id, x.algorithm AS alg_i, y.algorithm AS alg_j, round(x.value - y.value, 9) AS d
  FROM scores x JOIN scores y ON x.dataset_id = y.dataset_id AND x.fold = y.fold
       AND x.algorithm <> y.algorithm
),
signed AS (
  SELECT *, rank() OVER (PARTITION BY dataset_id, alg_i, alg_j ORDER BY abs(d))
         + (count(*) OVER (PARTITION BY dataset_id, alg_i, alg_j, abs(d)) - 1) / 2.0 AS rk
  FROM pairs WHERE d <> 0
),
sums AS (
  SELECT dataset_id, alg_i, alg_j, count(*) AS n,
         sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_pos,
         sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_neg
  FROM signed GROUP BY ALL
),
tests AS (
  SELECT q.*, coalesce(s.n, 0) AS n, s.w_pos, s.w_neg,
         CASE WHEN q.max_abs <= 1e-8 THEN NULL ELSE least(1.0, 2 * u.p_le) END AS p
  FROM (SELECT dataset_id, alg_i, alg_j, avg(d) AS mean_d, max(abs(d)) AS max_abs
        FROM pairs GROUP BY ALL) q
  LEFT JOIN sums s USING (dataset_id, alg_i, alg_j)
  LEFT JOIN nulls u ON u.n = s.n AND u.w = floor(least(s.w_pos, s.w_neg))
),
wins AS (
  SELECT dataset_id, alg_i, alg_j,
         CAST(CASE WHEN p < 0.05 AND mean_d > 0 THEN 1 ELSE 0 END AS INTEGER) AS win
  FROM tests
),
wcount AS (
  SELECT dataset_id, alg_i AS algorithm, alg_ord, sum(win) AS w
  FROM wins JOIN methods ON alg_i = algorithm GROUP BY ALL
)"""
SW_SQL = """
sw AS (
  SELECT h.dataset_id, t.algorithm, t.alg_ord, CAST(-sum(t.w) AS DOUBLE) AS score
  FROM g h JOIN g tg ON h.grp <> tg.grp JOIN wcount t ON t.dataset_id = tg.dataset_id
  GROUP BY ALL
)"""
RANDOM_SQL = """
rnd AS (
  SELECT dataset_id, algorithm, alg_ord, CAST(row_number() OVER (
    PARTITION BY dataset_id ORDER BY md5('42:' || dataset_id || ':' || algorithm)) AS DOUBLE) AS score
  FROM p
)"""
AR_SQL = _rerank("ar", "avg")
MR_SQL = _rerank("mr", "median")
SCORED_SQL = """
scored AS (
  SELECT 'average_rank' AS treatment, * FROM ar UNION ALL
  SELECT 'median_rank', * FROM mr UNION ALL
  SELECT 'significant_wins', * FROM sw UNION ALL
  SELECT 'random', * FROM rnd
)"""
EVAL_SQL = """
sp_ranks AS (
  SELECT s.treatment, s.dataset_id, r.rank AS tr,
         rank() OVER (PARTITION BY s.treatment, s.dataset_id ORDER BY s.score)
         + (count(*) OVER (PARTITION BY s.treatment, s.dataset_id, s.score) - 1) / 2.0 AS pr
  FROM scored s JOIN r USING (dataset_id, algorithm)
),
sp AS (
  SELECT treatment, dataset_id, coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0) AS spearman
  FROM (SELECT treatment, dataset_id,
               CASE WHEN stddev_pop(tr) = 0 OR stddev_pop(pr) = 0 THEN 0 ELSE corr(tr, pr) END AS c
        FROM sp_ranks GROUP BY ALL)
),
curve AS (
  SELECT s.treatment, s.dataset_id,
         CAST(row_number() OVER w AS INTEGER) AS t,
         max(p.value) OVER (PARTITION BY s.treatment, s.dataset_id)
         - max(p.value) OVER (PARTITION BY s.treatment, s.dataset_id ORDER BY s.score, s.alg_ord
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS loss
  FROM scored s JOIN p USING (dataset_id, algorithm)
  WINDOW w AS (PARTITION BY s.treatment, s.dataset_id ORDER BY s.score, s.alg_ord)
),
auc AS (
  SELECT treatment, dataset_id, avg(loss) AS auc_loss, max(CASE WHEN t = 1 THEN loss END) AS loss_t1
  FROM curve GROUP BY ALL
),
evals AS (SELECT * FROM sp JOIN auc USING (treatment, dataset_id)),
summ AS (
  SELECT treatment, count(*) AS n_datasets, avg(spearman) AS mean_spearman,
         stddev_samp(spearman) AS std_spearman, avg(auc_loss) AS mean_auc_loss,
         stddev_samp(auc_loss) AS std_auc_loss, avg(loss_t1) AS loss_t1
  FROM evals GROUP BY ALL
)"""
BASE = [R_SQL, SIGNED_RANK_SQL]
ALL_LODO = [R_SQL, LODO_SQL, SIGNED_RANK_SQL, AR_SQL, MR_SQL, SW_SQL, RANDOM_SQL, SCORED_SQL, EVAL_SQL]
ALL_LOSO = [R_SQL, LOSO_SQL, SIGNED_RANK_SQL, AR_SQL, MR_SQL, SW_SQL, RANDOM_SQL, SCORED_SQL, EVAL_SQL]


def lodo_groups(spark, sf):
    return pr.self_groups(b.groups(spark, sf))


def all_scored(fold_scores, grp):
    """The four learning-free treatments, tall. The fold-score table is small
    (corpora x methods x folds) and used by every branch, so it is kept."""
    fold_scores = fold_scores.persist()
    perf = b.performance(fold_scores).persist()
    r = rk.ranks(perf).persist()
    methods = perf.select("algorithm", "alg_ord").distinct()
    parts = {
        "average_rank": rk.average_rank(r, grp),
        "median_rank": rk.median_rank(r, grp),
        "significant_wins": rk.significant_wins(rk.win_tensor(fold_scores), grp, methods),
        "random": rk.random_order(perf),
    }
    named = [d.select(F.lit(t).alias("treatment"), "dataset_id", "algorithm", "alg_ord", "score")
             for t, d in parts.items()]
    # read by the rank score and by the loss curve
    return reduce(lambda x, y: x.unionByName(y), named).persist(), perf, r


def evaluated(spark, sf, grp):
    scored, perf, r = all_scored(b.scores(spark, sf), grp)
    return pr.evaluate(scored, perf, r)


@query("ranks", cte(R_SQL, select="SELECT dataset_id, algorithm, CAST(rank AS DOUBLE) AS rank FROM r"))
def ranks(spark, sf):
    return rk.ranks(b.performance(b.scores(spark, sf))).select("dataset_id", "algorithm", "rank")


@query("order", cte(R_SQL, LODO_SQL, AR_SQL, select="""
SELECT dataset_id, algorithm, CAST(row_number() OVER (
  PARTITION BY dataset_id ORDER BY score, alg_ord) AS INTEGER) AS pos FROM ar"""))
def order(spark, sf):
    r = rk.ranks(b.performance(b.scores(spark, sf)))
    return rk.recommended_order(rk.average_rank(r, lodo_groups(spark, sf))).select(
        "dataset_id", "algorithm", "pos")


@query("average_rank", cte(R_SQL, LODO_SQL, AR_SQL, select="SELECT dataset_id, algorithm, score FROM ar"))
def average_rank(spark, sf):
    r = rk.ranks(b.performance(b.scores(spark, sf)))
    return rk.average_rank(r, lodo_groups(spark, sf)).select("dataset_id", "algorithm", "score")


@query("median_rank", cte(R_SQL, LODO_SQL, MR_SQL, select="SELECT dataset_id, algorithm, score FROM mr"))
def median_rank(spark, sf):
    r = rk.ranks(b.performance(b.scores(spark, sf)))
    return rk.median_rank(r, lodo_groups(spark, sf)).select("dataset_id", "algorithm", "score")


@query("win_tensor", cte(*BASE, select="SELECT * FROM wins"))
def win_tensor(spark, sf):
    return rk.win_tensor(b.scores(spark, sf))


@query("significant_wins", cte(R_SQL, LODO_SQL, SIGNED_RANK_SQL, SW_SQL,
                               select="SELECT dataset_id, algorithm, score FROM sw"))
def significant_wins(spark, sf):
    s = b.scores(spark, sf).persist()
    methods = s.select("algorithm", "alg_ord").distinct()
    return rk.significant_wins(rk.win_tensor(s), lodo_groups(spark, sf), methods).select(
        "dataset_id", "algorithm", "score")


@query("random_order", cte(b.P_SQL, RANDOM_SQL, select="SELECT dataset_id, algorithm, score FROM rnd"))
def random_order(spark, sf):
    return rk.random_order(b.performance(b.scores(spark, sf))).select("dataset_id", "algorithm", "score")


@query("source_groups", cte(b.GROUPS_SQL, """
merged AS (SELECT dataset_id, CASE WHEN grp = 'g6' THEN 'g5' ELSE grp END AS grp FROM grps)""",
                            select="SELECT dataset_id, grp FROM merged"))
def source_groups(spark, sf):
    manifest = b.groups(spark, sf).withColumnRenamed("grp", "source")
    merges = spark.createDataFrame([("g6", "g5")], "source string, merged string")
    return pr.source_groups(manifest, merges)


@query("source_collisions", r"""
WITH m AS (
  SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'HF dataset Org/' || lang || ' (main)'
         WHEN doc_id % 3 = 1 THEN 'local files [''/data/' || lang || '/part.tsv'']'
         ELSE source || ' by hand' END AS provenance FROM documents),
k AS (
  SELECT source, CASE
    WHEN regexp_matches(provenance, 'HF dataset ([\p{L}\p{N}_./-]+)')
      THEN 'hf:' || lower(regexp_extract(provenance, 'HF dataset ([\p{L}\p{N}_./-]+)', 1))
    WHEN regexp_matches(provenance, 'local files? \[?''?(/[^,''\]]+)')
      THEN 'localdir:' || regexp_extract(regexp_extract(provenance, 'local files? \[?''?(/[^,''\]]+)', 1), '^(.*)/[^/]*$', 1)
    ELSE 'unk:' || provenance END AS source_key FROM m)
SELECT source_key, count(DISTINCT source) AS n_sources,
       array_to_string(list_sort(list_distinct(list(source))), ',') AS sources
FROM k GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def source_collisions(spark, sf):
    d = b.table(spark, sf, "documents")
    prov = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("HF dataset Org/"), "lang", F.lit(" (main)")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("local files ['/data/"), "lang", F.lit("/part.tsv']")))
            .otherwise(F.concat("source", F.lit(" by hand"))))
    return pr.source_collisions(d.select("source", prov.alias("provenance")))


LEAK_SELECT = """
SELECT h.dataset_id AS holdout_id, count(*) AS n_train,
       CAST(sum(CASE WHEN h.dataset_id = t.dataset_id THEN 1 ELSE 0 END) AS BIGINT) AS own_rows,
       CAST(sum(CASE WHEN h.grp = t.grp THEN 1 ELSE 0 END) AS BIGINT) AS group_rows
FROM g h JOIN g t ON h.grp <> t.grp GROUP BY 1"""


@query("leakage", cte(LOSO_SQL, select=LEAK_SELECT))
def leakage(spark, sf):
    g = b.groups(spark, sf)
    return pr.leakage(pr.training_pairs(g), g)


@query("training_sizes", cte(LOSO_SQL, select="""
SELECT h.dataset_id, h.grp, (SELECT count(*) FROM g t WHERE t.grp <> h.grp) AS n_train FROM g h"""))
def training_sizes(spark, sf):
    return pr.training_sizes(b.groups(spark, sf))


_EV = "SELECT treatment, dataset_id, round(spearman, 6) + 0 AS spearman, round(auc_loss, 6) + 0 AS auc_loss, round(loss_t1, 6) + 0 AS loss_t1 FROM evals"


@query("lodo", cte(*ALL_LODO, select=_EV))
def lodo(spark, sf):
    return rounded(evaluated(spark, sf, lodo_groups(spark, sf)), "spearman", "auc_loss", "loss_t1")


@query("loso", cte(*ALL_LOSO, select=_EV))
def loso(spark, sf):
    return rounded(evaluated(spark, sf, b.groups(spark, sf)), "spearman", "auc_loss", "loss_t1")


@query("spearman_score", cte(*ALL_LODO, select="""
SELECT treatment, dataset_id, round(spearman, 6) + 0 AS spearman FROM sp"""))
def spearman_score(spark, sf):
    scored, _, r = all_scored(b.scores(spark, sf), lodo_groups(spark, sf))
    return rounded(pr.spearman_scores(scored, r), "spearman")


@query("loss_curve", cte(*ALL_LODO, select="SELECT treatment, dataset_id, t, round(loss, 6) + 0 AS loss FROM curve"))
def loss_curve(spark, sf):
    scored, perf, _ = all_scored(b.scores(spark, sf), lodo_groups(spark, sf))
    return rounded(pr.loss_curve(scored, perf), "loss")


@query("auc_loss", cte(*ALL_LODO, select="""
SELECT treatment, dataset_id, round(auc_loss, 6) + 0 AS auc_loss, round(loss_t1, 6) + 0 AS loss_t1 FROM auc"""))
def auc_loss(spark, sf):
    scored, perf, _ = all_scored(b.scores(spark, sf), lodo_groups(spark, sf))
    return rounded(pr.auc_loss(pr.loss_curve(scored, perf)), "auc_loss", "loss_t1")


_SUMM_COLS = ["mean_spearman", "std_spearman", "mean_auc_loss", "std_auc_loss", "loss_t1"]
_SUMM = "SELECT treatment, n_datasets, " + ", ".join(
    f"round({c}, 6) + 0 AS {c}" for c in _SUMM_COLS) + " FROM summ"


@query("summary", cte(*ALL_LODO, select=_SUMM))
def summary(spark, sf):
    return rounded(pr.summary(evaluated(spark, sf, lodo_groups(spark, sf))), *_SUMM_COLS)


@query("language_split", cte(*ALL_LODO, select="""
SELECT treatment,
       round(avg(CASE WHEN flag = 1 THEN spearman END), 6) + 0 AS mean_flagged,
       round(avg(CASE WHEN flag = 0 THEN spearman END), 6) + 0 AS mean_other,
       CAST(sum(flag) AS BIGINT) AS n_flagged, CAST(sum(1 - flag) AS BIGINT) AS n_other,
       round(avg(CASE WHEN flag = 1 THEN spearman END) - avg(CASE WHEN flag = 0 THEN spearman END), 6) + 0 AS drop
FROM (SELECT e.*, CASE WHEN grp IN ('g0', 'g1', 'g2') THEN 1 ELSE 0 END AS flag
      FROM evals e JOIN grps USING (dataset_id)) GROUP BY 1"""))
def language_split(spark, sf):
    flags = b.groups(spark, sf).select(
        "dataset_id", F.col("grp").isin("g0", "g1", "g2").cast("int").alias("flag"))
    return rounded(pr.flag_split(evaluated(spark, sf, lodo_groups(spark, sf)), flags),
                   "mean_flagged", "mean_other", "drop")


def _suffix(parts, tag, names):
    import re
    text = ",\n".join(p.strip() for p in parts)
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: m.group(1) + tag, text)


_TAIL = ["g", "ar_m", "ar", "mr_m", "mr", "sw", "scored", "sp_ranks", "sp", "curve", "auc", "evals", "summ"]
_SHARED = [R_SQL, b.GROUPS_SQL, SIGNED_RANK_SQL, RANDOM_SQL]
_G1 = "g AS (SELECT dataset_id, dataset_id AS grp FROM grps)"
_G2 = "g AS (SELECT dataset_id, grp FROM grps)"
_REST = [AR_SQL, MR_SQL, SW_SQL, SCORED_SQL, EVAL_SQL]


@query("loo_vs_loso", cte(*_SHARED, _suffix([_G1, *_REST], "_1", _TAIL), _suffix([_G2, *_REST], "_2", _TAIL),
                          select="""
SELECT treatment, round(x.mean_spearman, 6) + 0 AS lodo, round(y.mean_spearman, 6) + 0 AS loso,
       round(y.mean_spearman - x.mean_spearman, 6) + 0 AS diff
FROM summ_1 x JOIN summ_2 y USING (treatment)"""))
def loo_vs_loso(spark, sf):
    a = pr.summary(evaluated(spark, sf, lodo_groups(spark, sf)))
    c = pr.summary(evaluated(spark, sf, b.groups(spark, sf)))
    return rounded(pr.compare_protocols(a, c), "lodo", "loso", "diff")
