"""Statistical tests and corrections over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.ranking import avg_rank
from corpuslens.functions.tails import chi2_upper, nemenyi_value, normal_two_sided, t_two_sided

def pearson(x: str, y: str):
    """Correlation aggregate that is null, not an error, when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


CLOSE = 1e-8  # differences up to this count as "all close to zero"


def signed_rank_cdf(sizes: DataFrame) -> DataFrame:
    """(n, w, p_le): exact P(W <= w) of the signed-rank statistic for each n in ``sizes``.

    The subsets of 1..n are counted by their sum, one array fold per distinct n.
    """
    n = F.col("n")
    top = (n * (n + 1) / 2).cast("int")
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, 1.0).otherwise(0.0)),
        lambda arr, k: F.transform(arr, lambda x, i: x + F.when(i >= k, F.get(arr, i - k)).otherwise(0.0)))
    run = Window.partitionBy("n").orderBy("w")
    return (
        sizes.select("n").distinct().filter("n > 0")
        .select("n", F.posexplode(counts).alias("w", "c"))
        .select("n", F.col("w").cast("long").alias("w"),
                (F.sum("c").over(run) / F.pow(F.lit(2.0), n)).alias("p_le"))
    )


def _signed_sums(diffs: DataFrame, keys, d: str) -> DataFrame:
    """Rank sums of positive and negative differences, zeros dropped, ties averaged."""
    base = diffs.groupBy(*keys).agg(
        F.avg(d).alias("mean_d"), F.max(F.abs(F.col(d))).alias("max_abs"),
        F.sum(F.when(F.col(d) > 0, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col(d) == 0, 1).otherwise(0)).alias("ties"),
        F.sum(F.when(F.col(d) < 0, 1).otherwise(0)).alias("losses"))
    nz = diffs.filter(F.col(d) != 0).withColumn("_abs", F.abs(F.col(d)))
    r = avg_rank(nz, keys, "_abs", "_r")
    t = r.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_abs")))
    sums = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(F.col(d) < 0, F.col("_r")).otherwise(0.0)).alias("w_neg"),
        # each of the t rows of a tie carries (t^3 - t) / t
        F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("tie_term"))
    return base.join(sums, list(keys), "left")


def paired_signed_rank(diffs: DataFrame, keys, d: str) -> DataFrame:
    """Exact two-sided signed-rank test. Zeros are dropped; with ties the smaller
    rank sum is rounded down before the table look-up; all-close gives no p."""
    s = _signed_sums(diffs, keys, d).withColumn(
        "w", F.floor(F.least("w_pos", "w_neg")).cast("long"))
    cdf = signed_rank_cdf(s)
    return s.join(cdf, ["n", "w"], "left").withColumn(
        "p", F.when(F.col("max_abs") <= CLOSE, F.lit(None))
        .otherwise(F.least(F.lit(1.0), 2 * F.col("p_le")))).drop("p_le")


def signed_rank_normal(diffs: DataFrame, keys, d: str, tie_eps: float | None = None) -> DataFrame:
    """Normal approximation: zeros dropped, tie-corrected, no continuity correction.

    ``tie_eps`` (off by default) snaps differences to a grid, so that values
    equal in exact arithmetic also tie in floating point.
    """
    if tie_eps:
        diffs = diffs.withColumn(d, F.round(F.col(d) / tie_eps) * tie_eps)
    s = _signed_sums(diffs, keys, d)
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = (F.least("w_pos", "w_neg") - n * (n + 1) / 4) / F.sqrt(F.when(var > 0, var))
    return s.withColumn("z", z).withColumn(
        "p", F.when((F.col("max_abs") <= CLOSE) | F.col("n").isNull(), F.lit(None))
        .otherwise(normal_two_sided(F.col("z"))))


def mean_ranks(scored: DataFrame, value="value", descending=True, keys=()) -> DataFrame:
    """Mean over corpora of the treatment's average rank (1 = best)."""
    r = avg_rank(scored, [*keys, "dataset_id"], value, "_r", descending=descending)
    return r.groupBy(*keys, "treatment").agg(F.avg("_r").alias("mean_rank"))


def friedman(scored: DataFrame, value="value", descending=True) -> DataFrame:
    """Chi-square with tie correction, degrees of freedom and p: one row."""
    r = avg_rank(scored, ["dataset_id"], value, "_r", descending=descending)
    # a tie of t rows adds t^3 - t; each of its rows carries t^2 - 1
    t = F.count(F.lit(1)).over(Window.partitionBy("dataset_id", value))
    per = r.withColumn("_tie", t * t - 1).groupBy("treatment").agg(
        F.sum("_r").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("_tie").alias("tie"))
    tot = per.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("tie").alias("tie"),
                  F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    corr = 1 - F.col("tie") / (n * k * (k * k - 1))
    return (
        tot
        .withColumn("chi2", F.try_divide(12 / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1), corr))
        .withColumn("df", F.col("k") - 1)
        .withColumn("p", chi2_upper(F.col("chi2"), F.col("df")))
        .select("k", "n", "chi2", "df", "p")
    )


def nemenyi_cd(scored: DataFrame) -> DataFrame:
    """(k, n, q, cd): one row, for any number of treatments from two on (null below)."""
    c = scored.agg(F.countDistinct("treatment").alias("k"), F.countDistinct("dataset_id").alias("n"))
    q = nemenyi_value(c.first()["k"])  # one number decides on the critical value
    return c.withColumn("q", F.lit(q).cast("double")).withColumn(
        "cd", F.col("q") * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))))


def significant_pairs(mean_rank: DataFrame, cd: DataFrame) -> DataFrame:
    a = mean_rank.select(F.col("treatment").alias("a"), F.col("mean_rank").alias("ra"))
    b = mean_rank.select(F.col("treatment").alias("b"), F.col("mean_rank").alias("rb"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("diff", F.abs(F.col("ra") - F.col("rb")))
    return pairs.join(cd.select("cd")).withColumn("significant", F.col("diff") >= F.col("cd"))


def cliques(mean_rank: DataFrame, cd: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring mean ranks whose span is below the critical difference."""
    pos = mean_rank.withColumn("pos", F.row_number().over(Window.orderBy("mean_rank", "treatment")))
    a = pos.select(F.col("pos").alias("first"), F.col("treatment").alias("best"), F.col("mean_rank").alias("ra"))
    b = pos.select(F.col("pos").alias("pb"), F.col("treatment").alias("tb"), F.col("mean_rank").alias("rb"))
    runs = (
        a.join(b, F.col("pb") >= F.col("first")).join(cd.select("cd"))
        .filter((F.col("pb") == F.col("first")) | (F.col("rb") - F.col("ra") < F.col("cd")))
        .groupBy("first", "best").agg(F.max("pb").alias("last"), F.max_by("tb", "pb").alias("worst"))
        .filter("last > first")
    )
    # starts rise and ends never fall, so a run is inside another one iff an
    # earlier run already reaches as far
    reach = F.max("last").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    return (runs.withColumn("reach", reach)
            .filter(F.col("reach").isNull() | (F.col("reach") < F.col("last"))).drop("reach"))


def spearman(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """(keys, n, rho, p). A constant side gives rho 0 and p 1."""
    r = avg_rank(avg_rank(df, keys, x, "_rx"), keys, y, "_ry")
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("_rho"),
        F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"))
    return _rho_and_p(s).select(*keys, "n", "rho", "p")


def _rho_and_p(s: DataFrame) -> DataFrame:
    const = (F.col("_sx") == 0) | (F.col("_sy") == 0) | F.col("_rho").isNull()
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_rho")))
    dof = F.col("n") - 2
    left = 1 - rho * rho
    t = rho * F.sqrt(dof / F.when(left > 1e-15, left))
    p = (F.when(const | (dof <= 0), F.lit(1.0)).when(left <= 1e-15, F.lit(0.0))
         .otherwise(t_two_sided(t, dof)))
    return s.withColumn("rho", F.when(const, F.lit(0.0)).otherwise(rho)).withColumn("p", p)


def bh_fdr(df: DataFrame, keys, p="p", out="q") -> DataFrame:
    """Benjamini-Hochberg q-values inside ``keys``: monotone from the largest p down."""
    up = Window.partitionBy(*keys).orderBy(p)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = df.withColumn("_raw", F.col(p) * n / F.row_number().over(up))
    down = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(out, F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")


def spearman_matrix(long: DataFrame, feature="feature", value="value") -> DataFrame:
    """(f, g, rho) with f < g over long (dataset_id, feature, value).

    Ranks are made once per feature; both sides meet per corpus, where a group
    is one row of the descriptor matrix.
    """
    r = avg_rank(long, [feature], value, "_r")
    a = r.select("dataset_id", F.col(feature).alias("f"), F.col("_r").alias("_ra"))
    b = r.select("dataset_id", F.col(feature).alias("g"), F.col("_r").alias("_rb"))
    return (
        a.join(b, "dataset_id").filter("f < g").groupBy("f", "g")
        .agg(F.coalesce(pearson("_ra", "_rb"), F.lit(0.0)).alias("rho"))
    )
