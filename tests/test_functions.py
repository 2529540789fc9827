"""Ranks, tails and text helpers against plain Python."""

import itertools
import math

from pyspark.sql import functions as F

from corpuslens.functions import stats, tails, text
from corpuslens.functions.ranking import avg_rank, pick_key, spread_row_number, top_k


def test_avg_rank_ties(spark):
    d = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", 9.0)], "k string, v double")
    got = sorted((r.v, r.r) for r in avg_rank(d, ["k"], "v", "r").collect())
    assert got == [(1.0, 1.5), (1.0, 1.5), (3.0, 3.0), (9.0, 4.0)]


def test_spread_row_number_equals_plain_order(spark):
    d = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("g"), "id")
    d = d.withColumn("key", pick_key(7, "id"))
    rows = spread_row_number(d, ["g"], "key", "rn").collect()
    for g in ("hot", "cold"):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.key)
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1))


def test_top_k_hot_group(spark):
    d = spark.range(1000).select(F.lit("x").alias("g"), (F.col("id") % 97).alias("v"), "id")
    got = [(r.v, r.id) for r in top_k(d, ["g"], [F.col("v").desc(), F.col("id")], 5, F.col("id")).orderBy("_rn").collect()]
    assert got == sorted(((i % 97, i) for i in range(1000)), key=lambda t: (-t[0], t[1]))[:5]


def test_tails(spark):
    one = spark.range(1)
    for z in (0.0, 0.5, 1.96, 4.0):
        p = one.select(tails.normal_two_sided(F.lit(z))).first()[0]
        assert abs(p - math.erfc(z / math.sqrt(2))) < 1e-12
    # even degrees of freedom have a closed form
    for x, df in ((3.0, 4), (20.0, 18), (78.4577, 18)):
        want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
        got = one.select(tails.chi2_upper(F.lit(x), F.lit(df).cast("long"))).first()[0]
        assert abs(got - want) < 1e-11
    got = one.select(tails.chi2_upper(F.lit(3.0), F.lit(1).cast("long"))).first()[0]
    assert abs(got - math.erfc(math.sqrt(1.5))) < 1e-12
    # t: 1 degree of freedom is the Cauchy tail; 2 has a closed form
    assert abs(one.select(tails.t_two_sided(F.lit(2.0), F.lit(1).cast("long"))).first()[0]
               - (1 - 2 / math.pi * math.atan(2.0))) < 1e-12
    assert abs(one.select(tails.t_two_sided(F.lit(2.0), F.lit(2).cast("long"))).first()[0]
               - (1 - 2.0 / math.sqrt(6.0))) < 1e-12


def test_signed_rank_exact(spark):
    cdf = {(r.n, r.w): r.p_le for r in stats.signed_rank_cdf(spark.createDataFrame([(10,), (4,)], "n long")).collect()}
    assert abs(2 * cdf[(10, 8)] - 0.048828125) < 1e-12
    sums = [sum(s) for k in range(5) for s in itertools.combinations(range(1, 5), k)]
    for w in range(11):
        assert abs(cdf[(4, w)] - sum(x <= w for x in sums) / 16) < 1e-12


def test_all_tied_folds_give_no_p(spark):
    d = spark.createDataFrame([("a", 0.0)] * 5, "k string, d double")
    r = stats.paired_signed_rank(d, ["k"], "d").first()
    assert r.p is None and r.ties == 5


def test_constant_feature(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double").withColumn("k", F.lit(1))
    r = stats.spearman(d, ["k"], "x", "y").first()
    assert (r.rho, r.p) == (0.0, 1.0)


def test_bh_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    d = spark.createDataFrame([(x,) for x in p], "p double").withColumn("o", F.lit("a"))
    q = {r.p: r.q for r in stats.bh_fdr(d, ["o"]).collect()}
    want = {0.01: 0.04, 0.03: 0.04 * 4 / 3, 0.04: 0.04 * 4 / 3, 0.5: 0.5}
    assert all(abs(q[k] - want[k]) < 1e-12 for k in p)


def test_tokenizers_and_grams(spark):
    d = spark.createDataFrame([("Olá, a_b  x! soooo",)], "text string")
    c = F.col("text")
    r = d.select(text.white_tokens(c).alias("w"), text.word_tokens(c).alias("t"), text.term_tokens(c).alias("u"),
                 text.word_ngrams(text.word_tokens(c), 2, 3).alias("g"),
                 text.char_ngrams(F.array(F.lit("ab"), F.lit("c")), 3, 5).alias("ch"),
                 c.rlike(text.ELONGATION).alias("e"), text.strip(F.lit("  x ")).alias("s")).first()
    assert r.w == ["olá,", "a_b", "x!", "soooo"]
    assert r.t == ["olá", "a_b", "x", "soooo"] and r.u == ["olá", "a_b", "soooo"]
    assert r.g == ["olá a_b", "a_b x", "x soooo", "olá a_b x", "a_b x soooo"]
    assert r.ch == [" ab", "ab ", " ab ", " c "]
    assert r.e and r.s == "x"
