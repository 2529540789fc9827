"""Distribution tails as column expressions (series folded with ``F.aggregate``)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Critical values of the two-tailed Nemenyi test at 0.05, by number
# of treatments (k = 2..10 and 19).
NEMENYI_Q_05 = {
    2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850,
    7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164, 19: 3.517,
}


def _series(n_terms, first: Column, ratio) -> Column:
    """first + first*ratio(1) + first*ratio(1)*ratio(2) + ... with n_terms ratios."""
    last = n_terms if isinstance(n_terms, Column) else F.lit(n_terms)
    start = F.struct(first.alias("s"), first.alias("t"))

    def step(acc, i):
        t = acc["t"] * ratio(i.cast("double"))
        return F.struct((acc["s"] + t).alias("s"), t.alias("t"))

    seq = F.filter(F.sequence(F.lit(0), F.greatest(last.cast("int"), F.lit(0))), lambda i: i > 0)
    return F.aggregate(seq, start, step, lambda acc: acc["s"])


#: From here on the upper tail of the normal comes from its continued fraction.
FAR = 2.5
DEPTH = 200
HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def _log_gamma(x: Column) -> Column:
    """log Gamma for x > 0: eight steps up, then Stirling's series."""
    y = x + 8.0
    y2 = y * y
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) / y2) / y2) / y2) / y2) / y
    down = F.log(x)
    for k in range(1, 8):
        down = down + F.log(x + float(k))
    return (y - 0.5) * F.log(y) - y + HALF_LOG_TAU + series - down


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|), to about 1e-13 of itself: a series near 0, a continued fraction beyond."""
    a = F.abs(z).cast("double")
    area = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * _series(
        80, a, lambda k: a * a / (F.lit(2.0) * k + 1))
    fraction = F.aggregate(F.sequence(F.lit(DEPTH), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k.cast("double") / acc)
    return F.when(a < FAR, F.lit(1.0) - 2 * area).otherwise(F.exp(-a * a / 2 - HALF_LOG_TAU) * 2 / fraction)


def chi2_upper(x: Column, df: Column) -> Column:
    """Upper chi-square tail for integer degrees of freedom: a finite sum of positive terms.

    Each term is the one before times half / (j + offset); the sum is kept
    relative to its first term and its logarithm added at the end.
    """
    half = x.cast("double") / 2.0
    odd = (df % 2) == 1
    # even: exp(-h) sum h^j / j!, j = 0..; odd: the normal tail and exp(-h) sum h^(j-1/2) / Gamma(j+1/2), j = 1..
    n = F.floor(df / F.lit(2)).cast("int")
    step = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("m"), F.lit(1.0).alias("s"))

    def add(acc, j):
        t = acc["t"] + F.log(half / (j.cast("double") + step))
        m = F.greatest(acc["m"], t)
        return F.struct(t.alias("t"), m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(t - m)).alias("s"))

    terms = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: j > 0)
    total = F.aggregate(terms, zero, add, lambda acc: acc["m"] + F.log(acc["s"]))
    first = F.when(odd, 0.5 * F.log(half) - math.log(math.sqrt(math.pi) / 2)).otherwise(F.lit(0.0))
    finite = F.when(n > 0, F.exp(total + first - half)).otherwise(F.lit(0.0))
    tail = F.when(odd, normal_two_sided(F.sqrt(x.cast("double"))) + finite).otherwise(finite)
    return F.when(half <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = F.lit(1e-300)

    def safe(v):
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    zero = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def one(acc, num):
        d = 1.0 / safe(1.0 + num * acc["d"])
        c = safe(1.0 + num / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    # the two coefficients of each m one after the other
    def step(acc, i):
        m = F.floor(i / F.lit(2)).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        return one(acc, F.when(i % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * DEPTH)), zero, step, lambda acc: acc["h"])


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student tail: the incomplete beta function at df / (df + t^2)."""
    n, t2 = df.cast("double"), t.cast("double") * t.cast("double")
    x, y = n / (n + t2), t2 / (n + t2)
    a, b = n / 2.0, F.lit(0.5)
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - 0.5 * math.log(math.pi) + a * F.log(x) + b * F.log(y))
    near = 1.0 - front * _beta_fraction(b, a, y) / b
    far = front * _beta_fraction(a, b, x) / a
    return F.when(t2 == 0, F.lit(1.0)).otherwise(F.when(x < (a + 1.0) / (a + b + 2.0), far).otherwise(near))


def range_quantile(k: int, p: float = 0.95) -> float:
    """The p quantile of the range of k standard normals (Simpson's rule and bisection), over sqrt 2."""
    def cdf(q):
        lo, hi, n = -8.0, 8.0 + q, 2000
        h = (hi - lo) / n
        phi = [0.5 * math.erfc(-v / math.sqrt(2)) for v in (lo + i * h - q for i in range(n + 1))]
        total = 0.0
        for i in range(n + 1):
            z = lo + i * h
            w = 1 if i in (0, n) else 4 if i % 2 else 2
            total += w * math.exp(-z * z / 2) * (0.5 * math.erfc(-z / math.sqrt(2)) - phi[i]) ** (k - 1)
        return k * total * h / 3 / math.sqrt(2 * math.pi)

    lo, hi = 0.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2 / math.sqrt(2)


def nemenyi_value(k: int) -> float | None:
    """Critical value for any number of treatments, as printed: three digits."""
    if k < 2:
        return None
    return NEMENYI_Q_05.get(k) or round(range_quantile(k), 3)
