"""Scalar functions as Column expressions: safe arithmetic, information theory, finance, distances, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26 (fixed values); error below 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def safe_divide(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def safe_sqrt(x) -> Column:
    return F.when(_col(x) >= 0, F.sqrt(_col(x)))


def safe_log(x) -> Column:
    return F.when(_col(x) > 0, F.log(_col(x)))


def entr(x) -> Column:
    """-x ln x; 0 at 0, minus infinity below."""
    x = _col(x)
    return F.when(x > 0, -x * F.log(x)).when(x == 0, 0.0).when(x < 0, float("-inf"))


def rel_entr(x, y) -> Column:
    """x ln(x / y); 0 for x = 0 <= y, else infinity outside x, y > 0."""
    x, y = _col(x), _col(y)
    return F.when((x > 0) & (y > 0), x * F.log(x / y)).when((x == 0) & (y >= 0), 0.0).otherwise(F.when(x.isNotNull() & y.isNotNull(), float("inf")))


def kl_div(x, y) -> Column:
    return rel_entr(x, y) - _col(x) + _col(y)


def huber(delta, r) -> Column:
    """Quadratic to delta, linear beyond; infinity for a negative delta."""
    d, a = _col(delta), F.abs(_col(r))
    return F.when(d < 0, float("inf")).when(a <= d, 0.5 * a * a).otherwise(d * (a - 0.5 * d))


def boxcox(x, lmbda) -> Column:
    """Box-Cox transform; null for x <= 0."""
    x, k = _col(x), _col(lmbda)
    return F.when(x > 0, F.when(k == 0, F.log(x)).otherwise((F.pow(x, k) - 1) / k))


def inv_boxcox(y, lmbda) -> Column:
    y, k = _col(y), _col(lmbda)
    return F.when(k == 0, F.exp(y)).otherwise(F.pow(k * y + 1, 1 / k))


def binary_cross_entropy(y, p, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(_col(p), F.lit(eps)), F.lit(1 - eps))
    return -(_col(y) * F.log(p) + (1 - _col(y)) * F.log(1 - p))


def norm_cdf(x) -> Column:
    """Standard normal distribution function from the erf polynomial."""
    x = _col(x)
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    e = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + e)).otherwise(0.5 * (1 - e))


def norm_pdf(x) -> Column:
    return F.exp(-_col(x) * _col(x) / 2) / math.sqrt(2 * math.pi)


def norm_ppf(p) -> Column:
    """Normal quantile by Newton steps from a logistic start; null outside (0, 1)."""
    p = _col(p).cast("double")
    steps = F.array(*(F.lit(i) for i in range(6)))
    # the aggregate keeps one step's expression, however many steps there are
    x = F.aggregate(steps, F.log(p / (1 - p)) / F.lit(1.702), lambda x, _: x - (norm_cdf(x) - p) / norm_pdf(x))
    return F.when((p > 0) & (p < 1), x)


def black_scholes(spot, strike, rate, vol, years, call: bool = True) -> Column:
    """Price of a European option; null unless spot, strike, vol and years are positive."""
    s, k, r, v, t = map(_col, (spot, strike, rate, vol, years))
    d1 = (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))
    d2 = d1 - v * F.sqrt(t)
    c = s * norm_cdf(d1) - k * F.exp(-r * t) * norm_cdf(d2)
    price = c if call else c - s + k * F.exp(-r * t)
    return F.when((s > 0) & (k > 0) & (v > 0) & (t > 0), price)


def greeks(spot, strike, rate, vol, years) -> dict[str, Column]:
    """delta, gamma, vega, theta, rho of a call."""
    s, k, r, v, t = map(_col, (spot, strike, rate, vol, years))
    d1 = (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))
    d2 = d1 - v * F.sqrt(t)
    return {
        "delta": norm_cdf(d1),
        "gamma": norm_pdf(d1) / (s * v * F.sqrt(t)),
        "vega": s * norm_pdf(d1) * F.sqrt(t),
        "theta": -s * norm_pdf(d1) * v / (2 * F.sqrt(t)) - r * k * F.exp(-r * t) * norm_cdf(d2),
        "rho": k * t * F.exp(-r * t) * norm_cdf(d2),
    }


def present_value(future, rate, periods) -> Column:
    return _col(future) / F.pow(1 + _col(rate), _col(periods))


def future_value(present, rate, periods) -> Column:
    return _col(present) * F.pow(1 + _col(rate), _col(periods))


def dot(a, b) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """Cosine similarity; with a zero norm 1 for equal vectors, else 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.when(_col(a) == _col(b), 1.0).otherwise(0.0)).otherwise(dot(a, b) / n)


def jaccard(a, b) -> Column:
    """Jaccard similarity of two arrays as sets; both empty: 1."""
    u = F.size(F.array_union(_col(a), _col(b)))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(_col(a), _col(b))) / u)


def levenshtein_ratio(a, b) -> Column:
    """Edit distance over the longer length; both empty: 0."""
    m = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(m == 0, 0.0).otherwise(F.levenshtein(_col(a), _col(b)) / m)


def implied_volatility(price, spot, strike, rate, years, call: bool = True) -> Column:
    """The volatility in (0, 5) at which Black-Scholes gives the price, by 50 halvings."""
    p = _col(price)
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(50)),
        F.struct(F.lit(0.0).alias("a"), F.lit(5.0).alias("b")),
        lambda s, _: F.when(black_scholes(spot, strike, rate, (s["a"] + s["b"]) / 2, years, call) > p, F.struct(s["a"].alias("a"), ((s["a"] + s["b"]) / 2).alias("b"))).otherwise(F.struct(((s["a"] + s["b"]) / 2).alias("a"), s["b"].alias("b"))),
    )
    return (span["a"] + span["b"]) / 2


def safe_pow(x, y) -> Column:
    """x ** y; null where it is not a finite number."""
    v = F.pow(_col(x).cast("double"), _col(y).cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def safe_exp(x) -> Column:
    """e ** x; null where it overflows."""
    v = F.exp(_col(x).cast("double"))
    return F.when(v < float("inf"), v)


def exponential_cdf(x, rate) -> Column:
    return F.when(_col(x) < 0, 0.0).otherwise(1 - F.exp(-_col(rate) * _col(x)))


def uniform_cdf(x, lo, hi) -> Column:
    return F.least(F.greatest((_col(x) - _col(lo)) / (_col(hi) - _col(lo)), F.lit(0.0)), F.lit(1.0))


def logistic_cdf(x, loc=0.0, scale=1.0) -> Column:
    return 1 / (1 + F.exp(-(_col(x) - _col(loc)) / _col(scale)))


def laplace_cdf(x, loc=0.0, scale=1.0) -> Column:
    z = (_col(x) - _col(loc)) / _col(scale)
    return F.when(z < 0, 0.5 * F.exp(z)).otherwise(1 - 0.5 * F.exp(-z))


def weibull_cdf(x, shape, scale) -> Column:
    return F.when(_col(x) < 0, 0.0).otherwise(1 - F.exp(-F.pow(_col(x) / _col(scale), _col(shape))))


def pareto_cdf(x, shape, scale) -> Column:
    return F.when(_col(x) < _col(scale), 0.0).otherwise(1 - F.pow(_col(scale) / _col(x), _col(shape)))


def poisson_pmf(k, rate) -> Column:
    """For whole k up to 170 (beyond it the factorial is no double); null for others."""
    n, r = _col(k).cast("int"), _col(rate).cast("double")
    logs = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when((n >= 0) & (n <= 170), F.exp(n * F.log(r) - r - logs))


def binomial_pmf(k, n, p) -> Column:
    """By the product of (n - k + i) / i, so no factorial overflows."""
    kk, nn, q = _col(k).cast("int"), _col(n).cast("int"), _col(p).cast("double")
    logs = F.aggregate(F.when(kk > 0, F.sequence(F.lit(1), kk)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log((nn - kk + i) / i))
    return F.when((kk >= 0) & (kk <= nn), F.exp(logs + kk * F.log(q) + (nn - kk) * F.log1p(-q)))


def van_der_corput(i, base: int = 2) -> Column:
    """The i-th number of the van der Corput sequence: the digits of i in the base, mirrored at the point."""
    d = F.aggregate(F.sequence(F.lit(1), F.lit(40 if base == 2 else 30)), F.struct(_col(i).cast("long").alias("n"), F.lit(0.0).alias("x"), F.lit(1.0).alias("f")), lambda s, _: F.struct(F.floor(s["n"] / base).alias("n"), (s["x"] + (s["n"] % base) * s["f"] / base).alias("x"), (s["f"] / base).alias("f")))
    return d["x"]


def halton(i, dimensions: int) -> list[Column]:
    """The i-th point of the Halton sequence, a column a dimension (bases: the first primes)."""
    primes: list[int] = []
    c = 2
    while len(primes) < dimensions:
        if all(c % p for p in primes):
            primes.append(c)
        c += 1
    return [van_der_corput(i, p) for p in primes]
