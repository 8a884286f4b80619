"""Student-t distribution for integer degrees of freedom, without scipy.

With theta = atan(|t| / sqrt(nu)) the probability A = P(|T| < |t|) has a finite series
(Abramowitz & Stegun 26.7.3/26.7.4):

* even nu: A = sin(theta) * sum_{k=0}^{(nu-2)/2} c_k cos(theta)^(2k),  c_0 = 1, c_k = c_{k-1}(2k-1)/(2k)
* odd nu:  A = (2/pi) * (theta + sin(theta) * sum_{k=0}^{(nu-3)/2} d_k cos(theta)^(2k+1)),
           d_0 = 1, d_k = d_{k-1}(2k)/(2k+1)

Spark evaluates the series as a JVM higher-order ``aggregate`` over ``sequence`` (nu may be a
column).  Quantiles (for confidence half-widths) are found once on the driver by bisection on the
same series and shipped as a small constant table (nu = 1..TABLE_MAX); above that the
Cornish-Fisher expansion in 1/nu is exact to double precision.
"""
from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TABLE_MAX = 1000


def _series(nu: Column, c2: Column, odd: bool) -> Column:
    m = F.floor((nu - F.lit(3 if odd else 2)) / 2).cast("int")
    ks = F.filter(F.sequence(F.lit(0), F.greatest(m, F.lit(0))), lambda k: (k >= 1) & (k <= m))
    init = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        kd = k.cast("double")
        ratio = ((2 * kd) / (2 * kd + 1)) if odd else ((2 * kd - 1) / (2 * kd))
        term = acc["term"] * c2 * ratio
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    # for odd nu == 1 the sum is empty (m = -1): handled by the caller
    return F.aggregate(ks, init, step)["total"]


def t_abs_prob(t: Column, nu: Column) -> Column:
    """A(t | nu) = P(|T| < |t|) for integer nu >= 1."""
    theta = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    s, c = F.sin(theta), F.cos(theta)
    c2 = c * c
    even = s * _series(nu, c2, odd=False)
    odd = F.lit(2 / math.pi) * (theta + F.when(nu >= 3, s * c * _series(nu, c2, odd=True)).otherwise(F.lit(0.0)))
    return F.when(nu % 2 == 0, even).otherwise(odd)


def t_two_sided_p(t: Column, nu: Column) -> Column:
    return F.lit(1.0) - t_abs_prob(t, nu)


def t_cdf(t: Column, nu: Column) -> Column:
    return F.lit(0.5) + F.signum(t) * t_abs_prob(t, nu) / 2


# ---- driver-side twin, used only to tabulate quantiles ----------------------------------

def _abs_prob_py(t: float, nu: int) -> float:
    theta = math.atan(abs(t) / math.sqrt(nu))
    s, c = math.sin(theta), math.cos(theta)
    c2 = c * c
    if nu % 2 == 0:
        term = total = 1.0
        for k in range(1, (nu - 2) // 2 + 1):
            term *= c2 * (2 * k - 1) / (2 * k)
            total += term
        return s * total
    if nu == 1:
        return 2 * theta / math.pi
    term = total = 1.0
    for k in range(1, (nu - 3) // 2 + 1):
        term *= c2 * (2 * k) / (2 * k + 1)
        total += term
    return 2 / math.pi * (theta + s * c * total)


def _cornish_fisher(p: float, nu: float) -> float:
    z = _norm_ppf(p)
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    return z + g1 / nu + g2 / nu ** 2 + g3 / nu ** 3 + g4 / nu ** 4


def _norm_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@lru_cache(maxsize=None)
def t_quantile_py(p: float, nu: int) -> float:
    """Two-sided critical value: t with P(T <= t) = p, p > 0.5."""
    target = 2 * p - 1
    lo, hi = 0.0, 1.0
    while _abs_prob_py(hi, nu) < target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if _abs_prob_py(mid, nu) < target:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15:
            break
    return (lo + hi) / 2


@lru_cache(maxsize=None)
def quantile_rows(p: float = 0.975, max_nu: int = TABLE_MAX) -> tuple[tuple[int, float], ...]:
    return tuple((nu, t_quantile_py(p, nu)) for nu in range(1, max_nu + 1))


def t_table(spark: SparkSession, p: float = 0.975):
    """Constant-size (TABLE_MAX rows) lookup table ``(nu INT, t_crit DOUBLE)``."""
    return spark.createDataFrame(list(quantile_rows(p)), "nu INT, t_crit DOUBLE")


def t_crit(nu: Column, p: float = 0.975) -> Column:
    """Critical value as a pure expression: a CASE map for nu <= TABLE_MAX, else Cornish-Fisher."""
    m = F.create_map(*[x for nu_, q in quantile_rows(p) for x in (F.lit(nu_), F.lit(q))])
    z = _norm_ppf(p)
    g = [(z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
         (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
         (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160]
    v = nu.cast("double")
    cf = F.lit(z) + F.lit(g[0]) / v + F.lit(g[1]) / (v * v) + F.lit(g[2]) / (v * v * v) + F.lit(g[3]) / (v * v * v * v)
    return F.when(nu < 1, F.lit(None).cast("double")).when(nu <= TABLE_MAX, F.element_at(m, nu.cast("int"))).otherwise(cf)


# ---- SQL twins for the oracle ------------------------------------------------------------

def sql_t_abs_prob(t: str, nu: str) -> str:
    """DuckDB twin: closed-form series coefficients through lgamma, summed with list functions."""
    th = f"atan(abs({t}) / sqrt(({nu})::DOUBLE))"
    c2 = f"(cos({th}) * cos({th}))"
    # c_k = (2k)! / (4^k (k!)^2)
    even_sum = (f"coalesce(list_sum(list_transform(range(1, (({nu}) - 2) // 2 + 1), lambda tdj: "
                f"exp(lgamma(2 * tdj + 1) - 2 * lgamma(tdj + 1) - tdj * ln(4.0::DOUBLE)) * pow({c2}, tdj))), 0.0::DOUBLE)")
    # d_k = 4^k (k!)^2 / (2k+1)!
    odd_sum = (f"coalesce(list_sum(list_transform(range(1, (({nu}) - 3) // 2 + 1), lambda tdj: "
               f"exp(tdj * ln(4.0::DOUBLE) + 2 * lgamma(tdj + 1) - lgamma(2 * tdj + 2)) * pow({c2}, tdj))), 0.0::DOUBLE)")
    even = f"(sin({th}) * (1.0::DOUBLE + {even_sum}))"
    odd = (f"((2.0::DOUBLE / pi()) * ({th} + CASE WHEN ({nu}) >= 3 THEN sin({th}) * cos({th}) * "
           f"(1.0::DOUBLE + {odd_sum}) ELSE 0.0::DOUBLE END))")
    return f"(CASE WHEN ({nu}) % 2 = 0 THEN {even} ELSE {odd} END)"


def sql_t_two_sided_p(t: str, nu: str) -> str:
    return f"(1.0::DOUBLE - {sql_t_abs_prob(t, nu)})"


def sql_t_cdf(t: str, nu: str) -> str:
    return f"(0.5::DOUBLE + sign({t}) * {sql_t_abs_prob(t, nu)} / 2.0::DOUBLE)"


def sql_t_table_cte(p: float = 0.975, name: str = "t_table") -> str:
    vals = ", ".join(f"({nu}, {q!r}::DOUBLE)" for nu, q in quantile_rows(p))
    return f"{name}(nu, t_crit) AS (VALUES {vals})"
