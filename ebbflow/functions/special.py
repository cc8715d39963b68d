"""Special functions missing from Spark SQL.

The normal distribution and log-gamma are column expressions.  Student-t and F tails need an
iterative expansion; they are Arrow functions meant for *result* rows (one per series or model).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner evaluation, highest power first."""
    result = F.lit(coefficients[0])
    for c in coefficients[1:]:
        result = result * x + F.lit(c)
    return result


# Rational approximation of the normal quantile (Wichura 1988, algorithm AS 241).
# Numerators and denominators, highest power first.
QNORM_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
QNORM_MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
     1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959,
     1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
     0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
     2.05319162663775882187, 1.0),
)
QNORM_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
     0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
     5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
     7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
     0.59983220655588793769, 1.0),
)


def qnorm(p: Column) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    q = p - 0.5
    central = 0.180625 - q * q
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1.0 - p)))
    tail = F.when(r <= 5.0, _poly(r - 1.6, QNORM_MIDDLE[0]) / _poly(r - 1.6, QNORM_MIDDLE[1])) \
            .otherwise(_poly(r - 5.0, QNORM_TAIL[0]) / _poly(r - 5.0, QNORM_TAIL[1]))
    return (F.when((p <= 0) | (p >= 1), None)
            .when(F.abs(q) <= 0.425,
                  q * _poly(central, QNORM_CENTRE[0]) / _poly(central, QNORM_CENTRE[1]))
            .otherwise(F.when(q < 0, -tail).otherwise(tail)))


# Normal distribution function (Hart 1968), highest power first.
PNORM_RATIO = (
    (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
     112.079291497871, 221.213596169931, 220.206867912376),
    (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
     296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def pnorm(x: Column) -> Column:
    """Standard normal distribution function (absolute error about 1e-15)."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    upper = (F.when(a > 37.0, 0.0)
             .when(a < 7.07106781186547, density * _poly(a, PNORM_RATIO[0]) / _poly(a, PNORM_RATIO[1]))
             .otherwise(density / fraction / math.sqrt(2.0 * math.pi)))
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


# Lanczos approximation of the gamma function, g = 7, nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + float(i))
    t = x + 6.5
    return 0.5 * math.log(2.0 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(total)


def gamma(x: Column) -> Column:
    return F.exp(lgamma(x))


def plogis(x: Column) -> Column:
    """Logistic distribution function (inverse logit)."""
    return 1.0 / (1.0 + F.exp(-x))


def logit2prop(x: Column) -> Column:
    return plogis(x)


def reduced_variate(p: Column) -> Column:
    """Exponential reduced variate -ln(1 - p)."""
    return -F.log(1.0 - p)


def specific_discharge(flow: Column, area_km2: Column) -> Column:
    """m3/s and km2 to litres per second and km2."""
    return flow * 1000.0 / area_km2


def per_second(per_day: Column) -> Column:
    return per_day / 86400.0


# English names of the numbers one to twelve.
_NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
                 "eleven", "twelve")


def number_words(n: Column) -> Column:
    """Numbers up to twelve in words, larger ones in digits."""
    words = F.array(*[F.lit(w) for w in _NUMBER_WORDS])
    return F.when(n.between(1, 12), F.element_at(words, F.when(n.between(1, 12), n).otherwise(1)
                                                 .cast("int"))).otherwise(n.cast("string"))


def join_with_and(items: Column, sep: str = ", ", final: str = " and ") -> Column:
    """``[a, b, c]`` -> ``a, b and c``."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), sep)
    tail = F.try_element_at(items, F.lit(-1)).cast("string")
    return F.when(F.size(items) <= 1, tail).otherwise(F.concat(head, F.lit(final), tail))


# ---- Student t and F, vectorised over result rows -------------------------------------------

def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(a + b)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, continued fraction in Lentz form."""
    x, a, b = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1.0) / (a + b + 2.0)
    xx, aa, bb = np.where(flip, 1.0 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300

    def guard(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(xx)
    d = 1.0 / guard(1.0 - (aa + bb) * xx / (aa + 1.0))
    h = d.copy()
    for m in range(1, 1000):
        even = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - _log_beta(aa, bb)) / aa
    value = np.where(xx <= 0.0, 0.0, front * h)
    return np.where(flip, 1.0 - value, value)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return incomplete_beta(dof / (dof + t * t), dof / 2.0, np.full_like(dof, 0.5))


def t_quantile(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Quantile by bisection on the two-sided tail (p > 0.5 by symmetry)."""
    p, dof = np.broadcast_arrays(np.asarray(p, float), np.asarray(dof, float))
    tail = 2.0 * np.where(p < 0.5, p, 1.0 - p)
    lo, hi = np.zeros_like(tail), np.full_like(tail, 1e3)
    while np.any(grow := t_two_sided(hi, dof) > tail):
        hi = np.where(grow, hi * 10.0, hi)
        if np.max(hi) > 1e15:
            break
    for _ in range(120):
        mid = 0.5 * (lo + hi)
        above = t_two_sided(mid, dof) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(p < 0.5, -hi, hi)


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def _masked(fn, *cols: pd.Series) -> pd.Series:
    arrays = [c.to_numpy(dtype=float) for c in cols]
    ok = np.all([np.isfinite(a) for a in arrays], axis=0)
    ok &= np.all([a > 0 for a in arrays[1:]], axis=0)
    out = np.full(len(cols[0]), np.nan)
    if ok.any():
        out[ok] = fn(*[a[ok] for a in arrays])
    return pd.Series(out).where(ok, None).astype("Float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return _masked(t_two_sided, t, dof)


@F.pandas_udf(DoubleType())
def qt(p: pd.Series, dof: pd.Series) -> pd.Series:
    """Student-t quantile."""
    return _masked(t_quantile, p, dof)


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    return _masked(f_upper, f, d1, d2)
