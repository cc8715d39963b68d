"""Trend, dependence and structural change of annual series; principal components of indices.

A series' values travel as one list inside a row; the pair statistics (Mann-Kendall, Theil-Sen) work on that list by
merge counting and selection, in memory and time that follow its length, and never emit the pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.columns import KEY, so_far
from ebbflow.functions.special import f_pvalue, pnorm, qt, t_pvalue
from ebbflow.operators.moments import gram
from ebbflow.operators.orderings import FEW, Slopes, kendall_s
from ebbflow.operators.windows import ranked_values
from ebbflow.session import settle


# ---- linear trend ---------------------------------------------------------------------------

def ols(df: DataFrame, y: str, x: str = "year", key: str = KEY) -> DataFrame:
    """Least squares line per series with standard errors, t, p, R2 and F.  One aggregation."""
    fit = df.groupBy(key).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.nullif(F.regr_sxx(y, x), F.lit(0.0)).alias("sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.regr_avgx(y, x).alias("x_mean"))
    dof = F.col("n") - 2
    rss = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    fit = fit.withColumns({"dof": dof, "rss": rss})
    fit = fit.withColumn("sigma", F.when(F.col("dof") > 0, F.sqrt(F.col("rss") / F.col("dof"))))
    fit = fit.withColumns({
        "se_slope": F.col("sigma") / F.sqrt("sxx"),
        "se_intercept": F.col("sigma") * F.sqrt(1 / F.col("n") + F.col("x_mean") * F.col("x_mean")
                                                / F.col("sxx"))})
    fit = fit.withColumns({
        "t_slope": F.when(F.col("se_slope") > 0, F.col("slope") / F.col("se_slope")),
        "t_intercept": F.when(F.col("se_intercept") > 0, F.col("intercept") / F.col("se_intercept")),
        "adj_r2": F.when(F.col("dof") > 0, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / F.col("dof"))})
    return fit.withColumn("f_statistic", F.col("t_slope") * F.col("t_slope")).drop("_syy", "_sxy")


def ols_pvalues(fit: DataFrame) -> DataFrame:
    """Add two-sided p-values to the result rows of :func:`ols`."""
    dof = F.col("dof").cast("double")
    return fit.withColumns({"p_slope": t_pvalue(F.col("t_slope"), dof),
                            "p_intercept": t_pvalue(F.col("t_intercept"), dof)})


def ols_residuals(df: DataFrame, fit: DataFrame, y: str, x: str = "year", key: str = KEY) -> DataFrame:
    """Rows with fitted value and residual."""
    line = fit.select(key, "slope", "intercept")
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    return df.join(line, key).withColumn("fitted", fitted).withColumn(
        "resid", F.col(y) - F.col("fitted")).drop("slope", "intercept")


def trend_intervals(fit: DataFrame, first: int | Column, last: int | Column, level: float = 0.95,
                    key: str = KEY) -> DataFrame:
    """Confidence and prediction interval of the trend line on a grid of years, long."""
    half = qt(F.lit(1 - (1 - level) / 2), F.col("dof").cast("double"))
    grid = fit.withColumn("_t", half).withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    leverage = 1 / F.col("n") + (F.col("year") - F.col("x_mean")) ** 2 / F.col("sxx")
    grid = grid.withColumns({"fit": F.col("intercept") + F.col("slope") * F.col("year"),
                             "_h": leverage})
    kinds = F.explode(F.array(F.struct(F.lit("Confidence").alias("interval"), F.lit(0.0).alias("extra")),
                              F.struct(F.lit("Prediction").alias("interval"), F.lit(1.0).alias("extra"))))
    grid = grid.select("*", kinds.alias("_k"))
    width = F.col("_t") * F.col("sigma") * F.sqrt(F.col("_h") + F.col("_k.extra"))
    return grid.select(key, "year", "_k.interval", F.lit(level).alias("level"), "fit",
                       (F.col("fit") - width).alias("lwr"), (F.col("fit") + width).alias("upr"))


def mean_interval(df: DataFrame, value: str, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """Mean and its normal-theory confidence interval per group."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"),
                              F.count(value).alias("n"))
    half = qt(F.lit(1 - (1 - level) / 2), (F.col("n") - 1).cast("double")) * F.col("_sd") / F.sqrt("n")
    out = out.withColumn("_half", half)
    return out.select(*by, "n", "mean", (F.col("mean") - F.col("_half")).alias("lower"),
                      (F.col("mean") + F.col("_half")).alias("upper"))


# ---- Mann-Kendall and Theil-Sen --------------------------------------------------------------

# Fixed value: 97.5 % quantile of the standard normal distribution.
Z_975 = 1.959963984540054

_PAIR_STATISTICS = T.StructType([T.StructField(n, T.DoubleType()) for n in (
    "s", "var_s", "denominator", "slope", "intercept", "slope_lower", "slope_upper")])


@F.pandas_udf(_PAIR_STATISTICS)
def _pair_statistics(xs: pd.Series, ys: pd.Series, with_slopes: pd.Series) -> pd.DataFrame:
    """Statistics of all pairs of one series per row."""
    rows = []
    for x, y, slopes in zip(xs, ys, with_slopes, strict=True):
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = len(y)
        ties = np.unique(y, return_counts=True)[1].astype(float)
        count = n * (n - 1) // 2
        spread = (n * (n - 1) * (2 * n + 5) - np.sum(ties * (ties - 1) * (2 * ties + 5))) / 18
        row = [kendall_s(y), spread, math.sqrt(count) * math.sqrt(count - np.sum(ties * (ties - 1) / 2))]
        if slopes and n > 1:
            reach = Z_975 * math.sqrt(max(spread, 0.0))
            lower = int(max(np.rint((count - reach) / 2), 1))
            upper = int(min(np.rint((count + reach) / 2) + 1, count))
            steep = _slopes(x, y)
            middle = (steep((count + 1) // 2) + steep(count // 2 + 1)) / 2
            row += [middle, np.median(y - middle * x), steep(lower), steep(upper)]
        else:
            row += [None] * 4
        rows.append(row)
    return pd.DataFrame(rows, columns=_PAIR_STATISTICS.names)


def _slopes(x: np.ndarray, y: np.ndarray) -> Callable[[int], float]:
    """The ``k``-th smallest slope of all pairs, as a function of ``k``: a few pairs are sorted, of more it is selected."""
    if len(x) > FEW:
        return functools.cache(Slopes(x, y).smallest)
    later, earlier = np.tril_indices(len(x), -1)
    steep = np.sort((y[later] - y[earlier]) / (x[later] - x[earlier]))
    return lambda k: steep[k - 1]


def _short_lists(df: DataFrame, y: str, x: str, key: str) -> DataFrame:
    """The known values of each series as one sorted list ``p`` of ``(x, y)``."""
    points = F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"),
                                                  F.col(y).cast("double").alias("y"))))
    return df.where(F.col(y).isNotNull()).groupBy(key).agg(points.alias("p"))


def _pairwise(df: DataFrame, y: str, x: str, key: str, slopes: bool) -> DataFrame:
    """Pair statistics per series."""
    lists = _short_lists(df, y, x, key)
    stats = _pair_statistics(F.col("p.x"), F.col("p.y"), F.lit(slopes))
    return lists.select(key, F.size("p").alias("n"), stats.alias("k")).select(key, "n", "k.*")


def mann_kendall(df: DataFrame, y: str, x: str = "year", key: str = KEY) -> DataFrame:
    """Mann-Kendall S, tie-corrected variance, tau-b and two-sided normal p-value per series."""
    out = _pairwise(df, y, x, key, False)
    z = F.when(F.col("var_s") > 0, (F.col("s") - F.signum("s")) / F.sqrt("var_s"))
    out = out.withColumn("z", z).withColumn(
        "tau", F.when(F.col("denominator") > 0, F.col("s") / F.col("denominator")))
    return out.withColumn("p_value", F.least(2.0 * pnorm(-F.abs("z")), F.lit(1.0))).select(
        key, "n", "s", "var_s", "denominator", "tau", "z", "p_value")


def theil_sen(df: DataFrame, y: str, x: str = "year", key: str = KEY) -> DataFrame:
    """Median of all pairwise slopes, median intercept, and the 95 % interval of the slope."""
    return _pairwise(df, y, x, key, True).where("n > 1").select(
        key, "n", "slope", "intercept", "slope_lower", "slope_upper")


def trend_lines(df: DataFrame, y: str, x: str = "year", key: str = KEY) -> DataFrame:
    """Least squares and Theil-Sen line at every year of the series, long over the model."""
    a = ols(df, y, x, key).select(key, F.col("slope").alias("_s1"), F.col("intercept").alias("_i1"))
    b = theil_sen(df, y, x, key).select(key, F.col("slope").alias("_s2"), F.col("intercept").alias("_i2"))
    both = df.select(key, x).join(a.join(b, key), key)
    return both.select(key, x, (F.col("_i1") + F.col("_s1") * F.col(x)).alias("ols"),
                       (F.col("_i2") + F.col("_s2") * F.col(x)).alias("sen")).unpivot(
        [key, x], ["ols", "sen"], "model", "fitted")


# ---- structural change -----------------------------------------------------------------------

def chow_candidates(df: DataFrame, y: str, x: str = "year", slope: bool = False, trim: float = 0.15,
                    key: str = KEY) -> DataFrame:
    """F statistic of one break after each candidate year.

    Residual sums of squares left and right of every candidate come from running sums of centred
    moments: one sort per series, no refitting.
    """
    k = 2 if slope else 1
    whole, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(x)
    df = df.where(F.col(y).isNotNull()).select(key, x, y)
    df = df.withColumns({"_u": F.col(x) - F.avg(x).over(whole), "_v": F.col(y) - F.avg(y).over(whole),
                         "n": F.count(F.lit(1)).over(whole), "i": F.row_number().over(w)})
    u, v = F.col("_u"), F.col("_v")
    parts = {"u": u, "v": v, "uu": u * u, "uv": u * v, "vv": v * v}
    df = df.withColumns({f"_l{m}": F.sum(e).over(so_far(w)) for m, e in parts.items()}
                        | {f"_t{m}": F.sum(e).over(whole) for m, e in parts.items()})

    def rss(count: Column, p: dict[str, Column]) -> Column:
        vv = p["vv"] - p["v"] * p["v"] / count
        if not slope:
            return vv
        uu = p["uu"] - p["u"] * p["u"] / count
        uv = p["uv"] - p["u"] * p["v"] / count
        return F.when(uu > 0, vv - uv * uv / uu).otherwise(vv)

    left = {m: F.col(f"_l{m}") for m in parts}
    right = {m: F.col(f"_t{m}") - F.col(f"_l{m}") for m in parts}
    total = {m: F.col(f"_t{m}") for m in parts}
    n, i = F.col("n"), F.col("i")
    start = F.greatest(F.floor(n * F.lit(trim)), F.lit(k + 1))
    stop = F.least(n - F.floor(n * F.lit(trim)), n - k - 1)
    df = df.where((i >= start) & (i <= stop) & (n > 2 * k))
    df = df.withColumns({"rss0": rss(n, total), "rss1": rss(i, left) + rss(n - i, right)})
    f = F.when(F.col("rss1") > 0, (F.col("rss0") - F.col("rss1")) / (F.col("rss1") / (n - 2 * k)))
    return df.select(key, F.col(x).alias("break_after"), "i", "n", "rss0", "rss1", f.alias("f"))


def sup_f(df: DataFrame, y: str, x: str = "year", slope: bool = False, trim: float = 0.15,
          key: str = KEY) -> DataFrame:
    """Largest F statistic and its break (the earliest on a tie) per series."""
    c = chow_candidates(df, y, x, slope, trim, key)
    best = c.groupBy(key).agg(F.max(F.struct("f", (-F.col("i")).alias("_i"), "break_after", "n", "rss0",
                                             "rss1")).alias("b"))
    return best.select(key, F.col("b.f").alias("sup_f"), "b.break_after", "b.n", "b.rss0", "b.rss1")


def _segment_rss(y: np.ndarray, x: np.ndarray, slope: bool) -> np.ndarray:
    """Residual sum of squares of every segment [i, j] from prefix sums."""
    u, v = x - x.mean(), y - y.mean()
    sums = [np.concatenate([[0.0], np.cumsum(e)]) for e in (u, v, u * u, u * v, v * v)]
    n = len(y)
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    ok = j >= i
    su, sv, suu, suv, svv = (np.where(ok, s[np.minimum(j + 1, n)] - s[i], 0.0) for s in sums)
    m = np.where(ok, j - i + 1, 1)
    rss = svv - sv * sv / m
    if slope:
        xx, xy = suu - su * su / m, suv - su * sv / m
        rss = np.where(xx > 1e-12, rss - xy * xy / np.where(xx > 1e-12, xx, 1.0), rss)
    return np.where(ok, np.maximum(rss, 0.0), np.inf)


def optimal_breaks(x: np.ndarray, y: np.ndarray, slope: bool, trim: float, max_breaks: int
                   ) -> list[tuple[int, list[int], float, float | None]]:
    """``(m, breaks, rss, bic)`` of the best segmentations of one annual series, by dynamic programming."""
    n, k = len(y), 2 if slope else 1
    if n <= k + 1:
        return []
    h = max(int(math.floor(n * trim)), k + 1)
    rss = _segment_rss(y, x, slope)
    best, back = rss[0].copy(), []
    found = [(0, [], best[n - 1])]
    best[: h - 1] = np.inf
    for m in range(1, min(max_breaks, n // h - 1) + 1):
        step, origin = np.full(n, np.inf), np.zeros(n, int)
        ends, cuts = np.arange((m + 1) * h - 1, n), np.arange(m * h - 1, n - h)
        cost = best[cuts, None] + rss[cuts[:, None] + 1, ends]
        cost[cuts[:, None] > ends - h] = np.inf
        at = np.argmin(cost, axis=0)
        step[ends], origin[ends] = cost[at, np.arange(len(ends))], cuts[at]
        back.append(origin)
        end, breaks = n - 1, []
        for level in range(m - 1, -1, -1):
            end = back[level][end]
            breaks.append(int(x[end]))
        found.append((m, breaks[::-1], step[n - 1]))
        best = step
    return [(m, breaks, float(r), n * (math.log(2 * math.pi) + 1 + math.log(r / n))
             + (m + 1) * (k + 1) * math.log(n) if r > 0 else None) for m, breaks, r in found]


_SEGMENTATIONS = T.ArrayType(T.StructType([
    T.StructField("m", T.IntegerType()), T.StructField("breaks", T.ArrayType(T.IntegerType())),
    T.StructField("rss", T.DoubleType()), T.StructField("bic", T.DoubleType())]))


def breakpoints(df: DataFrame, y: str, x: str = "year", slope: bool = False, trim: float = 0.15,
                max_breaks: int = 5, key: str = KEY) -> DataFrame:
    """Best positions of 0..5 breaks with residual sum of squares and BIC per series.

    The dynamic programme runs on the short list of a series' annual values.  ``breaks`` lists the last
    year of each segment but the final one.
    """
    @F.pandas_udf(_SEGMENTATIONS)
    def solve(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([
            [{"m": m, "breaks": b, "rss": r, "bic": c} for m, b, r, c in
             optimal_breaks(np.asarray(u, float), np.asarray(v, float), slope, trim, max_breaks)]
            for u, v in zip(xs, ys, strict=True)])

    lists = _short_lists(df, y, x, key)
    table = lists.select(key, F.explode(solve(F.col("p.x"), F.col("p.y"))).alias("e"))
    return table.select(key, "e.*")


def best_breaks(table: DataFrame, key: str = KEY) -> DataFrame:
    """The segmentation with the smallest BIC (fewer breaks on a tie)."""
    return table.groupBy(key).agg(F.min(F.struct("bic", "m", "breaks", "rss")).alias("b")).select(
        key, "b.m", "b.breaks", "b.rss", "b.bic")


def _log_phi(z: float) -> float:
    """Logarithm of the standard normal distribution function, also far in the lower tail."""
    if z > -30:
        return math.log(0.5 * math.erfc(-z / math.sqrt(2)))
    return -0.5 * z * z - math.log(-z) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / z ** 2)


def break_date_cdf(x: float, xi: float, phi: float) -> float:
    """Limiting distribution of a scaled break date estimate (Bai 1997, appendix B)."""
    r, size = xi / phi, abs(x)
    root = math.sqrt(size)
    if x < 0:
        a, b = 0.5 * r * (1 + r), 0.5 + r
        c, d = phi * (phi + 2 * xi) / ((phi + xi) * xi), (phi + 2 * xi) ** 2 / ((phi + xi) * xi)
        return (-root * math.exp(-size / 8) / math.sqrt(2 * math.pi)
                - c * math.exp(a * size + _log_phi(-b * root))
                + (d - 2 + size / 2) * math.exp(_log_phi(-root / 2)))
    a, b = 0.5 * (phi + xi), (2 * phi + xi) / (2 * math.sqrt(phi))
    c, d = xi * (2 * phi + xi) / ((phi + xi) * phi), (xi + 2 * phi) ** 2 / ((phi + xi) * phi)
    return (1 + xi / math.sqrt(phi) * root * math.exp(-xi * xi * x / (8 * phi)) / math.sqrt(2 * math.pi)
            + c * math.exp(a * x + _log_phi(-b * root))
            + (-d + 2 - xi * xi * x / (2 * phi)) * math.exp(_log_phi(-xi * root / (2 * math.sqrt(phi)))))


def break_date_quantile(p: float, xi: float, phi: float) -> float:
    low, high = -1.0, 1.0
    while break_date_cdf(low, xi, phi) > p:
        low *= 2
    while break_date_cdf(high, xi, phi) < p:
        high *= 2
    for _ in range(80):
        middle = 0.5 * (low + high)
        low, high = (middle, high) if break_date_cdf(middle, xi, phi) < p else (low, middle)
    return 0.5 * (low + high)


def _label(x: np.ndarray, place: int) -> int:
    """The year at a place of the series; past its ends years are counted on."""
    inside = min(max(place, 0), len(x) - 1)
    return int(x[inside]) + place - inside


def _break_limits(x: np.ndarray, y: np.ndarray, breaks: Sequence[int], slope: bool, level: float
                  ) -> list[dict[str, int]]:
    edges = [0, *[int(np.searchsorted(x, b)) + 1 for b in breaks], len(x)]
    design = np.column_stack([np.ones(len(x)), x - x.mean()][: 2 if slope else 1])
    parts = [slice(a, b) for a, b in itertools.pairwise(edges)]
    fits = [np.linalg.lstsq(design[s], y[s], rcond=None)[0] for s in parts]
    spread = [float(np.mean((y[s] - design[s] @ f) ** 2)) for s, f in zip(parts, fits, strict=True)]
    out = []
    for i, b in enumerate(breaks):
        delta = fits[i + 1] - fits[i]
        left, right = (float(np.mean((design[s] @ delta) ** 2)) for s in parts[i:i + 2])
        if min(left, right, spread[i], spread[i + 1]) <= 0:
            out.append({"break_after": int(b), "lower": int(b), "upper": int(b)})
            continue
        xi = right / left
        phi = xi * spread[i + 1] / spread[i]  # variance of the right-hand process on the scale of the left
        unit = spread[i] / left
        low, high = (break_date_quantile(p, xi, phi) * unit for p in ((1 - level) / 2, (1 + level) / 2))
        at = int(np.searchsorted(x, b))
        out.append({"break_after": int(b), "lower": _label(x, at - math.ceil(high)), "upper": _label(x, at - math.floor(low))})
    return out


def break_intervals(df: DataFrame, breaks: DataFrame, y: str, x: str = "year", slope: bool = False,
                    level: float = 0.95, key: str = KEY) -> DataFrame:
    """Confidence interval of every break date; moments and variances may differ between segments.

    ``breaks`` holds ``key, breaks`` as given by :func:`best_breaks`.
    """
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType())
                                     for n in ("break_after", "lower", "upper")]))

    @F.pandas_udf(kind)
    def solve(xs: pd.Series, ys: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([_break_limits(np.asarray(u, float), np.asarray(v, float), list(b), slope, level)
                          for u, v, b in zip(xs, ys, at, strict=True)])

    lists = _short_lists(df, y, x, key).join(breaks.where("m > 0").select(key, "breaks"), key)
    out = lists.select(key, F.explode(solve(F.col("p.x"), F.col("p.y"), F.col("breaks"))).alias("e"))
    return out.select(key, "e.*")


def segment_fit(df: DataFrame, breaks: DataFrame, y: str, x: str = "year", key: str = KEY, slope: bool = False) -> DataFrame:
    """Mean (with ``slope``: trend line) of every segment between the breaks, joined to the years of the series.

    A segment without two different years has no trend; its mean is given.
    """
    joined = df.join(breaks.select(key, "breaks"), key)
    number = F.size(F.filter("breaks", lambda b: b < F.col(x))) + 1
    joined = joined.withColumn("segment", number)
    segment = Window.partitionBy(key, "segment")
    fitted = F.avg(y).over(segment)
    if slope:
        line = F.regr_intercept(F.col(y), F.col(x)).over(segment) + F.regr_slope(F.col(y), F.col(x)).over(segment) * F.col(x)
        fitted = F.coalesce(line, fitted)
    return joined.select(key, x, y, "segment", fitted.alias("fitted"))


def nested_anova(table: DataFrame, parameters: int = 1, key: str = KEY) -> DataFrame:
    """F test of one break against none, from the rows of :func:`sup_f`."""
    extra = parameters
    dof = F.col("n") - 2 * parameters
    f = ((F.col("rss0") - F.col("rss1")) / extra) / (F.col("rss1") / dof)
    out = table.withColumns({"df1": F.lit(extra), "df2": dof}).withColumn(
        "f", F.when((F.col("rss1") > 0) & (F.col("df2") > 0), f))
    return out.select(key, "rss0", "rss1", "df1", "df2", "f",
                      f_pvalue(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double"))
                      .alias("p_value"))


# ---- dependence between indices --------------------------------------------------------------

def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of index columns over complete rows, long.

    One aggregation of cross products; the pairs of columns are formed from its single row.
    """
    names = list(columns)
    size = len(names)
    row = gram(df, names)
    cells = F.explode(F.sequence(F.lit(0), F.lit(len(names) ** 2 - 1))).alias("c")
    cell = row.select("n", "g", cells).withColumns({
        "i": F.floor(F.col("c") / size).cast("int"), "j": (F.col("c") % size).cast("int")})

    def g(i: Column, j: Column) -> Column:
        return F.get("g", i * size + j)

    i, j = F.col("i"), F.col("j")
    spread = [g(k, k) for k in (i, j)]
    r = g(i, j) / F.sqrt(spread[0]) / F.sqrt(spread[1])
    labels = F.array(*[F.lit(c) for c in names])
    return cell.select(
        F.get(labels, i).alias("index"), F.get(labels, j).alias("index2"),
        F.when(i == j, 1.0).when((spread[0] > 0) & (spread[1] > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
        .alias("pearson"), "n")


def with_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank over all rows, without one global sort task.

    The rows are written once: the ranks of every column are derived from them.
    """
    base = settle(df)
    ranked = base
    for c in columns:
        ranks = ranked_values(base, [], c).select(F.col(c), F.col("rank_avg").alias("_r"))
        ranked = ranked.join(ranks, c, "left").drop(c).withColumnRenamed("_r", c)
    return ranked


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of every pair over complete rows: Pearson correlation of average ranks."""
    complete = df.select(*columns).dropna()
    return pearson_matrix(with_ranks(complete, columns), columns).withColumnRenamed("pearson", "spearman")


def correlation_test(matrix: DataFrame, name: str = "pearson", level: float = 0.95) -> DataFrame:
    """t statistic and p-value of each correlation, with a significance flag."""
    r, dof = F.col(name), F.col("n") - 2
    t = F.when((dof > 0) & (F.abs(r) < 1), r * F.sqrt(dof / (1 - r * r)))
    out = matrix.withColumn("t", t)
    p = F.coalesce(t_pvalue(F.col("t"), (F.col("n") - 2).cast("double")),
                   F.when(F.abs(F.col(name)) >= 1, 0.0))
    return out.withColumn("p_value", p).withColumn("significant", F.col("p_value") <= 1 - level)


def index_ranks(df: DataFrame, columns: Sequence[str], key: str = KEY) -> DataFrame:
    """Long table of the indices of each station with their rank inside the station (ties: lowest)."""
    long = df.select(key, *columns).unpivot(key, list(columns), "index", "value")
    rank = F.rank().over(Window.partitionBy(key).orderBy(F.col("value").asc_nulls_last()))
    return long.withColumn("rank", F.when(F.col("value").isNotNull(), rank))


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale each column by its sample standard deviation (one aggregation)."""
    stats = df.agg(*[f(c).alias(f"{p}{c}") for c in columns
                     for p, f in (("m_", F.avg), ("s_", F.stddev_samp))])
    one = stats.select(F.struct("*")).scalar()
    df = df.withColumn("_z", one)
    return df.withColumns({c: F.try_divide(F.col(c) - F.col(f"_z.m_{c}"), F.col(f"_z.s_{c}")) for c in columns}
                          ).drop("_z")


# ---- principal components --------------------------------------------------------------------

def pca_loadings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Principal components of the standardised columns.

    Only the cross products (one aggregation over all rows) reach the eigen solver.  The sign
    of a component is chosen so that its largest absolute loading is positive.  A constant column has no
    part in any component but one of its own, the last, with eigenvalue 0.
    """
    names = list(columns)
    p = len(names)
    row = gram(df, names)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for flat in pdf["g"]:
                cov = np.asarray(flat, float).reshape(p, p)
                spread = np.sqrt(np.diag(cov))
                scale = np.where(spread > 0, spread, 1.0)
                matrix = cov / np.outer(scale, scale)
                np.fill_diagonal(matrix, (spread > 0).astype(float))
                values, vectors = np.linalg.eigh(matrix)
                order = np.argsort(values)[::-1]
                eigen, vectors = np.maximum(values[order], 0.0), vectors[:, order]
                for j in range(p):
                    top = int(np.argmax(np.round(np.abs(vectors[:, j]), 10)))
                    if vectors[top, j] < 0:
                        vectors[:, j] = -vectors[:, j]
                share = eigen / max(eigen.sum(), 1e-300)
                yield pd.DataFrame([
                    (j + 1, names[i], vectors[i, j], math.sqrt(eigen[j]), eigen[j], share[j],
                     share[: j + 1].sum()) for j in range(p) for i in range(p)])

    return row.mapInPandas(solve, "component int, variable string, loading double, sdev double, "
                                  "eigenvalue double, proportion double, cumulative double")


def pca_scores(df: DataFrame, columns: Sequence[str], loadings: DataFrame, keep: int | None = None
               ) -> DataFrame:
    """Scores of every row on the first ``keep`` components."""
    names = list(columns)
    keep = keep or len(names)
    table = loadings.where(F.col("component") <= keep).agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("|", F.col("component").cast("string"), "variable"), "loading")))
        .alias("m")).scalar()
    z = zscores(df.dropna(subset=names), names).fillna(0.0, names).withColumn("_m", table)
    scores = {f"PC{j}": sum((F.col(c) * F.element_at("_m", F.lit(f"{j}|{c}")) for c in names[1:]),
                            F.col(names[0]) * F.element_at("_m", F.lit(f"{j}|{names[0]}")))
              for j in range(1, keep + 1)}
    return z.withColumns(scores).drop("_m", *names)
