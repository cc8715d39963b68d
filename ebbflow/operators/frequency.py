"""Extreme value statistics: plotting positions, L-moments, fits and return levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.columns import KEY
from ebbflow.functions.special import lgamma, reduced_variate
from ebbflow.operators.windows import ranked_values


def plotting_position(df: DataFrame, value: str = "am", key: str = KEY) -> DataFrame:
    """Rank (ties averaged), Weibull plotting position and empirical return period of minima."""
    w = Window.partitionBy(key).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(key, value))
    df = df.where(F.col(value).isNotNull()).withColumns({
        "rank": F.rank().over(w) + (ties - 1) / 2, "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    p = F.col("rank") / (F.col("_n") + 1)
    return df.withColumns({"prob_emp": p, "rp_emp": 1 / p}).drop("_n")


def lmoments(df: DataFrame, value: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Sample L-moments l1, l2 and ratios t3, t4 from probability weighted moments.

    Ties contribute the sum over their ranks, so the moments follow from the distinct values with
    their counts; no group is sorted in one task.
    """
    ranked = ranked_values(df, keys, value)
    n, first, total = F.col("n").cast("double"), F.col("rank_min").cast("double"), F.col("total").cast("double")
    # sums of (r-1), (r-1)(r-2), (r-1)(r-2)(r-3) over the ranks r = first .. first + n - 1
    a, b = first - 1, first + n - 1

    def falling(m: Column, k: int) -> Column:
        product = m
        for i in range(1, k):
            product = product * (m - i)
        return product

    weights = [n] + [(falling(b, k + 1) - falling(a, k + 1)) / (k + 1) for k in (1, 2, 3)]
    x = F.col(value)
    sums = ranked.groupBy(*keys).agg(F.max(total).alias("n"), *[
        F.sum(x * w).alias(f"_s{k}") for k, w in enumerate(weights)])
    m = F.col("n")
    b0 = F.col("_s0") / m
    # undefined moments of very short samples are NULL
    b1 = F.try_divide(F.col("_s1"), m * (m - 1))
    b2 = F.try_divide(F.col("_s2"), m * (m - 1) * (m - 2))
    b3 = F.try_divide(F.col("_s3"), m * (m - 1) * (m - 2) * (m - 3))
    moments = sums.select(*keys, "n", b0.alias("l1"), F.when(m > 1, 2 * b1 - b0).alias("l2"),
                          F.when(m > 2, 6 * b2 - 6 * b1 + b0).alias("_l3"),
                          F.when(m > 3, 20 * b3 - 30 * b2 + 12 * b1 - b0).alias("_l4"))
    nonzero = F.col("l2") != 0
    return moments.select(*keys, F.col("n").cast("bigint").alias("n"), "l1", "l2",
                          F.when(nonzero, F.col("_l3") / F.col("l2")).alias("t3"),
                          F.when(nonzero, F.col("_l4") / F.col("l2")).alias("t4"))


def fit_weibull(moments: DataFrame) -> DataFrame:
    """Two-parameter Weibull fit from l1 and l2: adds ``shape`` and ``scale``."""
    shape = F.when((F.col("l2") > 0) & (F.col("l2") < F.col("l1")),
                   -F.log(F.lit(2.0)) / F.log(1.0 - F.col("l2") / F.col("l1")))
    moments = moments.withColumn("shape", shape)
    return moments.withColumn("scale", F.col("l1") / F.exp(lgamma(1.0 + 1.0 / F.col("shape"))))


def cdf_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(1.0 - F.exp(-F.pow(x / scale, shape)))


def quantile_weibull(p: Column, shape: Column, scale: Column) -> Column:
    return scale * F.pow(-F.log(1.0 - p), 1.0 / shape)


def fit_exponential(moments: DataFrame) -> DataFrame:
    """Exponential fit: adds ``scale`` (2 l2) and ``location``."""
    return moments.withColumns({"scale": 2.0 * F.col("l2"),
                                "location": F.col("l1") - 2.0 * F.col("l2")})


def cdf_exponential(x: Column, location: Column, scale: Column) -> Column:
    return F.when(x <= location, 0.0).otherwise(1.0 - F.exp(-(x - location) / scale))


def fit_pareto(moments: DataFrame, bound: Column) -> DataFrame:
    """Generalised Pareto fit with known lower bound: adds ``location, scale, shape``."""
    shape = (F.col("l1") - bound) / F.nullif(F.col("l2"), F.lit(0.0)) - 2.0
    return moments.withColumn("location", bound.cast("double")).withColumn("shape", shape).withColumn(
        "scale", (1.0 + F.col("shape")) * (F.col("l1") - F.col("location")))


def quantile_pareto(p: Column, location: Column, scale: Column, shape: Column) -> Column:
    y = -F.log(1.0 - p)
    return location + scale * F.when(shape == 0, y).otherwise((1.0 - F.exp(-shape * y)) / shape)


def annual2pds(prob_annual: Column, rate: Column) -> Column:
    """Annual non-exceedance probability to that of a single event (``rate`` events per year)."""
    return 1.0 - (1.0 - prob_annual) / rate


def pds2annual(prob_pds: Column, rate: Column) -> Column:
    return 1.0 - (1.0 - prob_pds) * rate


def return_levels(fitted: DataFrame, periods: Sequence[int] = (10, 100, 200)) -> DataFrame:
    """T-year values of a partial duration series fitted by :func:`fit_pareto` (needs ``rate``)."""
    table = fitted.withColumn("return_period", F.explode(F.array(*[F.lit(t) for t in periods])))
    annual = 1.0 - 1.0 / F.col("return_period")
    table = table.withColumn("prob_annual", annual)
    table = table.withColumn("prob_pds", annual2pds(F.col("prob_annual"), F.col("rate")))
    valid = (F.col("prob_pds") >= 0) & (F.col("prob_pds") < 1)
    return table.withColumn("quantile", F.when(valid, quantile_pareto(
        F.col("prob_pds"), F.col("location"), F.col("scale"), F.col("shape"))))


def quantile_curve(fitted: DataFrame, step: float = 0.001, upper: float = 0.998) -> DataFrame:
    """Fitted quantiles on an even probability grid, with annual probability and reduced variate."""
    n = round(upper / step)
    grid = fitted.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    grid = grid.withColumn("prob_pds", F.col("_i") * F.lit(step)).drop("_i")
    grid = grid.withColumn("prob_annual", pds2annual(F.col("prob_pds"), F.col("rate")))
    return grid.withColumns({
        "quantile": quantile_pareto(F.col("prob_pds"), F.col("location"), F.col("scale"), F.col("shape")),
        "reduced_variate": F.when(F.col("prob_annual") < 1, reduced_variate(F.col("prob_annual")))})


def random_tie_rank(df: DataFrame, value: str, tie: str, key: str = KEY, seed: int = 42) -> DataFrame:
    """Ranks with ties in random but repeatable order (hash of the ``tie`` column)."""
    w = Window.partitionBy(key).orderBy(F.col(value), F.xxhash64(F.lit(seed), F.col(tie)), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w))
