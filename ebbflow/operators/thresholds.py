"""Constant and seasonally varying thresholds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ebbflow.columns import KEY, TIME, VALUE
from ebbflow.functions.calendar import group_ts, is_leap_year, md_key, water_year

Aggregate = Callable[[Column], Column]

# Splits the 53 binary digits of a double in two.
SPLIT = float(2 ** 27 + 1)


@dataclass(frozen=True)
class Threshold:
    """A threshold table together with the rule that derives its period key from a date."""

    table: DataFrame
    vary_by: str | None = None
    origin: str | Sequence[str] | Mapping[str, str] = "-01-01"

    def attach(self, df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
        """Left-join the threshold to the days.  Spark chooses the join from the table's real size."""
        if self.vary_by is None:
            return df.join(self.table, key, "left")
        by = self.vary_by
        return (df.withColumn(by, group_ts(F.col(time), by, self.origin))
                .join(self.table, [key, by], "left"))


def quantile(exceedance: float) -> Aggregate:
    """Flow exceeded in the given share of time, as an aggregate for the threshold functions."""
    return lambda q: F.percentile(q, F.lit(round(1.0 - exceedance, 12)))


def const_threshold(df: DataFrame, fun: Aggregate | Mapping[str, Aggregate], key: str = KEY,
                    value: str = VALUE) -> Threshold:
    """One threshold per series.  Several functions give several columns."""
    funs = fun if isinstance(fun, Mapping) else {"threshold": fun}
    aggs = [f(F.col(value)).alias(name) for name, f in funs.items()]
    return Threshold(df.where(F.col(value).isNotNull()).groupBy(key).agg(*aggs))


def var_threshold(df: DataFrame, vary_by: str, fun: Aggregate | Mapping[str, Aggregate],
                  start: str | Sequence[str] | Mapping[str, str] = "-01-01", key: str = KEY,
                  time: str = TIME, value: str = VALUE) -> Threshold:
    """One threshold per series and period.

    With ``vary_by="day"`` every normal year contributes a Feb 29 that is the mean of its Feb 28 and
    Mar 1, so that all 366 slots rest on the same number of years.
    """
    funs = fun if isinstance(fun, Mapping) else {"threshold": fun}
    known = df.where(F.col(value).isNotNull())
    days = known.select(key, group_ts(F.col(time), vary_by, start).alias(vary_by), value)
    if vary_by == "day":
        t = F.col(time)
        around = (df.where(md_key(t).isin(228, 301) & ~is_leap_year(F.year(t)))
                  .groupBy(key, water_year(t, start).alias("_year"))
                  .agg(F.avg(value).alias(value), F.count_if(F.col(value).isNull()).alias("_gap")))
        leap = around.where((F.col("_gap") == 0) & F.col(value).isNotNull()).select(
            key, F.lit(229).alias(vary_by), value)
        days = days.unionByName(leap)
    aggs = [f(F.col(value)).alias(name) for name, f in funs.items()]
    return Threshold(days.groupBy(key, vary_by).agg(*aggs), vary_by, start)


def period_threshold(vary_by: str, fun: Aggregate, start: str | Sequence[str] | Mapping[str, str] = "-01-01",
                     key: str = KEY, time: str = TIME, value: str = VALUE) -> Column:
    """The threshold of each day's period as a window over the placed days: no second scan and no join.

    Not for ``vary_by="day"``, where :func:`var_threshold` adds the synthetic leap days.
    """
    if vary_by == "day":
        raise ValueError("daily thresholds need var_threshold")
    return fun(F.col(value)).over(Window.partitionBy(key, group_ts(F.col(time), vary_by, start)))


def series_quantile(value: str, p: float, window: WindowSpec) -> Column:
    """Interpolated (type 7) quantile over the whole of a window, as close as a double can be.

    ``percentile`` rounds both parts of ``lower * (1 - d) + upper * d`` and their sum, which may end one unit in the last
    place off a mean that equals the quantile.  Here the order statistics either side are taken as they are, and
    the error of the first product goes into the sum.
    """
    at = F.percentile(value, F.lit(p)).over(window)
    low = F.max(F.when(F.col(value) <= at, F.col(value))).over(window)
    high = F.min(F.when(F.col(value) >= at, F.col(value))).over(window)
    place = (F.count(value).over(window) - 1) * F.lit(float(p))
    part = place - F.floor(place)
    near, error = _exact_product(low, 1 - part)
    far = high * part
    total = near + far
    back = total - near
    rest = (near - (total - back)) + (far - back)
    return F.when((part == 0) | (low == high), at).otherwise(total + (rest + error))


def _exact_product(a: Column, b: Column) -> tuple[Column, Column]:
    """The product of two columns and its rounding error (both halves of a factor have 26 digits)."""
    def halves(c: Column) -> tuple[Column, Column]:
        upper = c * SPLIT - (c * SPLIT - c)
        return upper, c - upper

    product = a * b
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return product, ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2


def append_threshold(df: DataFrame, threshold: Threshold, key: str = KEY, time: str = TIME
                     ) -> DataFrame:
    """The days themselves with their threshold (synthetic leap days stay out)."""
    return threshold.attach(df, key, time)
