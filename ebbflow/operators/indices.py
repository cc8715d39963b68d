"""Flow duration curves, quantiles, annual minima and other low-flow indices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.columns import KEY, TIME, VALUE, by_key, in_time, with_columns
from ebbflow.functions.calendar import in_season, md_key, water_year
from ebbflow.functions.special import qnorm
from ebbflow.operators.clean import remove_incomplete_first_last
from ebbflow.operators.events import recession
from ebbflow.operators.thresholds import var_threshold
from ebbflow.operators.windows import moving_average

EXCEEDANCES = (0.95, 0.9, 0.8, 0.5)


def quantile_name(exceedance: float) -> str:
    return f"Q{round(exceedance * 100, 1):g}"


def _probabilities(exceedances: Sequence[float]) -> Column:
    return F.array(*[F.lit(round(1.0 - e, 12)) for e in exceedances])


def lfquantile(df: DataFrame, exceedances: Sequence[float] = EXCEEDANCES, key: str = KEY,
               value: str = VALUE) -> DataFrame:
    """Exact low-flow quantiles per series, one column ``Q95, Q90, ...`` each.

    All quantiles come out of one aggregate (one count table per series).
    """
    q = df.groupBy(key).agg(F.percentile(value, _probabilities(exceedances)).alias("_q"))
    return q.select(key, *[F.col("_q")[i].alias(quantile_name(e)) for i, e in enumerate(exceedances)])


def exceedance_frequency(df: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    """Add ``rank`` (1 = largest) and ``freq_exc`` (share of values at least as large)."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc_nulls_last())
    known = F.col(value).isNotNull()
    return df.withColumns({
        "rank": F.when(known, F.rank().over(w)),
        "freq_exc": F.when(known, F.rank().over(w) / F.count(value).over(by_key(key)))})


def fdc_value(fdc: DataFrame, p: float, key: str = KEY, value: str = VALUE) -> DataFrame:
    """Tabulated duration-curve flow: the flow at the largest frequency not above ``p``."""
    return fdc.where(F.col("freq_exc") <= p).groupBy(key).agg(
        F.max(F.struct("freq_exc", value))[value].alias(value), F.max("freq_exc").alias("freq_exc"))


def annual_minima(df: DataFrame, n: int | Sequence[int] = 1, origin: str | Sequence[str] = "-01-01",
                  na_rm: bool = False, omit_missing_years: bool = True, key: str = KEY,
                  time: str = TIME, value: str = VALUE) -> DataFrame:
    """Annual minima of the n-day moving average, long over ``n``: ``key, year, n, am``.

    Several ``n`` share one sort.  The first ``n - 1`` days of a series are ignored; a year with a
    NULL average is NULL unless ``na_rm``.  Two origins restrict the days to that season.
    """
    sizes = [n] if isinstance(n, int) else list(n)
    w = in_time(key, time)
    smooth = {f"_ma{k}": moving_average(F.col(value), k, "past", w) for k in sizes}
    df = df.select(key, time, value).withColumns(
        {"_row": F.row_number().over(w), **smooth, "year": water_year(F.col(time), origin)})
    if not isinstance(origin, str) and len(origin) == 2:
        df = df.where(in_season(F.col(time), *origin))
    aggs = []
    for k in sizes:
        counted = F.col("_row") >= k
        low = F.min(F.when(counted, F.col(f"_ma{k}")))
        holes = F.count_if(counted & F.col(f"_ma{k}").isNull())
        aggs.append((low if na_rm else F.when(holes == 0, low)).alias(f"_am{k}"))
    wide = df.groupBy(key, "year").agg(*aggs)
    long = wide.select(key, "year", F.explode(F.array(*[
        F.struct(F.lit(k).alias("n"), F.col(f"_am{k}").alias("am")) for k in sizes])).alias("e"))
    long = long.select(key, "year", "e.n", "e.am")
    return long.where(F.col("am").isNotNull()) if omit_missing_years else long


def mean_annual_minimum(df: DataFrame, n: int | Sequence[int] = 1,
                        origin: str | Sequence[str] = "-01-01", key: str = KEY, time: str = TIME,
                        value: str = VALUE) -> DataFrame:
    """MAM(n): mean of the annual minima, long over ``n``."""
    return (annual_minima(df, n, origin, key=key, time=time, value=value)
            .groupBy(key, "n").agg(F.avg("am").alias("mam")))


def annual_summary(df: DataFrame, origin: str = "-01-01", key: str = KEY, time: str = TIME,
                   value: str = VALUE) -> DataFrame:
    """Annual minimum and mean flow."""
    return df.groupBy(key, water_year(F.col(time), origin).alias("year")).agg(
        F.min(value).alias("min_flow"), F.avg(value).alias("mean_flow"))


def station_indices(df: DataFrame, key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """Low-flow indices per station: mean, quantiles, MAM, recession constant, ratios to Q50.

    The families of indices are aggregated separately from the same daily rows (the shuffle by series is
    planned once and reused) and meet in joins that are already partitioned by series.
    """
    probs = (0.5, 0.95, 0.9, 0.7)
    base = df.groupBy(key).agg(F.avg(value).alias("mean_flow"),
                               F.percentile(value, _probabilities(probs)).alias("_q"))
    base = base.select(key, "mean_flow", *[F.col("_q")[i].alias(quantile_name(p))
                                           for i, p in enumerate(probs)])
    mam = (mean_annual_minimum(df, (1, 10, 30), key=key, time=time, value=value)
           .groupBy(key).agg(*[F.max(F.when(F.col("n") == k, F.col("mam"))).alias(f"MAM{k}")
                               for k in (1, 10, 30)]))
    alpha = recession(df, key=key, time=time, value=value).select(key, F.col("alpha").alias("ALPHA"))
    all_ = base.join(mam, key, "left").join(alpha, key, "left")
    ratio = {f"{c}_Q50": F.when(F.col("Q50") != 0, F.col(c) / F.col("Q50"))
             for c in ("Q90", "Q95", "MAM30", "MAM10", "MAM1")}
    return all_.withColumns(ratio)


def sgi(df: DataFrame, by: Sequence[str | Column], value: str = VALUE) -> DataFrame:
    """Standardised index: normal score of the average rank within each group; NULL stays NULL."""
    groups = list(by)
    w = Window.partitionBy(*groups).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*groups, value)
    known = F.col(value).isNotNull()
    df = with_columns(df, [
        {"rank": F.when(known, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2),
         "_n": F.count(value).over(Window.partitionBy(*groups))},
        {"standardised_rank": F.col("rank") / (F.col("_n") + 1)},
        {"sgi": qnorm(F.col("standardised_rank"))}])
    return df.drop("_n")


def daily_envelope(df: DataFrame, key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """Smallest and largest flow per month-day."""
    return df.groupBy(key, md_key(F.col(time)).alias("md")).agg(
        F.min(value).alias("flow_min"), F.max(value).alias("flow_max"))


def extreme_years(df: DataFrame, origin: str = "-01-01", key: str = KEY, time: str = TIME,
                  value: str = VALUE) -> DataFrame:
    """Wettest and driest year: largest (smallest) sum of squared flows above (below) the year's own
    median.  The earlier year wins a tie.
    """
    year = water_year(F.col(time), origin).alias("year")
    q = F.col(value)
    per_year = Window.partitionBy(key, "year")
    days = df.select(key, year, value)
    days = days.withColumn("_median", F.percentile(value, F.lit(0.5)).over(per_year))
    years = days.groupBy(key, "year").agg(
        F.sum(F.when(q < F.col("_median"), q * q).otherwise(0.0)).alias("resid_dry"),
        F.sum(F.when(q > F.col("_median"), q * q).otherwise(0.0)).alias("resid_wet"))
    picked = years.groupBy(key).agg(
        F.min(F.struct(-F.col("resid_wet"), F.col("year").alias("y")))["y"].alias("wet"),
        F.min(F.struct(F.col("resid_dry"), F.col("year").alias("y")))["y"].alias("dry"))
    return picked.unpivot(key, ["wet", "dry"], "state", "year")


def extreme_year_labels(df: DataFrame, origin: str = "-01-01", key: str = KEY, time: str = TIME,
                        value: str = VALUE) -> DataFrame:
    """Lowest day of the driest and highest day of the wettest year, with a label."""
    years = extreme_years(df, origin, key, time, value)
    days = df.withColumn("year", water_year(F.col(time), origin)).join(years, [key, "year"])
    low = F.min(F.struct(F.col(value).alias("q"), F.col(time).alias("t")))
    high = F.min(F.struct((-F.col(value)).alias("q"), F.col(time).alias("t")))
    marks = days.where(F.col(value).isNotNull()).groupBy(key, "state", "year").agg(
        low.alias("lo"), high.alias("hi"))
    dry = F.col("state") == "dry"
    marks = marks.select(key, "state", "year", F.when(dry, F.col("lo.t")).otherwise(F.col("hi.t"))
                         .alias(time),
                         F.when(dry, F.col("lo.q")).otherwise(-F.col("hi.q")).alias(value))
    return marks.withColumn("label", F.concat(F.col(time).cast("string"), F.lit(": "),
                                              F.round(value, 3).cast("string"), F.lit(" m³/s")))


def daily_quantiles(df: DataFrame, exceedances: Sequence[float] = EXCEEDANCES,
                    origin: str = "-01-01", key: str = KEY, time: str = TIME, value: str = VALUE
                    ) -> DataFrame:
    """Quantile curves per month-day, long over the exceedance frequency."""
    complete = remove_incomplete_first_last(df, origin=origin, key=key, time=time, value=value)
    probs = _probabilities(exceedances)
    table = var_threshold(complete, "day", lambda q: F.percentile(q, probs), origin, key, time, value).table
    names = F.array(*[F.lit(quantile_name(e)) for e in exceedances])
    return table.select(key, F.col("day").alias("md"), F.posexplode("threshold").alias("_i", "flow")
                        ).select(key, "md", F.element_at(names, F.col("_i") + 1).alias("exc_freq"),
                                 "flow")


def events_per_year(events: DataFrame, origin: str = "-01-01", key: str = KEY) -> DataFrame:
    """Number of events, real duration and lowest flow per hydrological year of the event start."""
    duration = "dbt" if "dbt" in events.columns else "duration"
    return events.groupBy(key, water_year(F.col("first_day"), origin).alias("year")).agg(
        F.count(F.lit(1)).alias("n_droughts"), F.sum(duration).alias("real_duration"),
        F.min("qmin").alias("min_flow"))


def partial_duration_series(events: DataFrame, years: DataFrame, min_days: int = 5,
                            min_share: float = 0.005, origin: str = "-01-01", key: str = KEY
                            ) -> tuple[DataFrame, DataFrame]:
    """Major events (real duration and volume in 1000 m3) and the years without any."""
    events = events.select(key, "event", "first_day", F.col("dbt").cast("double").alias("duration"),
                           (F.col("volume") / 1e3).alias("volume"))
    limit = F.rint(F.max("volume").over(Window.partitionBy(key)) * min_share)
    major = (events.withColumn("_limit", limit)
             .where((F.col("duration") >= min_days) & (F.col("volume") >= F.col("_limit")))
             .withColumn("year", water_year(F.col("first_day"), origin)))
    return major.drop("_limit"), years.join(major, [key, "year"], "left_anti")


def histogram(df: DataFrame, value: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of a fixed width: ``bin`` is the lower edge."""
    edge = (F.floor(F.col(value) / F.lit(float(width))) * F.lit(float(width))).alias("bin")
    return df.where(F.col(value).isNotNull()).groupBy(*by, edge).agg(F.count(F.lit(1)).alias("n"))


def sturges_histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``ceil(log2 n) + 1`` equal bins per group (upper edge closed)."""
    groups = list(by)
    known = df.where(F.col(value).isNotNull())
    shape = known.groupBy(*groups).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        (F.ceil(F.log2(F.count(F.lit(1)))) + 1).cast("int").alias("bins"))
    if groups:
        known = known.join(shape, groups)
    else:
        known = known.withColumn("_s", shape.select(F.struct("*")).scalar()).select("*", "_s.*")
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    spot = F.greatest(F.ceil((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(1))
    return (known.withColumn("_w", width)
            .withColumn("bin", F.when(F.col("_w") > 0, F.least(spot, F.col("bins"))).otherwise(1)
                        .cast("int"))
            .groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("bins").alias("bins"),
                                         (F.max("_lo") + F.max("_w") * (F.col("bin") - 1)).alias("lower")))


def whittaker(df: DataFrame, by: Sequence[str], position: str = "md", value: str = "flow",
              lam: float = 1600.0) -> DataFrame:
    """Smooth curves by penalised least squares (second differences); adds ``smoothed``.

    One curve of at most 366 points per group; the groups are solved in parallel.  Values below
    0.00025 become 0 and those below 0.0005 become 0.0005, as suits a logarithmic axis.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("smoothed", T.DoubleType())])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        z = _smoothed(pdf[value].to_numpy(float), lam)
        z = np.where(z < 0.00025, 0.0, np.where(z < 0.0005, 0.0005, z))
        return pdf.assign(smoothed=z)

    return df.groupBy(*by).applyInPandas(smooth, schema)


def _smoothed(y: np.ndarray, lam: float) -> np.ndarray:
    """Solve ``(I + lam D'D) z = y`` for second differences ``D``: five bands, factorised in one sweep and solved in another."""
    n = len(y)
    diagonal, next1, next2 = np.ones(n + 2), np.zeros(n + 2), np.zeros(n + 2)
    for shift, weight in ((0, 1.0), (1, 4.0), (2, 1.0)):
        diagonal[shift:shift + max(n - 2, 0)] += lam * weight
    for shift in (0, 1):
        next1[shift:shift + max(n - 2, 0)] -= 2 * lam
    next2[:max(n - 2, 0)] = lam
    # Entries -1 and -2, before the first row, are the two spare ones at the end.
    d, c, e, z = np.zeros(n + 2), np.zeros(n + 2), np.zeros(n + 2), np.zeros(n + 2)
    for i in range(n):
        d[i] = diagonal[i] - d[i - 1] * c[i - 1] ** 2 - d[i - 2] * e[i - 2] ** 2
        c[i] = (next1[i] - d[i - 1] * c[i - 1] * e[i - 1]) / d[i]
        e[i] = next2[i] / d[i]
        z[i] = y[i] - c[i - 1] * z[i - 1] - e[i - 2] * z[i - 2]
    for i in range(n - 1, -1, -1):
        z[i] = z[i] / d[i] - c[i] * z[i + 1] - e[i] * z[i + 2]
    return z[:n]
