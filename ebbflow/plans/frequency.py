"""Queries on plotting positions, distribution fits and return levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.columns import by_key
from ebbflow.functions.special import gamma, lgamma, pnorm, qnorm
from ebbflow.operators import events as ev
from ebbflow.operators import frequency as fr
from ebbflow.operators import indices as idx
from ebbflow.plans import fragments as sql
from ebbflow.plans.droughts import POOLED, POOLED_CTES, q90, shipping
from ebbflow.plans.registry import query
from ebbflow.session import settle
from ebbflow.sources import series

MONTHLY = """mon AS (SELECT series_id, year(time) * 12 + month(time) AS year, avg(value) AS value FROM supp GROUP BY 1, 2)"""

LMOM = """lr AS (SELECT {key} AS k, {x} AS x, row_number() OVER (PARTITION BY {key} ORDER BY {x}) AS r,
  count(*) OVER (PARTITION BY {key}) AS n FROM {source} WHERE {x} IS NOT NULL),
lb AS (SELECT k, max(n) AS n, sum(x) / max(n) AS b0, sum(x * (r - 1)) / nullif(max(n * (n - 1)), 0) AS b1,
  sum(x * (r - 1) * (r - 2)) / nullif(max(n * (n - 1) * CAST(n - 2 AS DOUBLE)), 0) AS b2,
  sum(x * (r - 1) * (r - 2) * CAST(r - 3 AS DOUBLE)) / nullif(max(CAST(n AS DOUBLE) * (n - 1) * (n - 2) * (n - 3)), 0) AS b3 FROM lr GROUP BY 1),
lm AS (SELECT k AS series_id, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / nullif(2 * b1 - b0, 0) AS t3,
  (20 * b3 - 30 * b2 + 12 * b1 - b0) / nullif(2 * b1 - b0, 0) AS t4 FROM lb)"""


def monthly_flow(spark, folder):
    """Mean flow per series and month; ``year`` is the running month number."""
    days = series.supplier_daily(spark, folder)
    month = F.year("time") * 12 + F.month("time")
    return days.groupBy("series_id", month.alias("year")).agg(F.avg("value").alias("value"))


@query("plotting_positions", "series_id:s year:i am:f4 rank:f2 prob_emp:f8 rp_emp:f6",
       sql.with_(sql.SUPP, "am_ AS (SELECT series_id, year(time) AS year, min(value) AS am FROM supp GROUP BY 1, 2)",
                 """rk AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY am) +
  (count(*) OVER (PARTITION BY series_id, am) - 1) / 2 AS rank, count(*) OVER (PARTITION BY series_id) AS n FROM am_)""")
       + "SELECT series_id, year, am, rank, rank / (n + 1) AS prob_emp, (n + 1) / rank AS rp_emp FROM rk")
def plotting_positions(spark, folder):
    """Empirical probability and return period of annual minima."""
    return fr.plotting_position(idx.annual_minima(series.supplier_daily(spark, folder), 1))


@query("l_moments", "series_id:s n:i l1:f6 l2:f6 t3:f6 t4:f6",
       sql.with_(sql.SUPP, LMOM.format(key="series_id", x="value", source="supp")) + "SELECT * FROM lm")
def l_moments(spark, folder):
    """L-moments of the daily flows of many series."""
    return fr.lmoments(series.supplier_daily(spark, folder), "value")


@query("global_l_moments", "n:i l1:f4 l2:f4 t3:f6 t4:f6",
       "WITH " + LMOM.format(key="1", x="l_extendedprice", source="lineitem") + " SELECT * FROM lm")
def global_l_moments(spark, folder):
    """L-moments of one group holding every row."""
    return fr.lmoments(series.table(spark, folder, "lineitem"), "l_extendedprice", [])


WEIBULL = """wb AS (SELECT series_id, n, l1, l2, -ln(2.0) / ln(1 - l2 / l1) AS shape FROM lm),
wf AS (SELECT *, l1 / gamma(1 + 1 / shape) AS scale FROM wb)"""


@query("weibull_fit", "series_id:s shape:f6 scale:f6 q10:f6 q50:f6 q100:f6 cdf_l1:f8",
       sql.with_(sql.SUPP, MONTHLY, LMOM.format(key="series_id", x="value", source="mon"), WEIBULL)
       + " SELECT series_id, shape, scale, " + ", ".join(
           f"scale * pow(-ln(1 - 1.0 / {t}), 1 / shape) AS q{t}" for t in (10, 50, 100))
       + ", 1 - exp(-pow(l1 / scale, shape)) AS cdf_l1 FROM wf")
def weibull_fit(spark, folder):
    """Weibull fit and T-year low flows."""
    fit = fr.fit_weibull(fr.lmoments(monthly_flow(spark, folder), "value"))
    shape, scale = F.col("shape"), F.col("scale")
    return fit.select("series_id", "shape", "scale", *[
        fr.quantile_weibull(F.lit(1.0 / t), shape, scale).alias(f"q{t}") for t in (10, 50, 100)],
        fr.cdf_weibull(F.col("l1"), shape, scale).alias("cdf_l1"))


@query("exponential_fit", "series_id:s location:f6 scale:f6 cdf_l1:f8",
       sql.with_(sql.SUPP, MONTHLY, LMOM.format(key="series_id", x="value", source="mon"))
       + """SELECT series_id, l1 - 2 * l2 AS location, 2 * l2 AS scale,
  CASE WHEN l1 <= l1 - 2 * l2 THEN 0 ELSE 1 - exp(-1.0) END AS cdf_l1 FROM lm""")
def exponential_fit(spark, folder):
    """Exponential fit."""
    fit = fr.fit_exponential(fr.lmoments(monthly_flow(spark, folder), "value"))
    return fit.withColumn("cdf_l1", fr.cdf_exponential(F.col("l1"), F.col("location"), F.col("scale")))


PDS = (*POOLED_CTES, f"num AS ({POOLED})",
       """major AS (SELECT series_id, CAST(dbt AS DOUBLE) AS duration, volume / 1000 AS volume,
  round_even(max(volume / 1000) OVER (PARTITION BY series_id) * 0.005, 0) AS lim FROM num),
obs AS (SELECT series_id || ' duration' AS series_id, duration AS value, 2.0 AS bound FROM major WHERE duration >= 2 AND volume >= lim
  UNION ALL SELECT series_id || ' volume', volume, lim FROM major WHERE duration >= 2 AND volume >= lim),
yrs AS (SELECT series_id, count(DISTINCT year(time)) AS years FROM fullc GROUP BY 1),
bnd AS (SELECT series_id, max(bound) AS bound, count(*) AS events FROM obs GROUP BY 1)""",
       LMOM.format(key="series_id", x="value", source="obs"),
       """gp AS (SELECT lm.series_id, l1, l2, bound, events / years AS rate, (l1 - bound) / nullif(l2, 0) - 2 AS shape FROM lm
  JOIN bnd USING (series_id) JOIN yrs ON yrs.series_id = split_part(lm.series_id, ' ', 1)),
gpf AS (SELECT *, (1 + shape) * (l1 - bound) AS scale FROM gp)""")


def pareto_fit(spark, folder):
    """Pareto fit of real duration and deficit volume of the partial duration series."""
    days = shipping(spark, folder)
    pooled = ev.drought_events(days, q90(), "inter-event", min_duration=5)
    # as in the partial duration series: limits on real duration and on a share of the largest volume
    events = pooled.select("series_id", "dbt", (F.col("volume") / 1e3).alias("volume"))
    events = events.withColumn("lim", F.rint(F.max("volume").over(by_key()) * 0.005))
    major = events.where((F.col("dbt") >= 2) & (F.col("volume") >= F.col("lim")))
    entries = F.array(
        F.struct(F.lit("duration").alias("metric"), F.col("dbt").cast("double").alias("value"),
                 F.lit(2.0).alias("bound")),
        F.struct(F.lit("volume").alias("metric"), F.col("volume").alias("value"), F.col("lim").alias("bound")))
    # the events are few; written once, they serve the moments and the bounds
    obs = settle(major.select("series_id", F.explode(entries).alias("e")).select("series_id", "e.*"))
    years = days.groupBy("series_id").agg(F.countDistinct(F.year("time")).alias("years"))
    moments = fr.lmoments(obs, "value", ["series_id", "metric"])
    bounds = obs.groupBy("series_id", "metric").agg(F.max("bound").alias("bound"))
    fit = fr.fit_pareto(moments.join(bounds, ["series_id", "metric"]), F.col("bound"))
    return fit.join(years, "series_id").withColumn("rate", F.col("n") / F.col("years"))


@query("return_levels", "series_id:s metric:s return_period:i prob_pds:f8 quantile:f4",
       sql.with_(*PDS, """rp AS (SELECT gpf.*, rp, 1 - (1.0 / rp) / rate AS p FROM gpf, (SELECT unnest([10, 100, 200]) AS rp))""")
       + """SELECT split_part(series_id, ' ', 1) AS series_id, split_part(series_id, ' ', 2) AS metric, rp AS return_period,
  p AS prob_pds, CASE WHEN p >= 0 AND p < 1 THEN bound + scale * (1 - exp(shape * ln(1 - p))) / shape END AS quantile FROM rp""")
def return_levels(spark, folder):
    """10-, 100- and 200-year drought duration and deficit."""
    return fr.return_levels(pareto_fit(spark, folder))


@query("return_level_table", "return_period:i series_id:s duration:f4 volume:f4",
       sql.with_(*PDS, """rp AS (SELECT gpf.*, rp, 1 - (1.0 / rp) / rate AS p FROM gpf, (SELECT unnest([10, 100, 200]) AS rp)),
q AS (SELECT split_part(series_id, ' ', 1) AS series_id, split_part(series_id, ' ', 2) AS metric, rp AS return_period,
  bound + scale * (1 - exp(shape * ln(1 - p))) / shape AS quantile FROM rp)""")
       + """SELECT series_id, return_period, max(quantile) FILTER (metric = 'duration') AS duration,
  max(quantile) FILTER (metric = 'volume') AS volume FROM q GROUP BY 1, 2""")
def return_level_table(spark, folder):
    """T-year events, one column per metric."""
    levels = fr.return_levels(pareto_fit(spark, folder))
    return levels.groupBy("series_id", "return_period").pivot("metric", ["duration", "volume"]).agg(
        F.first("quantile"))


@query("quantile_curve", "series_id:s metric:s prob_pds:f3 prob_annual:f6 quantile:f4",
       sql.with_(*PDS, "g AS (SELECT gpf.*, i * 0.001 AS p FROM gpf, (SELECT unnest(range(0, 999)) AS i))")
       + """SELECT split_part(series_id, ' ', 1) AS series_id, split_part(series_id, ' ', 2) AS metric, p AS prob_pds,
  1 - (1 - p) * rate AS prob_annual, bound + scale * (1 - exp(shape * ln(1 - p))) / shape AS quantile FROM g""")
def quantile_curve(spark, folder):
    """Fitted quantiles on a probability grid."""
    return fr.quantile_curve(pareto_fit(spark, folder))


@query("random_tie_ranks", "series_id:s days:i ranks:i rank_sum:i",
       sql.with_(sql.SUPP) + """SELECT series_id, count(*) AS days, count(*) AS ranks,
  count(*) * (count(*) + 1) // 2 AS rank_sum FROM supp GROUP BY 1""")
def random_tie_ranks(spark, folder):
    """Ranks with ties in random order are a permutation."""
    ranked = fr.random_tie_rank(series.supplier_daily(spark, folder), "value", "time")
    return ranked.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"), F.countDistinct("rank").alias("ranks"), F.sum("rank").alias("rank_sum"))


@query("special_functions", "p:f6 x:f8 back:f8 lg:f6 g:f6",
       f"""WITH v AS (SELECT DISTINCT l_discount + l_tax + 0.01 AS p, l_quantity AS q FROM lineitem),
z AS (SELECT p, q, {sql.qnorm('p')} AS x FROM v)
SELECT p, x, {sql.pnorm('x')} AS back, lgamma(q / 7 + 0.1) AS lg, gamma(1 + p) AS g FROM z""")
def special_functions(spark, folder):
    """Normal quantile and distribution function, gamma and its logarithm."""
    rows = series.table(spark, folder, "lineitem").select(
        (F.col("l_discount") + F.col("l_tax") + 0.01).alias("p"), F.col("l_quantity").alias("q")).distinct()
    rows = rows.withColumn("x", qnorm(F.col("p")))
    return rows.select("p", "x", pnorm(F.col("x")).alias("back"), lgamma(F.col("q") / 7 + 0.1).alias("lg"),
                       gamma(1 + F.col("p")).alias("g"))
