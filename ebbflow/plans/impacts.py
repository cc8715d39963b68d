"""Queries on impacts, forecast skill, scenarios and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.columns import by_key
from ebbflow.functions.calendar import month_day_label
from ebbflow.operators import events as ev
from ebbflow.operators import impact as im
from ebbflow.operators import indices as idx
from ebbflow.operators import skill as sk
from ebbflow.operators.clean import add_missing_days
from ebbflow.operators.windows import exact_quantiles
from ebbflow.plans import flows
from ebbflow.plans import fragments as sql
from ebbflow.plans.registry import QUERIES, query
from ebbflow.sources import series

# ---- forecast skill --------------------------------------------------------------------------

HOURLY = """hr AS (SELECT date_trunc('hour', ts) AS hour, user_id % 50 AS member, avg(value) AS value FROM events GROUP BY 1, 2),
ob AS (SELECT date_trunc('hour', ts) AS hour, min(value) AS obs FROM events GROUP BY 1),
q AS (SELECT quantile_cont(obs, 0.1) AS q90 FROM ob),
pr AS (SELECT hour, avg(CASE WHEN value < 4 * q90 + 10 THEN 1.0 ELSE 0.0 END) AS probability FROM hr, q GROUP BY 1)"""


def _ensemble(spark, folder):
    events = series.table(spark, folder, "events")
    hour = F.date_trunc("hour", "ts").alias("hour")
    members = events.groupBy(hour, (F.col("user_id") % 50).alias("member")).agg(F.avg("value").alias("value"))
    observed = events.groupBy(hour).agg(F.min("value").alias("obs"))
    q90 = exact_quantiles(observed, [], "obs", [0.1], ["q90"]).select("q90")
    return members, observed, q90


@query("ensemble_probability", "hour:s probability:f6 event:i",
       sql.with_(HOURLY) + """SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, probability, CASE WHEN obs < q90 THEN 1 ELSE 0 END AS event
FROM pr JOIN ob USING (hour), q""")
def ensemble_probability(spark, folder):
    """Share of ensemble members below the threshold and the observed event."""
    return _pairs(spark, folder).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


def _pairs(spark, folder):
    members, observed, q90 = _ensemble(spark, folder)
    prob = sk.event_probability(members.withColumn("limit", q90.scalar() * 4 + 10), F.col("limit"), "hour")
    event = F.when(F.col("obs") < F.col("q90"), 1).otherwise(0)
    return prob.join(observed.withColumn("q90", q90.scalar()), "hour").withColumn("event", event)


@query("brier_skill", "n:i brier:f8 brier_benchmark:f8 skill:f8",
       sql.with_(HOURLY) + """SELECT count(*) AS n, avg(pow(probability - e, 2)) AS brier, avg(pow(0.1 - e, 2)) AS brier_benchmark,
  (avg(pow(probability - e, 2)) - avg(pow(0.1 - e, 2))) / (0 - avg(pow(0.1 - e, 2))) AS skill
FROM (SELECT probability, CASE WHEN obs < q90 THEN 1.0 ELSE 0.0 END AS e FROM pr JOIN ob USING (hour), q)""")
def brier_skill(spark, folder):
    """Brier score of the ensemble and its skill over climatology."""
    return sk.brier_skill(_pairs(spark, folder))


@query("ensemble_unpivot", "year:i member:s value:f4",
       """WITH y AS (SELECT year(o_orderdate) AS year, o_orderpriority AS member, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT year, 'm' || left(member, 1) AS member, value FROM y""")
def ensemble_unpivot(spark, folder):
    """Wide ensemble table back to one row per member."""
    orders = series.table(spark, folder, "orders")
    wide = orders.groupBy(F.year("o_orderdate").alias("year")).pivot(
        "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.avg("o_totalprice"))
    names = [f"m{c[0]}" if c != "year" else c for c in wide.columns]
    return sk.ensemble_long(wide.toDF(*names), names[1:])


@query("five_number_summary", "l_returnflag:s n:i min:f2 q25:f4 median:f4 q75:f4 max:f2",
       """SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS q25,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q75, max(l_extendedprice) AS max
FROM lineitem GROUP BY 1""")
def five_number_summary(spark, folder):
    """Exact quartiles of very large groups."""
    return sk.five_numbers(series.table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice")


# ---- scenarios -------------------------------------------------------------------------------

@query("scenario_change", "series_id:s characteristic:s benchmark:f4 influenced:f4 change_percent:f4",
       sql.with_(sql.SHIP, sql.full("ship"), """thr AS (SELECT series_id, quantile_cont(value, 0.2) AS threshold FROM fullc GROUP BY 1),
sc AS (SELECT series_id || '|benchmark' AS series_id, time, value, threshold FROM fullc JOIN thr USING (series_id)
  UNION ALL SELECT series_id || '|influenced', time, value * CASE WHEN month(time) BETWEEN 5 AND 9 THEN 0.75 ELSE 1.0 END, threshold FROM fullc JOIN thr USING (series_id)),
days AS (SELECT *, (threshold - value) * 86400.0 AS volume, CASE WHEN value IS NULL THEN 2 WHEN value < threshold THEN 1 ELSE 0 END AS st FROM sc)""",
                 sql.run_id("st", "days", "runs"),
                 "e AS (SELECT series_id, run, count(*) AS duration, sum(volume) AS volume FROM runs WHERE st = 1 GROUP BY 1, 2)",
                 """c AS (SELECT split_part(series_id, '|', 1) AS series_id, avg(duration) FILTER (series_id LIKE '%benchmark') AS db,
  avg(duration) FILTER (series_id LIKE '%influenced') AS di, avg(volume) FILTER (series_id LIKE '%benchmark') AS vb,
  avg(volume) FILTER (series_id LIKE '%influenced') AS vi FROM e GROUP BY 1)""")
       + """SELECT series_id, 'mean_duration' AS characteristic, db AS benchmark, di AS influenced, (di - db) / db * 100 AS change_percent FROM c
UNION ALL SELECT series_id, 'mean_deficit', vb, vi, (vi - vb) / vb * 100 FROM c""")
def scenario_change(spark, folder):
    """Drought characteristics with and without an influence, both scenarios in one pass."""
    days = add_missing_days(series.ship_daily(spark, folder))
    days = days.withColumn("threshold", F.percentile("value", F.lit(0.2)).over(by_key()))
    scenarios = F.array(
        F.struct(F.lit("benchmark").alias("scenario"), F.lit(1.0).alias("f")),
        F.struct(F.lit("influenced").alias("scenario"),
                 F.when(F.month("time").between(5, 9), 0.75).otherwise(1.0).alias("f")))
    both = days.select("series_id", "time", "value", "threshold", F.explode(scenarios).alias("s"))
    both = both.select(F.concat_ws("|", "series_id", "s.scenario").alias("series_id"), "time",
                       (F.col("value") * F.col("s.f")).alias("value"), "threshold")
    events = ev.drought_events(both, "threshold")
    parts = F.split("series_id", r"\|")
    events = events.withColumns({"scenario": parts[1], "series_id": parts[0]})
    return sk.scenario_change(events, "scenario", "benchmark", "influenced", ["series_id"])


# ---- impacts ---------------------------------------------------------------------------------

INDEX = """ix AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, 'spi_' || left(o_orderpriority, 1) AS index,
  avg(o_totalprice) / 1000 AS index_val FROM orders GROUP BY 1, 2, 3),
ims AS (SELECT year(l_shipdate) AS year, count(*) FILTER (l_returnflag = 'R') AS impact_count,
  count(*) FILTER (l_returnflag = 'R') > 0.333 * count(*) AS impact FROM lineitem GROUP BY 1)"""


def _index_and_impacts(spark, folder):
    orders = series.table(spark, folder, "orders")
    index = orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
                           F.concat(F.lit("spi_"), F.substring("o_orderpriority", 1, 1)).alias("index")).agg(
        (F.avg("o_totalprice") / 1000).alias("index_val"))
    lines = series.table(spark, folder, "lineitem")
    returned = F.count_if(F.col("l_returnflag") == "R")
    impacts = lines.groupBy(F.year("l_shipdate").alias("year")).agg(
        returned.alias("impact_count"), (returned > 0.333 * F.count(F.lit(1))).alias("impact"))
    return index, impacts


@query("index_with_impacts", "year:i index:s index_val:f6 impact_count:i impact:b",
       sql.with_(INDEX) + """SELECT coalesce(i.year, m.year) AS year, index, index_val, impact_count, impact
FROM (SELECT * FROM ix WHERE month = 7) i FULL JOIN ims m ON i.year = m.year WHERE impact IS NOT NULL""")
def index_with_impacts(spark, folder):
    """July index joined with the impacts of the year."""
    return im.index_with_impacts(*_index_and_impacts(spark, folder))


@query("indices_spread", "year:i impact:b spi_1:f6 spi_2:f6 spi_3:f6 spi_4:f6 spi_5:f6",
       sql.with_(INDEX) + """SELECT m.year, impact, max(index_val) FILTER (index = 'spi_1') AS spi_1,
  max(index_val) FILTER (index = 'spi_2') AS spi_2, max(index_val) FILTER (index = 'spi_3') AS spi_3,
  max(index_val) FILTER (index = 'spi_4') AS spi_4, max(index_val) FILTER (index = 'spi_5') AS spi_5
FROM ims m LEFT JOIN (SELECT * FROM ix WHERE month = 7) i ON i.year = m.year GROUP BY 1, 2""")
def indices_spread(spark, folder):
    """One column per index."""
    return im.spread_indices(im.index_with_impacts(*_index_and_impacts(spark, folder)), [f"spi_{k}" for k in range(1, 6)])


def quality(spark, folder):
    """Binary quality label against the logarithm of the text length."""
    docs = series.table(spark, folder, "documents").select("doc_id", F.log("n_chars").alias("length"))
    return series.table(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("impact"), "length", "toxic")


QUALITY = """lab AS (SELECT quality AS impact, ln(n_chars) AS length, toxic FROM labels JOIN documents USING (doc_id))"""


@query("impact_density", "impact:i i:i x:f6 density:f6 share:f6",
       sql.with_(QUALITY, """st AS (SELECT impact, count(*) AS n, 0.9 * least(stddev_samp(length),
  (quantile_cont(length, 0.75) - quantile_cont(length, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM lab GROUP BY 1),
rg AS (SELECT min(length) AS a, max(length) AS b FROM lab),
gr AS (SELECT i, a + (b - a) * i / 31.0 AS x FROM rg, (SELECT unnest(range(0, 32)) AS i)),
de AS (SELECT impact, i, x, sum(exp(-0.5 * pow((x - length) / h, 2))) / (max(h) * max(n) * sqrt(2 * pi())) AS density
  FROM lab JOIN st USING (impact), gr GROUP BY 1, 2, 3)""")
       + "SELECT *, density / sum(density) OVER (PARTITION BY i) AS share FROM de")
def impact_density(spark, folder):
    """Stacked class densities along the index."""
    return im.class_density(quality(spark, folder), "length", "impact", points=32)


@query("impact_class_summary", "impact:i n:i median:f6 q25:f6 q75:f6",
       sql.with_(QUALITY) + """SELECT impact, count(*) AS n, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.25) AS q25,
  quantile_cont(length, 0.75) AS q75 FROM lab GROUP BY 1""")
def impact_class_summary(spark, folder):
    """Box statistics of the index per class."""
    return sk.five_numbers(quality(spark, folder), ["impact"], "length")


NEWTON = """agg AS (SELECT length AS x, count(*) AS w, CAST(sum(impact) AS DOUBLE) AS k FROM lab GROUP BY 1),
pts AS (SELECT list({'x': x - 6.0, 'w': CAST(w AS DOUBLE), 'k': k}) AS l FROM agg),
it AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b
UNION ALL SELECT step + 1, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01)
FROM (SELECT step, a, b,
  list_sum(list_transform(l, lambda r: r.k - r.w / (1 + exp(-a - b * r.x)))) AS g0,
  list_sum(list_transform(l, lambda r: (r.k - r.w / (1 + exp(-a - b * r.x))) * r.x)) AS g1,
  list_sum(list_transform(l, lambda r: r.w / (1 + exp(-a - b * r.x)) / (1 + exp(a + b * r.x)))) AS h00,
  list_sum(list_transform(l, lambda r: r.w / (1 + exp(-a - b * r.x)) / (1 + exp(a + b * r.x)) * r.x)) AS h01,
  list_sum(list_transform(l, lambda r: r.w / (1 + exp(-a - b * r.x)) / (1 + exp(a + b * r.x)) * r.x * r.x)) AS h11
  FROM it, pts WHERE step < 25)),
beta AS (SELECT a - 6.0 * b AS b0, b AS b1 FROM it WHERE step = 25),
inf AS (SELECT b0, b1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * length) AS h01, sum(p * (1 - p) * length * length) AS h11,
  -2 * sum(CASE WHEN impact = 1 THEN ln(p) ELSE ln(1 - p) END) AS dev
  FROM (SELECT b0, b1, length, impact, 1 / (1 + exp(-b0 - b1 * length)) AS p FROM lab, beta) GROUP BY 1, 2)"""


@query("logistic_impact", "term:s estimate:f4 se:f4 z:f3 deviance:f4 aic:f4",
       sql.with_(QUALITY, NEWTON).replace("WITH ", "WITH RECURSIVE ", 1)
       + """SELECT '(intercept)' AS term, b0 AS estimate, sqrt(h11 / (h00 * h11 - h01 * h01)) AS se,
  b0 / sqrt(h11 / (h00 * h11 - h01 * h01)) AS z, dev AS deviance, dev + 4 AS aic FROM inf
UNION ALL SELECT 'length', b1, sqrt(h00 / (h00 * h11 - h01 * h01)), b1 / sqrt(h00 / (h00 * h11 - h01 * h01)), dev, dev + 4 FROM inf""")
def logistic_impact(spark, folder):
    """Logistic regression of the impact on the index."""
    return im.logistic_table(quality(spark, folder), "impact", ["length"])


@query("impact_likelihood", "length:f6 predict:f5 predict_lower:f5 predict_upper:f5 n:i",
       sql.with_(QUALITY, NEWTON).replace("WITH ", "WITH RECURSIVE ", 1)
       + """, e AS (SELECT length, b0 + b1 * length AS l, sqrt((h11 - 2 * h01 * length + h00 * length * length) / (h00 * h11 - h01 * h01)) AS s FROM lab, inf)
SELECT length, 1 / (1 + exp(-l)) AS predict, 1 / (1 + exp(-(l - 1.959963984540054 * s))) AS predict_lower,
  1 / (1 + exp(-(l + 1.959963984540054 * s))) AS predict_upper, count(*) AS n FROM e GROUP BY ALL""")
def impact_likelihood(spark, folder):
    """Predicted likelihood with its band for every observed index value."""
    rows = quality(spark, folder)
    predicted = im.predict_likelihood(rows, rows, "impact", ["length"])
    return predicted.groupBy("length", "predict", "predict_lower", "predict_upper").agg(F.count(F.lit(1)).alias("n"))


@query("impact_partial_effect", "i:i length:f6 predict:f5 predict_lower:f5 predict_upper:f5",
       sql.with_(QUALITY, NEWTON).replace("WITH ", "WITH RECURSIVE ", 1)
       + """, sp AS (SELECT min(length) AS lo, max(length) AS hi, (max(length) - min(length)) / (ceil(log2(count(*))) + 1) AS w FROM lab),
g AS (SELECT i, lo - w + (hi - lo + 2 * w) * i / 99.0 AS length FROM sp, (SELECT unnest(range(0, 100)) AS i)),
e AS (SELECT i, length, b0 + b1 * length AS l, sqrt((h11 - 2 * h01 * length + h00 * length * length) / (h00 * h11 - h01 * h01)) AS s FROM g, inf)
SELECT i, length, 1 / (1 + exp(-l)) AS predict, 1 / (1 + exp(-(l - 1.96 * s))) AS predict_lower, 1 / (1 + exp(-(l + 1.96 * s))) AS predict_upper FROM e""")
def impact_partial_effect(spark, folder):
    """Likelihood along the index over its widened range."""
    return im.partial_effect(quality(spark, folder), "impact", ["length"], "length")


# Intercept and slope at which the deviance has risen by the limit while the intercept is at its best, by Newton steps from the Wald limits.
PROFILE = """wald AS (SELECT dev, b0 + 6.0 * b1 AS a0, b1, sqrt(h00 / (h00 * h11 - h01 * h01)) AS se, (h01 - 6.0 * h00) / h00 AS tilt FROM inf),
pf AS (SELECT side, 0 AS step, a0 - tilt * side * 1.959963984540054 * se AS a, b1 + side * 1.959963984540054 * se AS b, se, dev FROM wald, (SELECT unnest([-1.0, 1.0]) AS side)
UNION ALL SELECT side, step + 1, a + least(1, se / abs(db)) * da, b + least(1, se / abs(db)) * db, se, dev
FROM (SELECT *, (2 * g0 * g1 + h01 * (dev + 3.841458820694124 - d)) / (2 * h00 * g1 - 2 * h01 * g0) AS da, (-h00 * (dev + 3.841458820694124 - d) - 2 * g0 * g0) / (2 * h00 * g1 - 2 * h01 * g0) AS db
FROM (SELECT side, step, a, b, se, dev,
  list_sum(list_transform(l, lambda r: r.k - r.w / (1 + exp(-a - b * r.x)))) AS g0,
  list_sum(list_transform(l, lambda r: (r.k - r.w / (1 + exp(-a - b * r.x))) * r.x)) AS g1,
  list_sum(list_transform(l, lambda r: r.w / (1 + exp(-a - b * r.x)) / (1 + exp(a + b * r.x)))) AS h00,
  list_sum(list_transform(l, lambda r: r.w / (1 + exp(-a - b * r.x)) / (1 + exp(a + b * r.x)) * r.x)) AS h01,
  list_sum(list_transform(l, lambda r: 2 * (r.w * (greatest(a + b * r.x, 0) + ln(1 + exp(-abs(a + b * r.x)))) - r.k * (a + b * r.x)))) AS d
  FROM pf, pts WHERE step < 12)))"""


@query("impact_profile_interval", "lower:f3 upper:f3",
       sql.with_(QUALITY, NEWTON, PROFILE).replace("WITH ", "WITH RECURSIVE ", 1)
       + "SELECT min(b) AS lower, max(b) AS upper FROM pf WHERE step = 12")
def impact_profile_interval(spark, folder):
    """Profile-likelihood interval of the slope."""
    lower, upper = im.profile_interval(quality(spark, folder), "impact", "length")
    return spark.createDataFrame([(lower, upper)], "lower double, upper double")


# ---- curves ----------------------------------------------------------------------------------

# Weight of the second differences.
PENALTY = 1600.0


@query("smoothed_quantile_curves", "series_id:s exc_freq:s md:s flow:f4 smoothed:f4",
       "WITH RECURSIVE q0 AS (" + (QUERIES[flows.daily_quantile_curves.__name__].sql) + f"""),
cu AS (SELECT series_id, exc_freq, list(md ORDER BY md) AS md, list(flow ORDER BY md) AS y, count(*) AS n FROM q0 GROUP BY 1, 2),
fw AS (SELECT series_id, exc_freq, y, n, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS d2, 0.0::DOUBLE AS e2, 0.0::DOUBLE AS z2,
    CAST([] AS DOUBLE[]) AS ds, CAST([] AS DOUBLE[]) AS cs, CAST([] AS DOUBLE[]) AS es, CAST([] AS DOUBLE[]) AS zs FROM cu UNION ALL
  SELECT series_id, exc_freq, y, n, i, d, (b - d1 * c1 * e1) / d, g / d, z, d1, e1, z1, list_append(ds, d), list_append(cs, (b - d1 * c1 * e1) / d), list_append(es, g / d), list_append(zs, z)
  FROM (SELECT series_id, exc_freq, y, n, i + 1 AS i, d1, c1, e1, z1, ds, cs, es, zs, y[i + 1] - c1 * z1 - e2 * z2 AS z,
      1 + {PENALTY} * CASE WHEN i + 1 IN (1, n) THEN 1 WHEN i + 1 IN (2, n - 1) THEN 5 ELSE 6 END - d1 * c1 * c1 - d2 * e2 * e2 AS d,
      CASE WHEN i + 1 >= n THEN 0 WHEN i + 1 IN (1, n - 1) THEN -2 * {PENALTY} ELSE -4 * {PENALTY} END AS b, CASE WHEN i + 1 > n - 2 THEN 0 ELSE {PENALTY} END AS g FROM fw WHERE i < n)),
bw AS (SELECT series_id, exc_freq, n + 1 AS i, ds, cs, es, zs, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2 FROM fw WHERE i = n UNION ALL
  SELECT series_id, exc_freq, i - 1, ds, cs, es, zs, zs[i - 1] / ds[i - 1] - cs[i - 1] * x1 - es[i - 1] * x2, x1 FROM bw WHERE i > 1)
SELECT bw.series_id, bw.exc_freq, md[i] AS md, y[i] AS flow, CASE WHEN x1 < 0.00025 THEN 0.0 WHEN x1 < 0.0005 THEN 0.0005 ELSE x1 END AS smoothed
FROM bw JOIN cu USING (series_id, exc_freq) WHERE i <= n""")
def smoothed_quantile_curves(spark, folder):
    """Quantile curves per month-day, smoothed."""
    curves = idx.daily_quantiles(series.ship_daily(spark, folder))
    return idx.whittaker(curves, ["series_id", "exc_freq"], lam=PENALTY).withColumn("md", month_day_label(F.col("md")))
