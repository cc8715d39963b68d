"""Queries on duration curves, quantiles, thresholds, annual minima and index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.functions.calendar import month_day_label
from ebbflow.functions.special import specific_discharge
from ebbflow.operators import indices as idx
from ebbflow.operators import thresholds as thr
from ebbflow.operators.clean import add_missing_days
from ebbflow.operators.windows import approx_at
from ebbflow.plans import fragments as sql
from ebbflow.plans.registry import query
from ebbflow.sources import series

FDC = """fdc AS (SELECT series_id, time, value, rank() OVER (PARTITION BY series_id ORDER BY value DESC) AS rank,
  rank() OVER (PARTITION BY series_id ORDER BY value DESC) / count(*) OVER (PARTITION BY series_id) AS freq_exc
  FROM {source} WHERE value IS NOT NULL)"""


@query("flow_duration_curve", "series_id:s time:d value:f2 rank:i freq_exc:f8",
       sql.with_(sql.SHIP, FDC.format(source="ship")) + "SELECT * FROM fdc")
def flow_duration_curve(spark, folder):
    """Rank and exceedance frequency of every daily flow."""
    return idx.exceedance_frequency(series.ship_daily(spark, folder))


@query("supplier_duration_curve", "series_id:s flow:f2 rank:i freq_exc:f8 days:i",
       sql.with_(sql.SUPP, FDC.format(source="supp"))
       + "SELECT series_id, value AS flow, rank, freq_exc, count(*) AS days FROM fdc GROUP BY ALL")
def supplier_duration_curve(spark, folder):
    """Duration curves of many series, one row per distinct flow."""
    fdc = idx.exceedance_frequency(series.supplier_daily(spark, folder))
    return fdc.groupBy("series_id", F.col("value").alias("flow"), "rank", "freq_exc").agg(
        F.count(F.lit(1)).alias("days"))


@query("duration_curve_q90", "series_id:s value:f2 freq_exc:f8",
       sql.with_(sql.SHIP, FDC.format(source="ship"))
       + """SELECT series_id, max_by(value, freq_exc) AS value, max(freq_exc) AS freq_exc FROM fdc
WHERE freq_exc <= 0.9 GROUP BY 1""")
def duration_curve_q90(spark, folder):
    """Tabulated flow at the largest frequency not above 0.9."""
    return idx.fdc_value(idx.exceedance_frequency(series.ship_daily(spark, folder)), 0.9)


@query("specific_duration_curve", "series_id:s time:d specific:f6 freq_exc:f8",
       sql.with_(sql.NATION, """area AS (SELECT CAST(c_nationkey AS VARCHAR) AS series_id, count(*) AS area
  FROM customer GROUP BY 1)""", """sp AS (SELECT series_id, time, value * 1000 / area AS value
  FROM nat JOIN area USING (series_id))""", FDC.format(source="sp"))
       + "SELECT series_id, time, value AS specific, freq_exc FROM fdc")
def specific_duration_curve(spark, folder):
    """Duration curves of flows per unit area (here: customers per nation)."""
    area = series.table(spark, folder, "customer").groupBy(
        F.col("c_nationkey").cast("string").alias("series_id")).agg(F.count(F.lit(1)).alias("area"))
    flows = series.nation_daily(spark, folder).join(area, "series_id")
    flows = flows.withColumn("specific", specific_discharge(F.col("value"), F.col("area")))
    return idx.exceedance_frequency(flows, value="specific")


@query("low_flow_quantiles", "series_id:s Q95:f6 Q90:f6 Q80:f6 Q50:f6",
       sql.with_(sql.SUPP) + """SELECT series_id, quantile_cont(value, 0.05) AS "Q95", quantile_cont(value, 0.1) AS "Q90",
  quantile_cont(value, 0.2) AS "Q80", quantile_cont(value, 0.5) AS "Q50" FROM supp GROUP BY 1""")
def low_flow_quantiles(spark, folder):
    """Low-flow quantiles of many series."""
    return idx.lfquantile(series.supplier_daily(spark, folder))


@query("constant_threshold", "series_id:s time:d value:f2 low:f6 typical:f6",
       sql.with_(sql.SHIP, """t AS (SELECT series_id, quantile_cont(value, 0.3) AS low, avg(value) AS typical
  FROM ship GROUP BY 1)""") + "SELECT ship.*, low, typical FROM ship JOIN t USING (series_id)")
def constant_threshold(spark, folder):
    """Several constant thresholds per series, appended to the days."""
    days = series.ship_daily(spark, folder)
    return thr.append_threshold(days, thr.const_threshold(days, {"low": thr.quantile(0.7), "typical": F.avg}))


@query("monthly_threshold", "series_id:s month:i threshold:f6",
       sql.with_(sql.SHIP) + """SELECT series_id, month(time) AS month, quantile_cont(value, 0.2) AS threshold
FROM ship GROUP BY 1, 2""")
def monthly_threshold(spark, folder):
    """Q80 per calendar month."""
    return thr.var_threshold(series.ship_daily(spark, folder), "month", thr.quantile(0.8)).table


@query("period_thresholds", "series_id:s period:s threshold:f6",
       sql.with_(sql.SHIP) + """SELECT series_id, 'week ' || ((dayofyear(time) - 1) // 7 + 1) AS period,
  quantile_cont(value, 0.1) AS threshold FROM ship GROUP BY 1, 2
UNION ALL SELECT series_id, 'season ' || CASE WHEN strftime(time, '%m-%d') >= '04-01' AND
  strftime(time, '%m-%d') < '10-01' THEN 'summer' ELSE 'winter' END, quantile_cont(value, 0.1) FROM ship GROUP BY 1, 2
UNION ALL SELECT series_id, 'year ' || CAST(""" + sql.water_year(origin="09-01")
       + " AS VARCHAR), quantile_cont(value, 0.1) FROM ship GROUP BY 1, 2")
def period_thresholds(spark, folder):
    """Q90 per week, season and hydrological year."""
    days = series.ship_daily(spark, folder)
    starts = {"week": "-01-01", "season": {"summer": "-04-01", "winter": "-10-01"}, "year": "-09-01"}
    parts = [thr.var_threshold(days, by, thr.quantile(0.9), start).table.select(
        "series_id", F.concat_ws(" ", F.lit(by), F.col(by).cast("string")).alias("period"), "threshold")
        for by, start in starts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DAY_VALUES = """{name} AS (SELECT series_id, strftime(time, '-%m-%d') AS md, value FROM {source} WHERE value IS NOT NULL
UNION ALL SELECT series_id, '-02-29', avg(value) FROM {source}
  WHERE strftime(time, '%m-%d') IN ('02-28', '03-01') AND NOT (year(time) % 4 = 0 AND (year(time) % 100 <> 0 OR year(time) % 400 = 0))
  GROUP BY series_id, year(time) HAVING count(value) = count(*))"""


@query("daily_threshold", "series_id:s md:s threshold:f6",
       sql.with_(sql.STATUS, sql.full("status"), DAY_VALUES.format(name="d", source="fullc"))
       + "SELECT series_id, md, quantile_cont(value, 0.2) AS threshold FROM d GROUP BY 1, 2")
def daily_threshold(spark, folder):
    """Q80 per month-day with synthetic leap days."""
    days = add_missing_days(series.ship_daily_by_status(spark, folder))
    return thr.var_threshold(days, "day", thr.quantile(0.8)).table.withColumn(
        "md", month_day_label(F.col("day")))


@query("annual_minima", "series_id:s year:i n:i am:f6",
       sql.with_(sql.SHIP, sql.full("ship"), f"""ma AS (SELECT series_id, {sql.water_year(origin='09-01')} AS year,
  row_number() OVER w AS p, value AS m1,
  CASE WHEN count(value) OVER a = 3 THEN avg(value) OVER a END AS m3,
  CASE WHEN count(value) OVER b = 7 THEN avg(value) OVER b END AS m7
  FROM fullc WINDOW w AS (PARTITION BY series_id ORDER BY time),
  a AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""")
       + " UNION ALL ".join(f"""SELECT series_id, year, {n} AS n, min(m{n}) AS am FROM ma WHERE p >= {n}
  GROUP BY 1, 2 HAVING count(m{n}) = count(*)""" for n in (1, 3, 7)))
def annual_minima(spark, folder):
    """Annual minima of 1, 3 and 7-day means; years with missing days are left out."""
    days = add_missing_days(series.ship_daily(spark, folder))
    return idx.annual_minima(days, (1, 3, 7), "-09-01")


@query("summer_minima", "series_id:s year:i n:i am:f6",
       sql.with_(sql.SHIP, """s AS (SELECT series_id, time, value, row_number() OVER w AS p,
  CASE WHEN count(value) OVER a = 7 THEN avg(value) OVER a END AS m FROM ship
  WINDOW w AS (PARTITION BY series_id ORDER BY time),
  a AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""")
       + """SELECT series_id, CASE WHEN strftime(time, '%m-%d') < '05-01' THEN year(time) - 1 ELSE year(time) END AS year,
  7 AS n, min(m) AS am FROM s WHERE p >= 7 AND strftime(time, '%m-%d') BETWEEN '05-01' AND '11-30'
GROUP BY 1, 2""")
def summer_minima(spark, folder):
    """Annual minima restricted to a season."""
    return idx.annual_minima(series.ship_daily(spark, folder), 7, ("-05-01", "-11-30"))


MAM = """mv AS (SELECT series_id, year(time) AS year, row_number() OVER w AS p, value AS m1,
  CASE WHEN count(value) OVER a = 10 THEN avg(value) OVER a END AS m10,
  CASE WHEN count(value) OVER b = 30 THEN avg(value) OVER b END AS m30
  FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY time),
  a AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
am AS (SELECT series_id, year, 1 AS n, min(m1) AS am FROM mv GROUP BY 1, 2
  UNION ALL SELECT series_id, year, 10, min(m10) FROM mv WHERE p >= 10 GROUP BY 1, 2
  UNION ALL SELECT series_id, year, 30, min(m30) FROM mv WHERE p >= 30 GROUP BY 1, 2),
mam AS (SELECT series_id, n, avg(am) AS mam FROM am GROUP BY 1, 2)"""


@query("mean_annual_minima", "series_id:s n:i mam:f6",
       sql.with_(sql.SUPP, MAM.format(source="supp")) + "SELECT * FROM mam")
def mean_annual_minima(spark, folder):
    """MAM(1), MAM(10) and MAM(30) of many series from one sort."""
    return idx.mean_annual_minimum(series.supplier_daily(spark, folder), (1, 10, 30))


@query("annual_summary", "series_id:s year:i min_flow:f2 mean_flow:f6",
       sql.with_(sql.SUPP) + "SELECT series_id, year(time) AS year, min(value) AS min_flow, avg(value) AS mean_flow "
                             "FROM supp GROUP BY 1, 2")
def annual_summary(spark, folder):
    """Annual minimum and mean of many series."""
    return idx.annual_summary(series.supplier_daily(spark, folder))


RECESSION = """step_ AS (SELECT series_id, time, value, CASE WHEN lead(value) OVER w <= value THEN true
  WHEN lead(value) OVER w > value THEN false END AS falling FROM {source}
  WINDOW w AS (PARTITION BY series_id ORDER BY time)),
""" + sql.run_id("falling", "step_", "falls") + """,
seg AS (SELECT *, lead(value) OVER (PARTITION BY series_id, run ORDER BY time) AS nxt,
  row_number() OVER (PARTITION BY series_id, run ORDER BY time) AS day,
  count(*) OVER (PARTITION BY series_id, run) AS size FROM falls WHERE falling),
pairs AS (SELECT * FROM seg WHERE size >= {minlen} AND nxt IS NOT NULL),
rec AS (SELECT series_id, count(*) AS pairs, max(value) AS q0, sum(value * nxt) / sum(value * value) AS k,
  -ln(sum(value * nxt) / sum(value * value)) AS alpha FROM pairs GROUP BY 1)"""

INDICES = """base AS (SELECT series_id, avg(value) AS mean_flow, quantile_cont(value, 0.5) AS q50,
  quantile_cont(value, 0.05) AS q95, quantile_cont(value, 0.1) AS q90, quantile_cont(value, 0.3) AS q70
  FROM supp GROUP BY 1),
ind AS (SELECT b.series_id, mean_flow, q50 AS "Q50", q95 AS "Q95", q90 AS "Q90", q70 AS "Q70",
  m1.mam AS "MAM1", m10.mam AS "MAM10", m30.mam AS "MAM30", alpha AS "ALPHA",
  q90 / q50 AS "Q90_Q50", q95 / q50 AS "Q95_Q50", m30.mam / q50 AS "MAM30_Q50", m10.mam / q50 AS "MAM10_Q50",
  m1.mam / q50 AS "MAM1_Q50"
  FROM base b LEFT JOIN mam m1 ON m1.series_id = b.series_id AND m1.n = 1
  LEFT JOIN mam m10 ON m10.series_id = b.series_id AND m10.n = 10
  LEFT JOIN mam m30 ON m30.series_id = b.series_id AND m30.n = 30
  LEFT JOIN rec ON rec.series_id = b.series_id)"""

INDEX_CTES = (sql.SUPP, MAM.format(source="supp"), RECESSION.format(source="supp", minlen=5), INDICES)


@query("station_indices", "series_id:s mean_flow:f6 Q50:f6 Q95:f6 Q90:f6 Q70:f6 MAM1:f6 MAM10:f6 MAM30:f6 "
                          "ALPHA:f6 Q90_Q50:f6 Q95_Q50:f6 MAM30_Q50:f6 MAM10_Q50:f6 MAM1_Q50:f6",
       sql.with_(*INDEX_CTES) + "SELECT * FROM ind")
def station_indices(spark, folder):
    """Index table of all stations."""
    return idx.station_indices(series.by_series(
        series.supplier_daily(spark, folder), series.tasks_for(series.table(spark, folder, "lineitem"))))


@query("groundwater_index", "series_id:s time:d level:f8 rank:f2 sgi:f8",
       sql.with_(sql.ORDER, """months AS (SELECT series_id, CAST(unnest(generate_series(
  date_trunc('month', min(time)), date_trunc('month', max(time)), INTERVAL 1 MONTH)) AS DATE) AS time
  FROM ords GROUP BY 1)""",
                 """res AS (SELECT m.series_id, m.time, CASE WHEN a.time = m.time THEN a.value ELSE
  a.value + (b.value - a.value) * date_diff('day', a.time, m.time) / date_diff('day', a.time, b.time) END AS level
FROM months m ASOF LEFT JOIN ords a ON m.series_id = a.series_id AND m.time >= a.time
ASOF LEFT JOIN ords b ON m.series_id = b.series_id AND m.time <= b.time)""",
                 """rk AS (SELECT *, CASE WHEN level IS NOT NULL THEN rank() OVER (PARTITION BY series_id, month(time)
  ORDER BY level NULLS LAST) + (count(*) OVER (PARTITION BY series_id, month(time), level) - 1) / 2 END AS rank,
  count(level) OVER (PARTITION BY series_id, month(time)) AS n FROM res)""",
                 "p AS (SELECT *, rank / (n + 1) AS pr FROM rk)")
       + f"SELECT series_id, time, level, rank, {sql.qnorm('pr')} AS sgi FROM p")
def groundwater_index(spark, folder):
    """Standardised monthly index of an irregular series."""
    days = series.order_daily(spark, folder)
    months = days.groupBy("series_id").agg(F.min(F.trunc("time", "month")).alias("a"),
                                           F.max(F.trunc("time", "month")).alias("b"))
    months = months.select("series_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("time"))
    levels = approx_at(days, months).withColumns({"month": F.month("time"), "level": F.col("value")})
    return idx.sgi(levels, ["series_id", "month"], "level")


@query("daily_envelope", "series_id:s md:s flow_min:f2 flow_max:f2",
       sql.with_(sql.SHIP) + """SELECT series_id, strftime(time, '-%m-%d') AS md, min(value) AS flow_min,
  max(value) AS flow_max FROM ship GROUP BY 1, 2""")
def daily_envelope(spark, folder):
    """Range of flows per month-day."""
    return idx.daily_envelope(series.ship_daily(spark, folder)).withColumn("md", month_day_label(F.col("md")))


EXTREME = """med AS (SELECT series_id, year(time) AS year, quantile_cont(value, 0.5) AS m FROM {source} GROUP BY 1, 2),
res AS (SELECT s.series_id, year, sum(CASE WHEN value < m THEN value * value ELSE 0 END) AS dry,
  sum(CASE WHEN value > m THEN value * value ELSE 0 END) AS wet
  FROM {source} s JOIN med ON s.series_id = med.series_id AND year(time) = year GROUP BY 1, 2),
ext AS (SELECT series_id, 'wet' AS state, arg_min(year, (-wet, year)) AS year FROM res GROUP BY 1
  UNION ALL SELECT series_id, 'dry', arg_min(year, (dry, year)) FROM res GROUP BY 1)"""


@query("extreme_years", "series_id:s state:s year:i",
       sql.with_(sql.SUPP, EXTREME.format(source="supp")) + "SELECT * FROM ext")
def extreme_years(spark, folder):
    """Wettest and driest year of many series."""
    return idx.extreme_years(series.supplier_daily(spark, folder))


@query("extreme_year_labels", "series_id:s state:s year:i time:d value:f2",
       sql.with_(sql.SHIP, EXTREME.format(source="ship"))
       + """SELECT e.series_id, state, e.year, CASE WHEN state = 'dry' THEN arg_min(time, (value, time))
  ELSE arg_min(time, (-value, time)) END AS time, CASE WHEN state = 'dry' THEN min(value) ELSE max(value) END AS value
FROM ext e JOIN ship s ON s.series_id = e.series_id AND year(s.time) = e.year GROUP BY 1, 2, 3""")
def extreme_year_labels(spark, folder):
    """Lowest day of the driest and highest day of the wettest year."""
    return idx.extreme_year_labels(series.ship_daily(spark, folder))


@query("daily_quantile_curves", "series_id:s md:s exc_freq:s flow:f6",
       sql.with_(sql.SHIP, f"""yy AS (SELECT *, year(time) AS y FROM ship),
cov AS (SELECT series_id, y, count(value) / {sql.days_in('y')} AS cov FROM yy GROUP BY 1, 2),
edge AS (SELECT series_id, min(y) AS y0, max(y) AS y1 FROM cov GROUP BY 1),
kept AS (SELECT yy.series_id, time, value FROM yy JOIN cov USING (series_id, y) JOIN edge USING (series_id)
  WHERE (y > y0 AND y < y1) OR cov >= 0.99)""", DAY_VALUES.format(name="d", source="kept"),
                 """q AS (SELECT series_id, md, quantile_cont(value, [0.05, 0.1, 0.2, 0.5]) AS q FROM d GROUP BY 1, 2)""")
       + " UNION ALL ".join(f"SELECT series_id, md, '{n}' AS exc_freq, q[{i}] AS flow FROM q"
                            for i, n in enumerate(("Q95", "Q90", "Q80", "Q50"), 1)))
def daily_quantile_curves(spark, folder):
    """Quantile curves per month-day over complete years."""
    return idx.daily_quantiles(series.ship_daily(spark, folder)).withColumn("md", month_day_label(F.col("md")))


@query("flow_histogram", "series_id:s bin:f2 n:i",
       sql.with_(sql.SUPP) + "SELECT series_id, floor(value / 5) * 5 AS bin, count(*) AS n FROM supp GROUP BY 1, 2")
def flow_histogram(spark, folder):
    """Counts of daily flows in bins of five units."""
    return idx.histogram(series.supplier_daily(spark, folder), "value", 5, ["series_id"])


@query("sturges_histogram", "event_type:s bin:i n:i lower:f6",
       """WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, ceil(log2(count(*))) + 1 AS k
  FROM events GROUP BY 1),
b AS (SELECT e.event_type, lo, hi, k, least(greatest(ceil((value - lo) / ((hi - lo) / k)), 1), k) AS bin
  FROM events e JOIN s USING (event_type))
SELECT event_type, bin, count(*) AS n, any_value(lo + (hi - lo) / k * (bin - 1)) AS lower FROM b GROUP BY 1, 2""")
def sturges_histogram(spark, folder):
    """Counts in Sturges bins per class."""
    return idx.sturges_histogram(series.table(spark, folder, "events"), "value", ["event_type"])
