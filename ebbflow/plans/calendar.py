"""Queries on period keys, runs and moving windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.columns import by_key, in_time, so_far
from ebbflow.functions import calendar as cal
from ebbflow.functions.special import join_with_and, number_words
from ebbflow.operators import windows as win
from ebbflow.operators.clean import add_missing_days, guess_step, season_filter
from ebbflow.plans import fragments as sql
from ebbflow.plans.registry import query
from ebbflow.sources import series

SEASONS = {"summer": "-04-01", "winter": "-10-15"}


@query("calendar_keys",
       "time:d year_sep:i year_jan:i start:d season:s season_no:i week:i month:i md:s md_no:i md_no_feb:i "
       "year_days:i day365:i leap:b julian:i month_label:s cool:b warm:b orders:i",
       f"""WITH days AS (SELECT CAST(o_orderdate AS DATE) AS time, count(*) AS orders FROM orders GROUP BY 1),
k AS (SELECT *, strftime(time, '%m-%d') AS m, dayofyear(time) AS doy,
  dayofyear(make_date(2000, month(time), day(time))) AS leapday FROM days)
SELECT time, {sql.water_year(origin='09-01')} AS year_sep, year(time) AS year_jan,
  CASE WHEN m >= '10-15' THEN make_date(year(time), 10, 15) WHEN m >= '04-01' THEN make_date(year(time), 4, 1)
       ELSE make_date(year(time) - 1, 10, 15) END AS start,
  CASE WHEN m >= '04-01' AND m < '10-15' THEN 'summer' ELSE 'winter' END AS season,
  CASE WHEN m >= '04-01' AND m < '10-15' THEN 1 ELSE 2 END AS season_no,
  (doy - 1) // 7 + 1 AS week, month(time) AS month, '-' || m AS md,
  (leapday - 245 + 366) % 366 + 1 AS md_no, (leapday - 32 + 366) % 366 + 1 AS md_no_feb,
  {sql.days_in(sql.water_year(origin='09-01'), '09-01')} AS year_days,
  doy - CASE WHEN {sql.LEAP} AND doy >= 60 THEN 1 ELSE 0 END AS day365, {sql.LEAP} AS leap, doy AS julian,
  monthname(time) AS month_label, (m >= '11-01' OR m <= '02-28') AS cool,
  (m BETWEEN '05-01' AND '09-30') AS warm, orders
FROM k""")
def calendar_keys(spark, folder):
    """Every period key of every order date."""
    days = series.table(spark, folder, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("time")).agg(F.count(F.lit(1)).alias("orders"))
    t = F.col("time")
    sep_year = cal.group_ts(t, "year", "-09-01")
    return days.select(
        "time", sep_year.alias("year_sep"), cal.water_year(t).alias("year_jan"),
        cal.period_start(t, SEASONS).alias("start"), cal.group_ts(t, "season", SEASONS).alias("season"),
        cal.season_number(t, SEASONS).alias("season_no"), cal.group_ts(t, "week").alias("week"),
        cal.group_ts(t, "month").alias("month"), cal.month_day(t).alias("md"),
        cal.month_day_number(t, "-09-01").alias("md_no"), cal.month_day_number(t, "-02-01").alias("md_no_feb"),
        cal.days_in_year(sep_year, "-09-01").alias("year_days"), cal.day_of_normal_year(t).alias("day365"),
        cal.is_leap_year(F.year(t)).alias("leap"), F.dayofyear(t).alias("julian"),
        cal.month_name(t).alias("month_label"), cal.in_season(t, "-11-01", "-02-28").alias("cool"),
        cal.in_season(t, "-05-01", "-09-30").alias("warm"), "orders")


@query("season_runs", "series_id:s season_run:s first_day:d days:i",
       sql.with_(sql.SHIP, f"""keyed AS (SELECT *, CASE WHEN strftime(time, '%m-%d') >= '04-01'
  AND strftime(time, '%m-%d') < '10-15' THEN 'summer' ELSE 'winter' END AS season,
  CASE WHEN strftime(time, '%m-%d') < '04-01' THEN year(time) - 1 ELSE year(time) END AS y FROM ship)""",
                 sql.run_id("season", "keyed", "runs"))
       + "SELECT series_id, y || '.' || run AS season_run, min(time) AS first_day, count(*) AS days "
         "FROM runs GROUP BY 1, 2")
def season_runs(spark, folder):
    """Seasons numbered through the whole series, labelled year.run."""
    days = series.ship_daily(spark, folder)
    runs = win.with_run_id(days, cal.season(F.col("time"), SEASONS))
    label = F.concat_ws(".", cal.water_year(F.col("time"), tuple(SEASONS.values())).cast("string"),
                        F.col("run").cast("string"))
    return runs.groupBy("series_id", label.alias("season_run")).agg(
        F.min("time").alias("first_day"), F.count(F.lit(1)).alias("days"))


@query("regular_step", "series_id:s unit:s step:i",
       sql.with_(sql.ORDER, """months AS (SELECT DISTINCT 'months ' || series_id AS series_id,
  CAST(date_trunc('month', time) AS DATE) AS time FROM ords)""",
                 """years AS (SELECT DISTINCT 'years ' || series_id AS series_id,
  CAST(date_trunc('year', time) AS DATE) AS time FROM ords)""",
                 sql.full("ords", "filled"),
                 """both_ AS (SELECT series_id, time FROM ords UNION ALL SELECT * FROM months UNION ALL
  SELECT * FROM years UNION ALL SELECT 'filled ' || series_id, time FROM filled)""",
                 """steps AS (SELECT series_id, time - lag(time) OVER w AS d,
  date_diff('month', lag(time) OVER w, time) AS m,
  day(time) = day(lag(time) OVER w) AS same FROM both_
  WINDOW w AS (PARTITION BY series_id ORDER BY time))""")
       + """SELECT series_id, CASE WHEN min(d) = max(d) THEN 'day'
  WHEN min(m) = max(m) AND bool_and(same) AND min(m) % 12 = 0 THEN 'year'
  WHEN min(m) = max(m) AND bool_and(same) THEN 'month' END AS unit,
  CASE WHEN min(d) = max(d) THEN min(d) WHEN min(m) = max(m) AND bool_and(same) AND min(m) % 12 = 0
  THEN min(m) // 12 WHEN min(m) = max(m) AND bool_and(same) THEN min(m) END AS step
FROM steps GROUP BY 1""")
def regular_step(spark, folder):
    """Time step of gappy, filled, monthly and yearly series."""
    days = series.order_daily(spark, folder)

    def coarse(unit: str):
        return days.select(F.concat(F.lit(f"{unit}s "), "series_id").alias("series_id"),
                           F.trunc("time", unit).alias("time")).distinct()

    filled = add_missing_days(days).select(F.concat(F.lit("filled "), "series_id").alias("series_id"), "time")
    every = days.select("series_id", "time").unionByName(coarse("month")).unionByName(
        coarse("year")).unionByName(filled)
    return guess_step(every)


@query("moving_averages", "series_id:s time:d past:f6 center:f6 center_even:f6 future:f6",
       sql.with_(sql.STATUS, sql.full("status"))
       + """SELECT series_id, time,
  CASE WHEN count(value) OVER p = 7 THEN avg(value) OVER p END AS past,
  CASE WHEN count(value) OVER c = 7 THEN avg(value) OVER c END AS center,
  CASE WHEN count(value) OVER e = 10 THEN avg(value) OVER e END AS center_even,
  CASE WHEN count(value) OVER f = 3 THEN avg(value) OVER f END AS future
FROM fullc WINDOW p AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  c AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
  e AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING),
  f AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")
def moving_averages(spark, folder):
    """Past, centred (odd and even) and future moving averages over series with gaps."""
    days = add_missing_days(series.ship_daily_by_status(spark, folder))
    v = F.col("value")
    return days.select("series_id", "time", win.moving_average(v, 7).alias("past"),
                       win.moving_average(v, 7, "center").alias("center"),
                       win.moving_average(v, 10, "center").alias("center_even"),
                       win.moving_average(v, 3, "future").alias("future"))


@query("constant_runs", "series_id:s run:i first_day:d length:i total:f2",
       sql.with_(sql.SHIP, "high AS (SELECT *, value > avg(value) OVER (PARTITION BY series_id) AS h FROM ship)", sql.run_id("h", "high", "runs"))
       + "SELECT series_id, run, min(time) AS first_day, count(*) AS length, max(cum) AS total FROM "
         "(SELECT *, sum(value) OVER (PARTITION BY series_id ORDER BY time) AS cum FROM runs) GROUP BY 1, 2")
def constant_runs(spark, folder):
    """Runs of days above or below the mean flow, with run length and cumulative flow."""
    days = series.ship_daily(spark, folder).withColumns({
        "cum": F.sum("value").over(so_far(in_time())),
        "high": F.col("value") > F.avg("value").over(by_key())})
    runs = win.with_run_length(win.with_run_id(days, F.col("high")))
    return runs.groupBy("series_id", "run").agg(F.min("time").alias("first_day"),
                                                F.first("run_length").alias("length"),
                                                F.max("cum").alias("total"))


@query("constant_step_runs", "series_id:s run:i first_day:d days:i",
       sql.with_(sql.ORDER, """step AS (SELECT series_id, time, date_diff('day', lag(time) OVER w, time) AS d
  FROM ords WINDOW w AS (PARTITION BY series_id ORDER BY time))""",
                 "usual AS (SELECT series_id, quantile_cont(d, 0.5) AS u FROM step GROUP BY 1)",
                 """runs AS (SELECT step.series_id, time, 1 + sum(CASE WHEN d <> u THEN 1 ELSE 0 END)
  OVER (PARTITION BY step.series_id ORDER BY time) AS run FROM step JOIN usual USING (series_id))""")
       + "SELECT series_id, run, min(time) AS first_day, count(*) AS days FROM runs GROUP BY 1, 2")
def constant_step_runs(spark, folder):
    """Stretches of days following each other at the usual step."""
    runs = win.with_step_id(series.order_daily(spark, folder), F.unix_date("time"))
    return runs.groupBy("series_id", "run").agg(F.min("time").alias("first_day"),
                                                F.count(F.lit(1)).alias("days"))


@query("flow_peaks", "series_id:s time:d value:f2 block:i",
       sql.with_(sql.SHIP, """p AS (SELECT *, (row_number() OVER w - 1) // 5 + 1 AS block,
  lag(value, 1) OVER w AS a1, lag(value, 2) OVER w AS a2, lead(value, 1) OVER w AS b1,
  lead(value, 2) OVER w AS b2 FROM ship WINDOW w AS (PARTITION BY series_id ORDER BY time))""")
       + "SELECT series_id, time, value, block FROM p "
         "WHERE value >= a1 AND value >= a2 AND value > b1 AND value > b2")
def flow_peaks(spark, folder):
    """Flood peaks: maxima of a five-day window, with the five-day block they fall in."""
    days = win.with_block(series.ship_daily(spark, folder), 5)
    return days.withColumn("peak", win.is_peak(F.col("value"), 2)).where("peak")


@query("season_days", "series_id:s season:s days:i total:f2",
       sql.with_(sql.SHIP) + """SELECT series_id, 'warm' AS season, count(*) AS days, sum(value) AS total FROM ship
  WHERE strftime(time, '%m-%d') BETWEEN '05-01' AND '09-30' GROUP BY 1
UNION ALL SELECT series_id, 'cool', count(*), sum(value) FROM ship
  WHERE strftime(time, '%m-%d') >= '11-01' OR strftime(time, '%m-%d') <= '02-28' GROUP BY 1""")
def season_days(spark, folder):
    """Days between two month-days, within a year and across its end."""
    days = series.ship_daily(spark, folder)
    parts = [season_filter(days, a, b).groupBy("series_id").agg(
        F.lit(name).alias("season"), F.count(F.lit(1)).alias("days"), F.sum("value").alias("total"))
        for name, a, b in (("warm", "-05-01", "-09-30"), ("cool", "-11-01", "-02-28"))]
    return parts[0].unionByName(parts[1])


@query("status_wording", "series_id:s n:i count_word:s listing:s",
       """WITH s AS (SELECT DISTINCT l_returnflag AS series_id, l_linestatus AS x FROM lineitem),
l AS (SELECT series_id, count(*) AS n, list_sort(list(x)) AS xs FROM s GROUP BY 1)
SELECT series_id, n, CASE n WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS count_word,
  CASE WHEN n = 1 THEN xs[1] ELSE array_to_string(xs[:-2], ', ') || ' and ' || xs[-1] END AS listing FROM l""")
def status_wording(spark, folder):
    """Numbers in words and enumerations in text."""
    found = series.table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("series_id")).agg(
        F.array_sort(F.collect_set("l_linestatus")).alias("xs"))
    return found.select("series_id", F.size("xs").alias("n"), number_words(F.size("xs")).alias("count_word"),
                        join_with_and(F.col("xs")).alias("listing"))
