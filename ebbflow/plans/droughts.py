"""Queries on drought events, sequent peak, base flow and recession."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.columns import by_key
from ebbflow.functions.calendar import water_year
from ebbflow.operators import events as ev
from ebbflow.operators import indices as idx
from ebbflow.operators import thresholds as thr
from ebbflow.operators.clean import add_missing_days
from ebbflow.operators.windows import moving_average
from ebbflow.plans import fragments as sql
from ebbflow.plans.flows import RECESSION
from ebbflow.plans.registry import query
from ebbflow.sources import series

def q90():
    """Flow exceeded on 90 % of the days of a series."""
    return F.percentile("value", F.lit(0.1)).over(by_key())


THR = """thr AS (SELECT series_id, quantile_cont(value, 0.1) AS threshold FROM {source} GROUP BY 1),
days AS (SELECT d.series_id, d.time, d.value, threshold,
  coalesce(lead(d.time) OVER w, d.time + 1) AS end_, value < threshold AS below,
  (threshold - value) * 86400.0 * date_diff('day', d.time, coalesce(lead(d.time) OVER w, d.time + 1)) AS volume
  FROM {source} d JOIN thr USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY d.time))"""

STATE = "CASE WHEN value IS NULL THEN 2 WHEN below THEN 1 ELSE 0 END"

EVENTS = """ev AS (SELECT series_id, run, min(time) AS first_day, max(end_) - 1 AS last_day,
  count(*) AS dbt, sum(volume) AS volume, min(value) AS qmin, arg_min(time, (value, time)) AS tqmin
  FROM {runs} WHERE below AND value IS NOT NULL GROUP BY 1, 2)"""

PLAIN = """SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY first_day) AS event, first_day, last_day,
  last_day - first_day + 1 AS duration, dbt, volume, qmin, tqmin FROM ev"""

PLAIN_COLUMNS = "series_id:s event:i first_day:d last_day:d duration:i volume:f2 qmin:f6 tqmin:d"


def shipping(spark, folder):
    return add_missing_days(series.ship_daily(spark, folder))


def shipping_by_status(spark, folder):
    return add_missing_days(series.ship_daily_by_status(spark, folder))


@query("drought_events", PLAIN_COLUMNS,
       sql.with_(sql.SHIP, sql.full("ship"), THR.format(source="fullc"), sql.run_id(STATE, "days", "runs"),
                 EVENTS.format(runs="runs")) + PLAIN)
def drought_events(spark, folder):
    """Droughts below Q90 of every series."""
    return ev.drought_events(shipping(spark, folder), q90())


@query("supplier_drought_events", PLAIN_COLUMNS,
       sql.with_(sql.SUPP, sql.full("supp", "gaps"), """fullc AS (SELECT series_id, time, coalesce(value, 0.0) AS value FROM gaps)""",
                 """thr0 AS (SELECT series_id, quantile_cont(value, 0.9) AS threshold FROM fullc GROUP BY 1)""",
                 """days AS (SELECT d.series_id, d.time, d.value, threshold, d.time + 1 AS end_, value < threshold AS below,
  (threshold - value) * 86400.0 AS volume FROM fullc d JOIN thr0 USING (series_id))""",
                 sql.run_id(STATE, "days", "runs"), EVENTS.format(runs="runs")) + PLAIN)
def supplier_drought_events(spark, folder):
    """Droughts of many series below a high quantile of the zero-filled flow."""
    days = add_missing_days(series.supplier_daily(spark, folder), fill=0.0)
    return ev.drought_events(days, F.percentile("value", F.lit(0.9)).over(by_key()))


@query("drought_events_with_gaps", PLAIN_COLUMNS,
       sql.with_(sql.STATUS, sql.full("status"), THR.format(source="fullc"), sql.run_id(STATE, "days", "runs"),
                 EVENTS.format(runs="runs")) + PLAIN)
def drought_events_with_gaps(spark, folder):
    """Droughts of series with missing days: a missing day ends an event."""
    days = shipping_by_status(spark, folder)
    return ev.drought_events(days, thr.const_threshold(days, thr.quantile(0.9)))


@query("drought_events_smoothed", PLAIN_COLUMNS,
       sql.with_(sql.SHIP, sql.full("ship", "raw"), """thr1 AS (SELECT series_id, quantile_cont(value, 0.4) AS threshold FROM raw GROUP BY 1),
fullc AS (SELECT series_id, time, CASE WHEN count(value) OVER e = 10 THEN avg(value) OVER e END AS value
  FROM raw WINDOW e AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)),
days AS (SELECT d.series_id, d.time, d.value, threshold, d.time + 1 AS end_, value < threshold AS below,
  (threshold - value) * 86400.0 AS volume FROM fullc d JOIN thr1 USING (series_id))""",
                 sql.run_id(STATE, "days", "runs"), EVENTS.format(runs="runs")) + PLAIN)
def drought_events_smoothed(spark, folder):
    """Droughts of the ten-day centred moving average."""
    days = shipping(spark, folder)
    # means of ten days often equal the quantile: its last digit decides
    q60 = thr.series_quantile("value", 0.4, by_key())
    return ev.drought_events(days.withColumn("q60", q60), "q60", "moving-average")


POOL = """gap AS (SELECT *, lag(last_day) OVER w AS prev, lag(run) OVER w AS prev_run FROM ev
  WINDOW w AS (PARTITION BY series_id ORDER BY first_day)),
void AS (SELECT g.series_id, g.run, count(r.run) AS nulls FROM gap g LEFT JOIN runs r ON r.series_id = g.series_id
  AND r.value IS NULL AND r.run > g.prev_run AND r.run < g.run GROUP BY 1, 2),
lab AS (SELECT g.*, sum(CASE WHEN date_diff('day', prev, first_day) - 1 < {limit} AND nulls = 0 THEN 0 ELSE 1 END)
  OVER (PARTITION BY g.series_id ORDER BY first_day) AS pool FROM gap g JOIN void USING (series_id, run)),
pooled AS (SELECT series_id, min(first_day) AS first_day, max(last_day) AS last_day, sum(dbt) AS dbt,
  sum(volume) AS volume, min(qmin) AS qmin, arg_min(tqmin, (qmin, tqmin)) AS tqmin, count(*) - 1 AS pooled
  FROM lab GROUP BY series_id, pool)"""

POOLED_COLUMNS = ("series_id:s event:i first_day:d last_day:d duration:i dbt:i volume:f2 qmin:f6 tqmin:d "
                  "pooled:i")

POOLED = """SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY first_day) AS event, first_day, last_day,
  last_day - first_day + 1 AS duration, dbt, volume, qmin, tqmin, pooled FROM pooled"""

POOLED_CTES = (sql.SHIP, sql.full("ship"), THR.format(source="fullc"), sql.run_id(STATE, "days", "runs"),
               EVENTS.format(runs="runs"), POOL.format(limit=5))


@query("drought_events_pooled", POOLED_COLUMNS, sql.with_(*POOLED_CTES) + POOLED)
def drought_events_pooled(spark, folder):
    """Droughts merged over short wet periods."""
    return ev.drought_events(shipping(spark, folder), q90(), "inter-event", min_duration=5)


@query("drought_events_pooled_gaps", POOLED_COLUMNS,
       sql.with_(sql.STATUS, sql.full("status"), THR.format(source="fullc"), sql.run_id(STATE, "days", "runs"),
                 EVENTS.format(runs="runs"), POOL.format(limit=10)) + POOLED)
def drought_events_pooled_gaps(spark, folder):
    """Pooling never bridges a missing day."""
    return ev.drought_events(shipping_by_status(spark, folder), q90(), "inter-event", min_duration=10)


@query("drought_events_pooled_volume", POOLED_COLUMNS,
       sql.with_(sql.SHIP, sql.full("ship"), THR.format(source="fullc"), sql.run_id(STATE, "days", "runs"),
                 EVENTS.format(runs="runs"),
                 """wet AS (SELECT e.series_id, e.run, sum(CASE WHEN NOT r.below THEN -r.volume ELSE 0 END) AS wet,
  CASE WHEN count(*) FILTER (r.run IS NOT NULL AND r.value IS NULL) > 0 THEN 1000000
    ELSE date_diff('day', min(e.prev), min(e.first_day)) - 1 END AS gap
  FROM (SELECT *, lag(last_day) OVER (PARTITION BY series_id ORDER BY first_day) AS prev FROM ev) e
  LEFT JOIN runs r ON r.series_id = e.series_id AND r.time > e.prev AND r.time < e.first_day GROUP BY 1, 2)""",
                 """seq AS (SELECT ev.*, wet, gap, row_number() OVER (PARTITION BY series_id ORDER BY first_day) AS i
  FROM ev JOIN wet USING (series_id, run))""").replace("WITH ", "WITH RECURSIVE ", 1)
       + """, fold AS (SELECT series_id, i, 1 AS pool, volume AS vol FROM seq WHERE i = 1
UNION ALL SELECT s.series_id, s.i, CASE WHEN s.gap < 30 AND s.wet < 20.0 * f.vol THEN f.pool ELSE f.pool + 1 END,
  CASE WHEN s.gap < 30 AND s.wet < 20.0 * f.vol THEN f.vol + s.volume ELSE s.volume END
  FROM fold f JOIN seq s ON s.series_id = f.series_id AND s.i = f.i + 1),
pooled AS (SELECT s.series_id, min(first_day) AS first_day, max(last_day) AS last_day, sum(dbt) AS dbt,
  sum(volume) AS volume, min(qmin) AS qmin, arg_min(tqmin, (qmin, tqmin)) AS tqmin, count(*) - 1 AS pooled
  FROM seq s JOIN fold f USING (series_id, i) GROUP BY s.series_id, pool)
""" + POOLED)
def drought_events_pooled_volume(spark, folder):
    """Pooling that also compares the excess volume with the deficit pooled so far."""
    return ev.drought_events(shipping(spark, folder), q90(), "inter-event", min_duration=30, min_vol_ratio=20.0)


SPA = """acc AS (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER w AS span FROM days
  WINDOW w AS (PARTITION BY series_id ORDER BY time)),
cum AS (SELECT *, sum(threshold - value) OVER (PARTITION BY series_id, span ORDER BY time) AS c FROM acc),
spa AS (SELECT * EXCLUDE (below), CASE WHEN value IS NULL THEN 0.0 ELSE c - least(0.0, min(c) OVER
  (PARTITION BY series_id, span ORDER BY time)) END AS storage FROM cum),
spab AS (SELECT *, storage > 0 AS below FROM spa)"""

SPA_EVENTS = """, sev AS (SELECT series_id, run, min(time) AS first_day, max(end_) - 1 AS last_day, count(*) AS dbt,
  max(storage) AS volume, arg_min(time, (-storage, time)) AS peak, min(value) AS qmin,
  arg_min(time, (value, time)) AS tqmin FROM runs WHERE below AND value IS NOT NULL GROUP BY 1, 2)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY first_day) AS event, first_day, last_day,
  date_diff('day', first_day, peak) + 1 AS duration, dbt, volume, qmin, tqmin FROM sev"""

SPA_COLUMNS = "series_id:s event:i first_day:d last_day:d duration:i dbt:i volume:f6 qmin:f6 tqmin:d"


@query("sequent_peak_events", SPA_COLUMNS,
       sql.with_(sql.SHIP, sql.full("ship"), THR.format(source="fullc"), SPA, sql.run_id(STATE, "spab", "runs"))
       + SPA_EVENTS.replace(", sev AS", ", sev AS", 1))
def sequent_peak_events(spark, folder):
    """Droughts of the sequent peak algorithm."""
    return ev.drought_events(shipping(spark, folder), q90(), "sequent-peak")


@query("sequent_peak_storage", "series_id:s time:d storage:f6",
       sql.with_(sql.SHIP, """th AS (SELECT series_id, quantile_cont(value, 0.1) AS t FROM ship GROUP BY 1)""",
                 """o AS (SELECT s.series_id, time, t - value AS d, row_number() OVER
  (PARTITION BY s.series_id ORDER BY time) AS i FROM ship s JOIN th USING (series_id))""").replace(
           "WITH ", "WITH RECURSIVE ", 1)
       + """, loop_ AS (SELECT series_id, i, greatest(d, 0.0) AS storage FROM o WHERE i = 1
UNION ALL SELECT o.series_id, o.i, greatest(l.storage + o.d, 0.0) FROM loop_ l JOIN o
  ON o.series_id = l.series_id AND o.i = l.i + 1)
SELECT series_id, time, storage FROM loop_ JOIN o USING (series_id, i)""")
def sequent_peak_storage(spark, folder):
    """Daily storage, checked against the step-by-step recurrence."""
    days = series.ship_daily(spark, folder).withColumn("threshold", q90())
    return ev.with_storage(days)


@query("sequent_peak_gaps", SPA_COLUMNS,
       sql.with_(sql.STATUS, sql.full("status"), THR.format(source="fullc"), SPA, sql.run_id(STATE, "spab", "runs"))
       + SPA_EVENTS)
def sequent_peak_gaps(spark, folder):
    """Sequent peak droughts of series with missing days."""
    return ev.drought_events(shipping_by_status(spark, folder), q90(), "sequent-peak")


@query("drought_events_seasonal", PLAIN_COLUMNS,
       sql.with_(sql.SHIP, sql.full("ship"), """mt AS (SELECT series_id, month(time) AS m, quantile_cont(value, 0.2) AS threshold
  FROM fullc WHERE value IS NOT NULL GROUP BY 1, 2),
days AS (SELECT d.series_id, d.time, d.value, threshold, d.time + 1 AS end_, value < threshold AS below,
  (threshold - value) * 86400.0 AS volume FROM fullc d JOIN mt ON mt.series_id = d.series_id AND m = month(time))""",
                 sql.run_id(STATE, "days", "runs"), EVENTS.format(runs="runs")) + PLAIN)
def drought_events_seasonal(spark, folder):
    """Droughts below a threshold that varies by month."""
    days = shipping(spark, folder)
    return ev.drought_events(days, thr.period_threshold("month", thr.quantile(0.8)))


@query("drought_events_daily_threshold", POOLED_COLUMNS,
       sql.with_(sql.SHIP, sql.full("ship"), """sm AS (SELECT series_id, time, CASE WHEN count(value) OVER e = 30 THEN avg(value) OVER e END AS value
  FROM fullc WINDOW e AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING)),
dv AS (SELECT series_id, strftime(time, '-%m-%d') AS md, value FROM sm WHERE value IS NOT NULL
 UNION ALL SELECT series_id, '-02-29', avg(value) FROM sm WHERE strftime(time, '%m-%d') IN ('02-28', '03-01')
  AND NOT (year(time) % 4 = 0 AND (year(time) % 100 <> 0 OR year(time) % 400 = 0))
  GROUP BY series_id, year(time) HAVING count(value) = count(*)),
dt AS (SELECT series_id, md, quantile_cont(value, 0.2) AS threshold FROM dv GROUP BY 1, 2),
days AS (SELECT d.series_id, d.time, d.value, threshold, d.time + 1 AS end_, value < threshold AS below,
  (threshold - value) * 86400.0 AS volume FROM fullc d LEFT JOIN dt ON dt.series_id = d.series_id
  AND md = strftime(time, '-%m-%d'))""",
                 sql.run_id(STATE, "days", "runs"), EVENTS.format(runs="runs"), POOL.format(limit=10)) + POOLED)
def drought_events_daily_threshold(spark, folder):
    """Pooled droughts below the daily Q80 of the smoothed series."""
    days = shipping(spark, folder)
    smooth = days.withColumn("value", moving_average(F.col("value"), 30, "center"))
    return ev.drought_events(days, thr.var_threshold(smooth, "day", thr.quantile(0.8)), "inter-event",
                             min_duration=10)


@query("missing_beside_drought", "series_id:s time:d value:f2 threshold:f6",
       sql.with_(sql.STATUS, sql.full("status"), THR.format(source="fullc"))
       + """SELECT series_id, time, value, threshold FROM (SELECT *, lag(value IS NULL) OVER w AS a, lead(value IS NULL) OVER w AS b
  FROM days WINDOW w AS (PARTITION BY series_id ORDER BY time)) WHERE value <= threshold AND (a OR b)""")
def missing_beside_drought(spark, folder):
    """Low days next to a missing day."""
    return ev.na_warnings(shipping_by_status(spark, folder), q90())


@query("deficit_band", "series_id:s time:d value:f2 lwr:f6 upr:f6 below:b",
       sql.with_(sql.SHIP, sql.full("ship"), THR.format(source="fullc"))
       + """SELECT series_id, time, value, CASE WHEN below THEN value ELSE threshold END AS lwr, threshold AS upr, below FROM days""")
def deficit_band(spark, folder):
    """Edges of the shaded deficit area."""
    days = ev.drought_days(shipping(spark, folder), q90())
    return ev.deficit_band(days).withColumn("below", F.col("value") < F.col("threshold"))


@query("largest_storage_event", "series_id:s time:d value:f2 storage:f6",
       sql.with_(sql.SHIP, sql.full("ship"), THR.format(source="fullc"), SPA, sql.run_id(STATE, "spab", "runs"),
                 """top AS (SELECT series_id, arg_min(run, (-storage, time)) AS r FROM runs GROUP BY 1),
b AS (SELECT series_id, min(time) - 1 AS a, max(time) + 1 AS z FROM runs JOIN top USING (series_id) WHERE run = r GROUP BY 1)""")
       + "SELECT series_id, time, value, storage FROM runs JOIN b USING (series_id) WHERE time BETWEEN a AND z")
def largest_storage_event(spark, folder):
    """Days of the largest sequent peak event and one day either side."""
    days = ev.drought_days(shipping(spark, folder), q90(), "sequent-peak")
    top = F.max_by("event", F.struct("storage", (-F.unix_date("time")).alias("t"))).over(by_key())
    return ev.around_event(days.withColumn("top", top), F.col("top"))


MINOR = sql.with_(*POOLED_CTES, f"num AS ({POOLED})",
                  """flag AS (SELECT *, (duration < 5 OR volume < 0.005 * max(volume) OVER (PARTITION BY series_id)) AS is_minor FROM num)""")


@query("minor_droughts", "series_id:s event:i duration:i volume:f2 is_minor:b",
       MINOR + "SELECT series_id, event, duration, volume, is_minor FROM flag")
def minor_droughts(spark, folder):
    """Pooled droughts with a flag for the minor ones."""
    return ev.flag_minor(ev.drought_events(shipping(spark, folder), q90(), "inter-event", min_duration=5))


@query("droughts_per_year", "series_id:s year:i n_droughts:i real_duration:i min_flow:f2",
       MINOR + f"""SELECT series_id, {sql.water_year('first_day', '09-01')} AS year, count(*) AS n_droughts,
  sum(dbt) AS real_duration, min(qmin) AS min_flow FROM flag WHERE NOT is_minor GROUP BY 1, 2""")
def droughts_per_year(spark, folder):
    """Major droughts per hydrological year."""
    pooled = ev.drought_events(shipping(spark, folder), q90(), "inter-event", min_duration=5)
    return idx.events_per_year(ev.flag_minor(pooled).where("not is_minor"), "-09-01")


@query("drought_duration_histogram", "series_id:s bin:i n:i",
       MINOR + "SELECT series_id, duration // 5 * 5 AS bin, count(*) AS n FROM flag GROUP BY 1, 2")
def drought_duration_histogram(spark, folder):
    """Drought durations in bins of five days."""
    pooled = ev.drought_events(shipping(spark, folder), q90(), "inter-event", min_duration=5)
    return idx.histogram(pooled, "duration", 5, ["series_id"])


@query("partial_duration_series", "series_id:s event:i year:i first_day:d duration:f2 volume:f4",
       sql.with_(*POOLED_CTES, f"num AS ({POOLED})", """lim AS (SELECT series_id, event, first_day, CAST(dbt AS DOUBLE) AS duration,
  volume / 1000 AS volume, round_even(max(volume / 1000) OVER (PARTITION BY series_id) * 0.005, 0) AS limit_ FROM num)""")
       + f"""SELECT series_id, event, {sql.water_year('first_day')} AS year, first_day, duration, volume FROM lim
WHERE duration >= 4 AND volume >= limit_""")
def partial_duration_series(spark, folder):
    """Major droughts as a partial duration series."""
    return _partial_series(spark, folder)[0]


@query("drought_free_years", "series_id:s year:i",
       sql.with_(*POOLED_CTES, f"num AS ({POOLED})", """lim AS (SELECT series_id, first_day, CAST(dbt AS DOUBLE) AS duration,
  volume / 1000 AS volume, round_even(max(volume / 1000) OVER (PARTITION BY series_id) * 0.005, 0) AS limit_ FROM num)""",
                 "major AS (SELECT DISTINCT series_id, year(first_day) AS year FROM lim WHERE duration >= 4 AND volume >= limit_)")
       + "SELECT DISTINCT series_id, year(time) AS year FROM fullc ANTI JOIN major ON major.series_id = fullc.series_id AND major.year = year(time)")
def drought_free_years(spark, folder):
    """Years without a major drought."""
    return _partial_series(spark, folder)[1]


def _partial_series(spark, folder):
    days = shipping(spark, folder)
    pooled = ev.drought_events(days, q90(), "inter-event", min_duration=5)
    years = days.select("series_id", F.year("time").alias("year")).distinct()
    return idx.partial_duration_series(pooled, years, min_days=4)


# ---- base flow and recession -----------------------------------------------------------------

BASEFLOW = """blk AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY time) - 1) // 5 AS b FROM {source}),
low AS (SELECT series_id, b, min(value) AS q, arg_min(time, (value, time)) AS t FROM blk WHERE value IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT series_id, t, q FROM (SELECT *, lag(q) OVER w AS a, lead(q) OVER w AS z FROM low
  WINDOW w AS (PARTITION BY series_id ORDER BY b)) WHERE 0.9 * q <= a AND 0.9 * q <= z),
bf AS (SELECT d.series_id, d.time, d.value, least(d.value, CASE WHEN p.t = n.t THEN p.q ELSE
  p.q + (n.q - p.q) * date_diff('day', p.t, d.time) / date_diff('day', p.t, n.t) END) AS baseflow, p.t = d.time AS turning_point
  FROM {source} d ASOF LEFT JOIN tp p ON p.series_id = d.series_id AND d.time >= p.t
  ASOF LEFT JOIN tp n ON n.series_id = d.series_id AND d.time <= n.t)"""


@query("baseflow_line", "series_id:s time:d value:f2 baseflow:f6 turning_point:b",
       sql.with_(sql.SHIP, BASEFLOW.format(source="ship"))
       + """SELECT series_id, time, value, CASE WHEN turning_point IS NULL OR baseflow IS NULL THEN NULL ELSE baseflow END AS baseflow,
  coalesce(turning_point, false) AS turning_point FROM
  (SELECT bf.series_id, bf.time, bf.value, turning_point, CASE WHEN time BETWEEN lo AND hi THEN baseflow END AS baseflow FROM bf
   JOIN (SELECT series_id, min(t) AS lo, max(t) AS hi FROM tp GROUP BY 1) USING (series_id))""")
def baseflow_line(spark, folder):
    """Base flow separation of every series."""
    return ev.baseflow(series.ship_daily(spark, folder))


@query("baseflow_index", "series_id:s year:i total:f0 baseflow:f0 bfi:f8",
       sql.with_(sql.SUPP, BASEFLOW.format(source="supp"))
       + """SELECT bf.series_id, year(time) AS year, sum(value) * 86400 AS total, sum(baseflow) * 86400 AS baseflow,
  sum(baseflow) / sum(value) AS bfi FROM bf JOIN (SELECT series_id, min(t) AS lo, max(t) AS hi FROM tp GROUP BY 1) USING (series_id)
WHERE time BETWEEN lo AND hi AND baseflow IS NOT NULL GROUP BY 1, 2""")
def baseflow_index(spark, folder):
    """Base flow index per year of many series."""
    flows = ev.baseflow(series.supplier_daily(spark, folder))
    return ev.baseflow_index(flows, ["series_id", water_year(F.col("time")).alias("year")])


@query("recession_constant", "series_id:s pairs:i q0:f2 k:f8 alpha:f8",
       sql.with_(sql.SHIP, sql.full("ship"), RECESSION.format(source="fullc", minlen=4)) + "SELECT * FROM rec")
def recession_constant(spark, folder):
    """Recession constant of every series."""
    return ev.recession(shipping(spark, folder), minlen=4)


@query("recession_bridged", "series_id:s pairs:i alpha:f8",
       sql.with_(sql.SHIP, sql.full("ship"), """st AS (SELECT series_id, time, value, CASE WHEN lead(value) OVER w <= value THEN true
  WHEN lead(value) OVER w > value THEN false END AS falling FROM fullc WINDOW w AS (PARTITION BY series_id ORDER BY time))""",
                 sql.run_id("falling", "st", "one"),
                 """br AS (SELECT series_id, time, value, CASE WHEN NOT falling AND count(*) OVER (PARTITION BY series_id, run) <= 1
  THEN true ELSE falling END AS f2 FROM one)""", sql.run_id("f2", "br", "two"),
                 """sg AS (SELECT *, lead(value) OVER (PARTITION BY series_id, run ORDER BY time) AS nxt,
  count(*) OVER (PARTITION BY series_id, run) AS size FROM two WHERE f2)""")
       + """SELECT series_id, count(*) AS pairs, -ln(sum(value * nxt) / sum(value * value)) AS alpha FROM sg
WHERE size >= 5 AND nxt IS NOT NULL GROUP BY 1""")
def recession_bridged(spark, folder):
    """Recession constant with one-day rises bridged."""
    return ev.recession(shipping(spark, folder), smooth=1)


@query("master_recession", "series_id:s time:d day:i shift:f6 day_shifted:f6",
       sql.with_(sql.SHIP, sql.full("ship"), RECESSION.format(source="fullc", minlen=4))
       + """SELECT p.series_id, time, day, shift, day + shift - 1 AS day_shifted FROM (SELECT pairs.*, (ln(arg_min(value, day)
  OVER (PARTITION BY pairs.series_id, run)) - ln(q0)) / ln(k) AS shift FROM pairs JOIN rec USING (series_id)) p""")
def master_recession(spark, folder):
    """Segments shifted onto the master recession curve."""
    return ev.master_recession(shipping(spark, folder), minlen=4)
