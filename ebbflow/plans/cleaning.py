"""Queries on cleaning, gaps and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.functions.calendar import month_day_label
from ebbflow.operators import clean
from ebbflow.operators.windows import approx_at, fill_gaps
from ebbflow.plans import fragments as sql
from ebbflow.plans.registry import query
from ebbflow.sources import series

RAW = """raw AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS time, round(value - 20.0, 2) AS value,
  event_id AS ord FROM events)"""

GAPPED = "gapped AS (SELECT series_id, time, value FROM ords)"

FILLED = """pos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) AS p,
  count(*) OVER (PARTITION BY series_id) AS n FROM fullc),
nb AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN p END) OVER (PARTITION BY series_id ORDER BY p) AS p0,
  min(CASE WHEN value IS NOT NULL THEN p END) OVER (PARTITION BY series_id ORDER BY p DESC) AS p1 FROM pos),
filled AS (SELECT nb.series_id, nb.time, CASE WHEN nb.value IS NOT NULL THEN nb.value
  WHEN coalesce(p1, nb.n + 1) - coalesce(p0, 0) - 1 > {limit} THEN NULL
  ELSE coalesce(a.value + (b.value - a.value) * (nb.p - a.p) / (b.p - a.p), a.value, b.value) END AS value,
  nb.value IS NULL AND coalesce(p1, nb.n + 1) - coalesce(p0, 0) - 1 <= {limit} AS was_filled
 FROM nb LEFT JOIN pos a ON a.series_id = nb.series_id AND a.p = nb.p0
 LEFT JOIN pos b ON b.series_id = nb.series_id AND b.p = nb.p1)"""


@query("sanitize_series", "series_id:s time:d value:f4",
       sql.with_(RAW, """pos_ AS (SELECT series_id, time, CASE WHEN value >= 0 THEN value END AS value, ord FROM raw),
firsts AS (SELECT series_id, time, arg_min(coalesce(value, -1), ord) AS value FROM pos_ GROUP BY 1, 2),
kept AS (SELECT series_id, time, CASE WHEN value >= 0 THEN value END AS value FROM firsts)""",
                 sql.full("kept"), FILLED.format(limit=2)) + "SELECT series_id, time, value FROM filled")
def sanitize_series(spark, folder):
    """Raw observations cleaned: negatives removed, first of each day kept, short gaps filled."""
    return clean.sanitize_ts(series.event_observations(spark, folder), "event_id", force_positive=True,
                             approx_missing=2).series


@query("sanitize_log", "series_id:s step:i what:s n:i action:s n_total:i percent_of_output:f4 n_in:i n_out:i",
       sql.with_(RAW, """c AS (SELECT *, CASE WHEN value >= 0 THEN value END AS cv FROM raw),
rec AS (SELECT series_id, time, cv, min(ord) AS ord, count(*) AS n FROM c GROUP BY 1, 2, 3),
day_ AS (SELECT series_id, time, min(ord) AS ord, arg_min(coalesce(cv, -1), ord) AS v, count(*) AS records FROM rec GROUP BY 1, 2),
past AS (SELECT series_id, count(*) FILTER (time < prev) AS n_past FROM (SELECT *, lag(time) OVER
  (PARTITION BY series_id ORDER BY ord) AS prev FROM day_) GROUP BY 1)""",
                 "kept AS (SELECT series_id, time, CASE WHEN v >= 0 THEN v END AS value FROM day_)",
                 sql.full("kept"), FILLED.format(limit=2),
                 """tot AS (SELECT series_id, count(*) AS n_in, count(*) FILTER (value < 0) AS n_negative,
  count(*) FILTER (abs(value) < 1.4901161193847656e-08) AS n_zero FROM raw GROUP BY 1),
ident AS (SELECT series_id, sum(n) FILTER (n > 1) AS n_identical FROM rec GROUP BY 1),
dup AS (SELECT series_id, sum(records) FILTER (records > 1) AS n_dup, count(*) AS n_kept FROM day_ GROUP BY 1),
outp AS (SELECT series_id, count(*) AS n_out, count(*) FILTER (was_filled) AS n_filled FROM filled GROUP BY 1),
w AS (SELECT * FROM tot JOIN ident USING (series_id) JOIN dup USING (series_id) JOIN outp USING (series_id)
  JOIN past USING (series_id)),
rows_ AS (
SELECT series_id, 2 AS step, 'negative' AS what, n_negative AS n, 'nullified' AS action, n_in AS n_total, n_in, n_out FROM w
UNION ALL SELECT series_id, 3, 'zero', n_zero, '', n_in, n_in, n_out FROM w
UNION ALL SELECT series_id, 5, 'identical rows', n_identical, 'removed', n_in, n_in, n_out FROM w
UNION ALL SELECT series_id, 6, 'day repeated', n_dup, 'first kept', n_kept, n_in, n_out FROM w
UNION ALL SELECT series_id, 7, 'out of order', n_past, 'sorted', n_kept, n_in, n_out FROM w
UNION ALL SELECT series_id, 8, 'days absent', n_out - n_kept, 'days added', n_out, n_in, n_out FROM w
UNION ALL SELECT series_id, 9, 'gap filled', n_filled, 'interpolated', n_out, n_in, n_out FROM w)""")
       + "SELECT *, 100.0 * n / n_out AS percent_of_output FROM rows_ WHERE n > 0")
def sanitize_log(spark, folder):
    """What the cleaning found in each series."""
    return clean.sanitize_ts(series.event_observations(spark, folder), "event_id", force_positive=True,
                             approx_missing=2).log


@query("order_sanitize_log", "series_id:s step:i n:i n_total:i",
       sql.with_("""raw AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS time,
  floor(o_totalprice / 100000) AS value, o_orderkey AS ord FROM orders)""",
                 "rec AS (SELECT series_id, time, value, min(ord) AS ord, count(*) AS n FROM raw GROUP BY 1, 2, 3)",
                 """dayr AS (SELECT series_id, time, min(ord) AS ord, count(*) AS records, sum(n) AS n,
  sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS ident FROM rec GROUP BY 1, 2)""",
                 """lagged AS (SELECT *, lag(time) OVER (PARTITION BY series_id ORDER BY ord) AS prev FROM dayr)""",
                 """z AS (SELECT series_id, count(*) FILTER (value = 0) AS zero FROM raw GROUP BY 1)""",
                 """w AS (SELECT series_id, sum(n) AS n_in, count(*) AS kept, sum(ident) AS ident,
  sum(CASE WHEN records > 1 THEN records END) AS dup, count(*) FILTER (time < prev) AS past,
  date_diff('day', min(time), max(time)) + 1 AS n_out FROM lagged GROUP BY 1)""")
       + """SELECT * FROM (SELECT series_id, 3 AS step, zero AS n, n_in AS n_total FROM w JOIN z USING (series_id)
UNION ALL SELECT series_id, 5, ident, n_in FROM w UNION ALL SELECT series_id, 6, dup, kept FROM w
UNION ALL SELECT series_id, 7, past, kept FROM w UNION ALL SELECT series_id, 8, n_out - kept, n_out FROM w) WHERE n > 0""")
def order_sanitize_log(spark, folder):
    """Cleaning log of unordered raw orders with many records per day."""
    raw = series.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("time"),
        F.floor(F.col("o_totalprice") / 100000).cast("double").alias("value"), "o_orderkey")
    return clean.sanitize_ts(raw, "o_orderkey").log


FINDINGS = """rec AS (SELECT series_id, time, value, min(ord) AS ord, count(*) AS n FROM raw GROUP BY 1, 2, 3),
dayr AS (SELECT series_id, time, min(ord) AS ord, arg_min(value, ord) AS value, count(*) AS records FROM rec GROUP BY 1, 2),
lg AS (SELECT *, lag(time) OVER (PARTITION BY series_id ORDER BY ord) AS prev, lead(time) OVER t AS nxt,
  date_diff('day', time, lead(time) OVER t) - 1 AS absent FROM dayr WINDOW t AS (PARTITION BY series_id ORDER BY time)),
ga AS (SELECT *, count(*) FILTER (absent > 0) OVER (PARTITION BY series_id ORDER BY time) AS gap FROM lg),
fi AS (SELECT series_id, 2 AS step, 'negative' AS what, NULL AS gap, time AS first_day, time AS last_day, value, n FROM rec WHERE value < 0
UNION ALL SELECT series_id, 3, 'zero', NULL, time, time, value, n FROM rec WHERE abs(value) < 1.4901161193847656e-08
UNION ALL SELECT series_id, 5, 'identical rows', NULL, time, time, value, n FROM rec WHERE n > 1
UNION ALL SELECT rec.series_id, 6, 'day repeated', NULL, rec.time, rec.time, rec.value, n FROM rec JOIN dayr USING (series_id, time) WHERE records > 1
UNION ALL SELECT series_id, 7, 'out of order', NULL, time, time, value, 1 FROM lg WHERE time < prev
UNION ALL SELECT series_id, 8, 'days absent', gap, CAST(time + INTERVAL 1 DAY AS DATE), CAST(nxt - INTERVAL 1 DAY AS DATE), NULL, absent FROM ga WHERE absent > 0)"""


@query("sanitize_findings", "series_id:s step:i what:s gap:i first_day:d last_day:d value:f2 n:i",
       sql.with_(RAW, FINDINGS) + "SELECT * FROM fi")
def sanitize_findings(spark, folder):
    """The rows behind each entry of the cleaning log."""
    return clean.sanitize_findings(series.event_observations(spark, folder), "event_id")


@query("order_findings", "series_id:s step:i what:s gap:i first_day:d last_day:d value:f2 n:i",
       sql.with_("""raw AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS time, floor(o_totalprice / 100000) AS value, o_orderkey AS ord FROM orders)""",
                 FINDINGS) + "SELECT * FROM fi")
def order_findings(spark, folder):
    """Rows and numbered gaps behind the cleaning log of unordered raw orders."""
    raw = series.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("time"),
        F.floor(F.col("o_totalprice") / 100000).cast("double").alias("value"), "o_orderkey")
    return clean.sanitize_findings(raw, "o_orderkey")


@query("explicit_gaps", "series_id:s time:d value:f2",
       sql.with_(sql.ORDER, sql.full("ords")) + "SELECT * FROM fullc")
def explicit_gaps(spark, folder):
    """Implicit gaps made explicit."""
    return clean.add_missing_days(series.order_daily(spark, folder))


@query("short_gaps_filled", "series_id:s time:d value:f4 was_filled:b",
       sql.with_(sql.ORDER, sql.full("ords"), FILLED.format(limit=1))
       + "SELECT series_id, time, value, was_filled FROM filled")
def short_gaps_filled(spark, folder):
    """Gaps of one day interpolated."""
    days = clean.add_missing_days(series.order_daily(spark, folder))
    return fill_gaps(days, 1, flag="was_filled")


@query("coverage_by_year", "series_id:s year:i days_in_year:i days_with_data:i days_missing:i coverage:f6",
       sql.with_(sql.ORDER, f"""c AS (SELECT series_id, {sql.water_year(origin='09-01')} AS year,
  count(value) AS days_with_data FROM ords GROUP BY 1, 2)""")
       + f"""SELECT *, {sql.days_in('year', '09-01')} AS days_in_year,
  {sql.days_in('year', '09-01')} - days_with_data AS days_missing,
  days_with_data / {sql.days_in('year', '09-01')} AS coverage FROM c""")
def coverage_by_year(spark, folder):
    """Data coverage per hydrological year."""
    return clean.coverage_yearly(series.order_daily(spark, folder), "-09-01")


@query("incomplete_edges_removed", "series_id:s time:d value:f2",
       sql.with_(sql.SHIP, f"""y AS (SELECT *, year(time) AS y FROM ship),
c AS (SELECT series_id, y, count(value) / {sql.days_in('y')} AS cov FROM y GROUP BY 1, 2),
e AS (SELECT series_id, min(y) AS y0, max(y) AS y1 FROM c GROUP BY 1)""")
       + """SELECT y.series_id, time, value FROM y JOIN c USING (series_id, y) JOIN e USING (series_id)
WHERE (y > y0 AND y < y1) OR cov >= 0.99""")
def incomplete_edges_removed(spark, folder):
    """First and last year dropped where incomplete."""
    return clean.remove_incomplete_first_last(series.ship_daily(spark, folder))


@query("complete_years_only", "series_id:s year:i days:i total:f2",
       sql.with_(sql.SHIP, f"""c AS (SELECT series_id, year(time) AS year, count(*) AS days, sum(value) AS total
  FROM ship GROUP BY 1, 2)""")
       + f"SELECT series_id, year, days, total FROM c WHERE days >= {sql.days_in('year')}")
def complete_years_only(spark, folder):
    """Only years without a missing day."""
    days = clean.drop_incomplete_years(series.ship_daily(spark, folder))
    return days.groupBy("series_id", "year").agg(F.count(F.lit(1)).alias("days"), F.sum("value").alias("total"))


@query("gaps_carried_forward", "series_id:s time:d value:f2",
       sql.with_(sql.STATUS, sql.full("status"))
       + """SELECT series_id, time, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY time) AS value
FROM fullc""")
def gaps_carried_forward(spark, folder):
    """Missing-value policy "fill"."""
    return clean.treat_missing_values(
        clean.add_missing_days(series.ship_daily_by_status(spark, folder)), "fill")


@query("years_with_gaps_dropped", "series_id:s year:i days:i",
       sql.with_(sql.SHIP, sql.full("ship"))
       + """SELECT series_id, year(time) AS year, count(*) AS days FROM fullc GROUP BY 1, 2
HAVING count(*) = count(value)""")
def years_with_gaps_dropped(spark, folder):
    """Missing-value policy "drop_year"."""
    days = clean.add_missing_days(series.ship_daily(spark, folder)).withColumn("year", F.year("time"))
    return clean.treat_missing_values(days, "drop_year").groupBy("series_id", "year").agg(
        F.count(F.lit(1)).alias("days"))


@query("gap_table", "series_id:s gap_start:d gap_end:d days:i gap_no:i",
       sql.with_(sql.ORDER, """g AS (SELECT series_id, time + 1 AS gap_start, lead(time) OVER w - 1 AS gap_end
  FROM ords WINDOW w AS (PARTITION BY series_id ORDER BY time))""")
       + """SELECT series_id, gap_start, gap_end, gap_end - gap_start + 1 AS days,
  row_number() OVER (PARTITION BY series_id ORDER BY gap_start) AS gap_no FROM g WHERE gap_end >= gap_start""")
def gap_table(spark, folder):
    """Start, end and length of every gap."""
    return clean.gap_table(clean.add_missing_days(series.order_daily(spark, folder)))


@query("coverage_grid", "series_id:s year:i md:s coverage:s",
       sql.with_(sql.STATUS, sql.full("status"))
       + """SELECT series_id, year(time) AS year, strftime(time, '-%m-%d') AS md,
  CASE WHEN value IS NULL THEN 'data missing' ELSE 'data available' END AS coverage FROM fullc""")
def coverage_grid(spark, folder):
    """Availability of every day by year and month-day."""
    grid = clean.coverage_grid(clean.add_missing_days(series.ship_daily_by_status(spark, folder)))
    return grid.withColumn("md", month_day_label(F.col("md")))


@query("monthly_resample", "series_id:s time:d value:f8",
       sql.with_(sql.ORDER, """months AS (SELECT series_id, CAST(unnest(generate_series(
  date_trunc('month', min(time)), date_trunc('month', max(time)), INTERVAL 1 MONTH)) AS DATE) AS time
  FROM ords GROUP BY 1)""")
       + """SELECT m.series_id, m.time, CASE WHEN a.time = m.time THEN a.value ELSE
  a.value + (b.value - a.value) * date_diff('day', a.time, m.time) / date_diff('day', a.time, b.time) END AS value
FROM months m ASOF LEFT JOIN ords a ON m.series_id = a.series_id AND m.time >= a.time
ASOF LEFT JOIN ords b ON m.series_id = b.series_id AND m.time <= b.time""")
def monthly_resample(spark, folder):
    """Irregular observations interpolated to the first of every month."""
    days = series.order_daily(spark, folder)
    months = days.groupBy("series_id").agg(F.min(F.trunc("time", "month")).alias("a"),
                                           F.max(F.trunc("time", "month")).alias("b"))
    months = months.select("series_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("time"))
    return approx_at(days, months)


@query("years_completed", "series_id:s year:i n:i",
       sql.with_("""y AS (SELECT CAST(o_custkey AS VARCHAR) AS series_id, year(o_orderdate) AS year, count(*) AS n
  FROM orders GROUP BY 1, 2)""",
                 """span AS (SELECT series_id, unnest(generate_series(min(year), max(year))) AS year FROM y GROUP BY 1)""")
       + "SELECT s.series_id, s.year, y.n FROM span s LEFT JOIN y USING (series_id, year)")
def years_completed(spark, folder):
    """Years without an order of a customer added as NULL rows."""
    orders = series.table(spark, folder, "orders")
    return clean.complete_years(orders.groupBy(
        F.col("o_custkey").cast("string").alias("series_id"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n")))


@query("metadata_reconciled", "series_id:s metric:s computed:f4 provided:f4 difference:f4",
       sql.with_(sql.SUPP, """comp AS (SELECT series_id, year(min(time)) AS start, year(max(time)) AS "end",
  min(value) AS qmin, avg(value) AS qmean, max(value) AS qmax FROM supp GROUP BY 1)""",
                 """prov AS (SELECT CAST(s_suppkey AS VARCHAR) AS series_id, 1995 AS start, s_acctbal / 100 AS qmean FROM supplier)""")
       + """SELECT coalesce(c.series_id, p.series_id) AS series_id, 'start' AS metric, c.start AS computed,
  p.start AS provided, c.start - p.start AS difference FROM comp c FULL JOIN prov p USING (series_id)
UNION ALL SELECT coalesce(c.series_id, p.series_id), 'qmean', c.qmean, p.qmean, c.qmean - p.qmean
FROM comp c FULL JOIN prov p USING (series_id)""")
def metadata_reconciled(spark, folder):
    """Computed against provided station attributes."""
    computed = clean.series_metadata(series.supplier_daily(spark, folder))
    provided = series.table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("series_id"), F.lit(1995).alias("start"),
        (F.col("s_acctbal") / 100).alias("qmean"))
    return clean.reconcile(computed, provided, ["start", "qmean"])


@query("station_metadata", "series_id:s start:i end:i years:f6 qmin:f2 qmean:f6 qmax:f2",
       sql.with_(sql.SUPP) + """SELECT series_id, year(min(time)) AS start, year(max(time)) AS "end",
  date_diff('day', min(time), max(time)) / 365 AS years, min(value) AS qmin, avg(value) AS qmean,
  max(value) AS qmax FROM supp GROUP BY 1""")
def station_metadata(spark, folder):
    """Computed attributes of every supplier series."""
    return clean.series_metadata(series.supplier_daily(spark, folder))
