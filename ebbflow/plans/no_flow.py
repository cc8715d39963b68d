"""Queries on no-flow spells and intermittency indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.functions.calendar import day_of_normal_year
from ebbflow.operators import spells as sp
from ebbflow.operators.clean import add_missing_days
from ebbflow.plans import fragments as sql
from ebbflow.plans.registry import query
from ebbflow.sources import series

THRESHOLD = 0.001

STATE = "CASE WHEN value IS NULL THEN 'no data' WHEN value <= 0.001 THEN 'no-flow' ELSE 'flow' END"

SPELLS = (f"st AS (SELECT series_id, time, value, year(time) AS y, month(time) AS m, {STATE} AS state FROM nat)",
          sql.run_id("state", "st", "sp"))

YEARS = """sy AS (SELECT series_id, y, run, state, count(*) AS n, min(time) AS a, max(time) AS z FROM sp GROUP BY 1, 2, 3, 4),
yr AS (SELECT series_id, y AS year, coalesce(sum(n) FILTER (state = 'no-flow'), 0) AS no_flow_days,
  coalesce(max(n) FILTER (state = 'no-flow'), 0) AS longest_spell, min(a) FILTER (state = 'no-flow') AS onset,
  arg_min(z, a) FILTER (state = 'no-flow') AS "end" FROM sy GROUP BY 1, 2)"""


@query("annual_no_flow", "series_id:s year:i no_flow_days:i longest_spell:i onset:d end:d",
       sql.with_(sql.NATION, *SPELLS, YEARS) + "SELECT * FROM yr")
def annual_no_flow(spark, folder):
    """No-flow days, longest spell and first spell per year."""
    return sp.annual_no_flow(series.nation_daily(spark, folder))


@query("no_flow_days_per_year", "series_id:s year:i FAN:i",
       sql.with_(sql.NATION, *SPELLS, YEARS) + 'SELECT series_id, year, no_flow_days AS "FAN" FROM yr')
def no_flow_days_per_year(spark, folder):
    """Frequency of no-flow days."""
    return sp.FAN(series.nation_daily(spark, folder))


NORMAL_DAY = ("(dayofyear({c}) - CASE WHEN ((year({c}) % 4 = 0 AND year({c}) % 100 <> 0) OR year({c}) % 400 = 0) "
              "AND dayofyear({c}) >= 60 THEN 1 ELSE 0 END)")


@query("no_flow_indices", "series_id:s MAN:f6 CVAN:f6 MAMD:f6 tau0:s tau0_sd:f3 tau0_r:f8 tauE:s",
       sql.with_(sql.NATION, *SPELLS, YEARS, f"""ang AS (SELECT *, {NORMAL_DAY.format(c='onset')} / 365.0 * 2 * pi() AS ao,
  {NORMAL_DAY.format(c='"end"')} / 365.0 * 2 * pi() AS ae FROM yr),
ag AS (SELECT series_id, avg(no_flow_days) AS man, stddev_samp(no_flow_days) AS sd, avg(longest_spell) AS mamd,
  avg(sin(ao)) AS so, avg(cos(ao)) AS co, avg(sin(ae)) AS se, avg(cos(ae)) AS ce FROM ang GROUP BY 1),
cc AS (SELECT *, sqrt(so * so + co * co) AS r, round_even((CASE WHEN atan2(so, co) < 0 THEN atan2(so, co) + 2 * pi() ELSE atan2(so, co) END)
  * 365.0 / (2 * pi()), 0) AS d0, round_even((CASE WHEN atan2(se, ce) < 0 THEN atan2(se, ce) + 2 * pi() ELSE atan2(se, ce) END)
  * 365.0 / (2 * pi()), 0) AS de FROM ag)""")
       + """SELECT series_id, man AS "MAN", CASE WHEN man <> 0 THEN sd / man END AS "CVAN", mamd AS "MAMD",
  strftime(DATE '1969-12-31' + CAST(d0 AS INTEGER), '-%m-%d') AS tau0,
  365.0 / (2 * pi()) * sqrt(greatest(-2.0 * ln(r), 0.0)) AS tau0_sd, r AS tau0_r,
  strftime(DATE '1969-12-31' + CAST(de AS INTEGER), '-%m-%d') AS "tauE" FROM cc""")
def no_flow_indices(spark, folder):
    """Mean and variability of no-flow days, longest spells, mean onset and termination."""
    return sp.no_flow_indices(series.nation_daily(spark, folder))


@query("no_flow_years", "series_id:s no_flow_years:f6",
       sql.with_(sql.NATION, *SPELLS, YEARS)
       + "SELECT series_id, count(*) FILTER (no_flow_days > 0) / count(*) AS no_flow_years FROM yr GROUP BY 1")
def no_flow_years(spark, folder):
    """Share of years with no-flow days."""
    return sp.no_flow_years(series.nation_daily(spark, folder))


@query("intermittent_series", "series_id:s spell_5:b spell_30:b total_30:b",
       sql.with_(sql.NATION, *SPELLS, YEARS)
       + """SELECT series_id, bool_or(longest_spell >= 5) AS spell_5, bool_or(longest_spell >= 30) AS spell_30,
  bool_or(no_flow_days >= 30) AS total_30 FROM yr GROUP BY 1""")
def intermittent_series(spark, folder):
    """Which series are intermittent."""
    days = series.nation_daily(spark, folder)
    return (sp.is_intermittent(days, ndays=5).withColumnRenamed("is_intermittent", "spell_5")
            .join(sp.is_intermittent(days, ndays=30).withColumnRenamed("is_intermittent", "spell_30"), "series_id")
            .join(sp.is_intermittent(days, ndays=30, consecutive=False)
                  .withColumnRenamed("is_intermittent", "total_30"), "series_id"))


@query("spell_table", "series_id:s time:d year:i state:s spell:i",
       sql.with_(sql.NATION, *SPELLS) + "SELECT series_id, time, y AS year, state, run + 1 AS spell FROM sp")
def spell_table(spark, folder):
    """State and spell of every day (permanence view)."""
    return sp.classify(series.nation_daily(spark, folder), THRESHOLD)


@query("spell_durations", "series_id:s spell:i state:s fun_spell:s value:i",
       sql.with_(sql.NATION, *SPELLS,
                 "d AS (SELECT series_id, run + 1 AS spell, state, count(*) AS value FROM sp GROUP BY ALL)",
                 """grid AS (SELECT series_id, state FROM (SELECT DISTINCT series_id FROM sp),
  (SELECT unnest(['no-flow', 'flow', 'no data']) AS state))""")
       + """SELECT *, 'duration' AS fun_spell FROM d UNION ALL SELECT series_id, NULL, state, 0, 'duration' FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.series_id = g.series_id AND d.state = g.state)""")
def spell_durations(spark, folder):
    """Length of every spell, with zero for a state that never occurs."""
    return sp.ires_metric(series.nation_daily(spark, folder), agg_spell=sp.duration())


@query("longest_spell_per_year", "series_id:s year:i state:s fun_spell:s fun_year:s value:i",
       sql.with_(sql.NATION, *SPELLS, """d AS (SELECT series_id, run, y AS year, state, count(*) AS n FROM sp GROUP BY ALL),
grid AS (SELECT series_id, year, state FROM (SELECT DISTINCT series_id, y AS year FROM sp),
  (SELECT unnest(['no-flow', 'flow', 'no data']) AS state))""")
       + """SELECT g.series_id, g.year, g.state, 'duration' AS fun_spell, f.f AS fun_year,
  CASE f.f WHEN 'max' THEN coalesce(max(n), 0) ELSE coalesce(sum(n), 0) END AS value
FROM grid g LEFT JOIN d ON d.series_id = g.series_id AND d.year = g.year AND d.state = g.state,
  (SELECT unnest(['max', 'sum']) AS f) f GROUP BY 1, 2, 3, 5""")
def longest_spell_per_year(spark, folder):
    """Hierarchical statistic: spell length, then its maximum and sum per year and state."""
    return sp.ires_metric(series.nation_daily(spark, folder), agg_spell=sp.duration(),
                          agg_year=sp.over_value("max", F.max) | sp.over_value("sum", F.sum))


@query("monthly_state_days", "series_id:s minor:i state:s fun_minor:s fun_state:s value:f6",
       sql.with_(sql.NATION, *SPELLS, """mn AS (SELECT series_id, m, y, state, count(*) AS n FROM sp GROUP BY ALL),
grid AS (SELECT a.series_id, m, y, state FROM (SELECT DISTINCT series_id, m FROM sp) a JOIN
  (SELECT DISTINCT series_id, y FROM sp) b USING (series_id), (SELECT unnest(['no-flow', 'flow', 'no data']) AS state))""",
                 """cell AS (SELECT g.*, coalesce(n, 0) AS n FROM grid g LEFT JOIN mn USING (series_id, m, y, state)),
yearly AS (SELECT series_id, y, state, max(n) AS v FROM cell GROUP BY 1, 2, 3)""")
       + """SELECT series_id, NULL AS minor, state, 'duration' AS fun_minor, 'mean' AS fun_state, avg(v) AS value
FROM yearly GROUP BY 1, 3""")
def monthly_state_days(spark, folder):
    """Days per month and state, the largest month of each year, averaged over the years."""
    table = sp.ires_metric(series.nation_daily(spark, folder), agg_minor=sp.duration(),
                           agg_year=sp.over_value("max", F.max), agg_total=sp.over_value("mean", F.avg))
    return table.withColumn("minor", F.lit(None).cast("int"))


@query("mean_onset_by_metric", "series_id:s state:s fun_spell:s fun_year:s fun_state:s value:f6",
       sql.with_(sql.NATION, *SPELLS, f"""ys AS (SELECT series_id, y, state, min(time) AS onset FROM sp GROUP BY 1, 2, 3),
ag AS (SELECT series_id, state, avg(sin({NORMAL_DAY.format(c='onset')} / 365.0 * 2 * pi())) AS s,
  avg(cos({NORMAL_DAY.format(c='onset')} / 365.0 * 2 * pi())) AS c FROM ys GROUP BY 1, 2),
grid AS (SELECT series_id, state FROM (SELECT DISTINCT series_id FROM sp), (SELECT unnest(['no-flow', 'flow', 'no data']) AS state))""")
       + """SELECT g.series_id, g.state, 'onset' AS fun_spell, 'first' AS fun_year, 'r' AS fun_state, sqrt(s * s + c * c) AS value
FROM grid g LEFT JOIN ag USING (series_id, state)""")
def mean_onset_by_metric(spark, folder):
    """Concentration of the yearly onset of each state, through the hierarchical statistic."""
    onset = {"onset": sp.AggFun(lambda: F.min("time"))}
    concentration = {"r": sp.AggFun(lambda: sp.circular(day_of_normal_year(F.col("value")))["abs"])}
    return sp.ires_metric(series.nation_daily(spark, folder), agg_spell=onset, agg_year=sp.first_value(),
                          agg_total=concentration)


def _allocated(rule: str, level: str = "year"):
    def build(spark, folder):
        days = sp.classify(series.nation_daily(spark, folder), THRESHOLD)
        days = sp.allocate_spell(days, {level: rule})
        return days.groupBy("series_id", level, "spell", "state").agg(F.count(F.lit(1)).alias("days"))

    build.__doc__ = f"Days per spell and {level}, spells allocated by {rule}."
    return build


_ALLOCATED = "SELECT series_id, {year} AS year, run + 1 AS spell, state, count(*) AS days FROM sp2 GROUP BY ALL"
_RULES = {
    "cut": ("sp2 AS (SELECT *, y AS yy FROM sp)", "yy"),
    "onset": ("sp2 AS (SELECT *, arg_min(y, time) OVER (PARTITION BY series_id, run) AS yy FROM sp)", "yy"),
    "termination": ("sp2 AS (SELECT *, arg_max(y, time) OVER (PARTITION BY series_id, run) AS yy FROM sp)", "yy"),
    "majority": ("""cnt AS (SELECT series_id, run, y, count(*) AS c FROM sp GROUP BY ALL),
maj AS (SELECT series_id, run, arg_min(y, (-c, y)) AS yy FROM cnt GROUP BY 1, 2),
sp2 AS (SELECT sp.*, yy FROM sp JOIN maj USING (series_id, run))""", "yy"),
    "duplicate": ("""lv AS (SELECT DISTINCT series_id, run, y AS yy FROM sp),
sp2 AS (SELECT sp.*, yy FROM sp JOIN lv USING (series_id, run))""", "yy"),
}
for _rule, (_cte, _year) in _RULES.items():
    query(f"spells_{_rule}", "series_id:s year:i spell:i state:s days:i",
          sql.with_(sql.NATION, *SPELLS, _cte) + _ALLOCATED.format(year=_year))(_allocated(_rule))

# The same by calendar month and by run of one month.
_LEVELS = {"minor": "m", "group": "dense_rank() OVER (PARTITION BY series_id ORDER BY y, m)"}
_LEVEL_RULES = {
    "onset": "al AS (SELECT *, arg_min(v, time) OVER (PARTITION BY series_id, run) AS to_ FROM lv)",
    "termination": "al AS (SELECT *, arg_max(v, time) OVER (PARTITION BY series_id, run) AS to_ FROM lv)",
    "majority": """cnt AS (SELECT series_id, run, v, count(*) AS c, min(time) AS a FROM lv GROUP BY ALL),
maj AS (SELECT series_id, run, arg_min(v, (-c, a)) AS to_ FROM cnt GROUP BY 1, 2),
al AS (SELECT lv.*, to_ FROM lv JOIN maj USING (series_id, run))""",
    "duplicate": """dis AS (SELECT DISTINCT series_id, run, v AS to_ FROM lv),
al AS (SELECT lv.*, to_ FROM lv JOIN dis USING (series_id, run))""",
}
for _level, _value in _LEVELS.items():
    for _rule, _cte in _LEVEL_RULES.items():
        query(f"spells_{_level}_{_rule}", f"series_id:s {_level}:i spell:i state:s days:i",
              sql.with_(sql.NATION, *SPELLS, f"lv AS (SELECT *, {_value} AS v FROM sp)", _cte)
              + f'SELECT series_id, to_ AS "{_level}", run + 1 AS spell, state, count(*) AS days FROM al GROUP BY ALL')(_allocated(_rule, _level))

_GAPPED = """lv AS (SELECT *, dayofyear(time) AS "minor", dense_rank() OVER (PARTITION BY series_id ORDER BY year(time), month(time)) AS "group" FROM fullc),
ok AS (SELECT series_id, "{level}" FROM lv GROUP BY 1, 2 HAVING count(*) FILTER (value IS NULL) = 0)
"""


@query("complete_minor_periods", "series_id:s minor:i days:i",
       sql.with_(sql.STATUS, sql.full("status"), _GAPPED.format(level="minor")) + 'SELECT series_id, "minor", count(*) AS days FROM lv JOIN ok USING (series_id, "minor") GROUP BY 1, 2')
def complete_minor_periods(spark, folder):
    """Missing-value policy "drop_minor": days of the year that are known in every year."""
    days = add_missing_days(series.ship_daily_by_status(spark, folder))
    kept = sp.classify(days, THRESHOLD, minor=F.dayofyear("time"), na="drop_minor")
    return kept.groupBy("series_id", "minor").agg(F.count(F.lit(1)).alias("days"))


@query("complete_groups", "series_id:s group:i days:i",
       sql.with_(sql.STATUS, sql.full("status"), _GAPPED.format(level="group")) + 'SELECT series_id, "group", count(*) AS days FROM lv JOIN ok USING (series_id, "group") GROUP BY 1, 2')
def complete_groups(spark, folder):
    """Missing-value policy "drop_group": single months without a missing day."""
    days = add_missing_days(series.ship_daily_by_status(spark, folder))
    return sp.classify(days, THRESHOLD, na="drop_group").groupBy("series_id", "group").agg(F.count(F.lit(1)).alias("days"))
