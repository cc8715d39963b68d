"""Physical plans: shuffles, column pruning and pushed filters."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ebbflow.columns import by_key
from ebbflow.operators import events as ev
from ebbflow.operators import indices as idx
from ebbflow.sources import series as src

FOLDER = os.environ.get("EBBFLOW_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not available")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", plan(df)))


def q90():
    return F.percentile("value", F.lit(0.1)).over(by_key())


@pytest.mark.parametrize("pooling", ["none", "moving-average", "inter-event", "sequent-peak"])
def test_events_stay_in_one_placement(spark, pooling):
    """One shuffle sums the facts by series and day, one places the days by series."""
    assert shuffles(ev.drought_events(src.supplier_daily(spark, FOLDER), q90(), pooling)) == 2


def test_tasks_follow_the_number_of_facts(spark, monkeypatch):
    """Many series: the days of a task do not grow with the table, and no further shuffle is needed."""
    few = src.supplier_daily(spark, FOLDER).collect()
    monkeypatch.setattr(src, "FACTS_PER_TASK", 500, raising=False)
    days = src.supplier_daily(spark, FOLDER)
    parts = -(-src.table(spark, FOLDER, "lineitem").count() // 500)
    events = ev.drought_events(days, q90())
    assert parts > 4 and set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan(events))) == {str(parts)}
    assert shuffles(events) == 2 and shuffles(ev.baseflow(days)) == 2
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, few))


def test_seasonal_thresholds_need_one_scan(spark):
    from ebbflow.plans.droughts import drought_events_seasonal

    assert plan(drought_events_seasonal(spark, FOLDER)).count("FileScan") == 1


def test_days_are_placed_once(spark):
    days = src.supplier_daily(spark, FOLDER)
    assert shuffles(ev.baseflow(days)) == 2
    assert shuffles(ev.recession(days)) == 2
    assert shuffles(idx.mean_annual_minimum(days, (1, 10, 30))) == 2
    assert shuffles(idx.exceedance_frequency(days)) == 2


def test_scan_reads_only_needed_columns(spark):
    text = plan(idx.lfquantile(src.ship_daily(spark, FOLDER)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_returnflag", "l_shipdate", "l_quantity"}


def test_filter_on_a_series_reaches_the_scan(spark):
    events = ev.drought_events(src.ship_daily(spark, FOLDER), q90()).where("series_id = 'A'")
    assert "EqualTo(l_returnflag,A)" in plan(events)


def test_completing_levels_reads_nothing_again(spark):
    """Spell statistics by year read the tables as often as the daily series itself does."""
    from ebbflow.plans.no_flow import longest_spell_per_year

    daily, yearly = plan(src.nation_daily(spark, FOLDER)), plan(longest_spell_per_year(spark, FOLDER))
    assert yearly.count("FileScan") == daily.count("FileScan") <= 4
    assert yearly.count("Join") == daily.count("Join")
