import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ebbflow.operators import events as ev
from ebbflow.operators import thresholds as thr
from ebbflow.operators import windows as win
from ebbflow.operators.clean import add_missing_days


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_sequent_peak_fixture(series):
    days = series({"a": [5, 3, 2, 9, 4, 1, 8, 3.5]}).withColumn("threshold", F.lit(4.0))
    got = [r["storage"] for r in ev.with_storage(days).orderBy("time").collect()]
    assert got == [0, 1, 3, 0, 0, 3, 0, 0.5]


@pytest.mark.parametrize("seed", range(4))
def test_sequent_peak_equals_loop(series, seed):
    rng = random.Random(seed)
    values = [None if rng.random() < 0.05 else rng.randint(0, 20) for _ in range(400)]
    days = series({"a": values}).withColumn("threshold", F.lit(8.0))
    got = [r["storage"] for r in ev.with_storage(days).orderBy("time").collect()]
    expected, s = [], 0.0
    for v in values:
        s = 0.0 if v is None else max(0.0, s + 8.0 - v)
        expected.append(s)
    assert got == pytest.approx(expected)


def naive_events(values, threshold):
    out, current = [], None
    for i, v in enumerate(values):
        if v is not None and v < threshold:
            if current is None:
                current = [i, i, 0.0]
                out.append(current)
            current[1] = i
            current[2] += (threshold - v) * 86400
        else:
            current = None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_events_and_pooling_equal_loop(series, seed):
    rng = random.Random(100 + seed)
    values = [None if rng.random() < 0.03 else rng.randint(0, 10) for _ in range(300)]
    df = series({"a": values})
    plain = naive_events(values, 4)
    got = rows(ev.drought_events(df, 4.0), "first_day")
    assert [(r["duration"], r["volume"]) for r in got] == [(b - a + 1, v) for a, b, v in plain]
    pooled = []
    for a, b, v in plain:
        if pooled:
            between = values[pooled[-1][1] + 1:a]
            if len(between) < 3 and None not in between:
                pooled[-1][1], pooled[-1][2], pooled[-1][3] = b, pooled[-1][2] + v, pooled[-1][3] + 1
                continue
        pooled.append([a, b, v, 0])
    got = rows(ev.drought_events(df, 4.0, "inter-event", min_duration=3), "first_day")
    assert [(r["duration"], r["volume"], r["pooled"]) for r in got] == [
        (b - a + 1, v, n) for a, b, v, n in pooled]


def test_pooling_limit_is_strict(series):
    one_wet = [9, 1, 1, 9, 1, 9, 9]
    two_wet = [9, 1, 1, 9, 9, 1, 9]
    events = ev.drought_events(series({"one": one_wet, "two": two_wet}), 5.0, "inter-event", min_duration=2)
    assert {r["series_id"]: r["n"] for r in events.groupBy("series_id").agg(F.count("*").alias("n")).collect()
            } == {"one": 1, "two": 2}


def test_series_ending_in_a_drought_keeps_it_apart(series):
    events = ev.drought_events(series({"a": [1, 9, 9, 9, 9, 9, 9, 1]}), 5.0, "inter-event", min_duration=3)
    assert events.count() == 2


def test_missing_day_splits_an_event(series):
    got = rows(ev.drought_events(series({"a": [9, 1, None, 2, 9]}), 5.0), "first_day")
    assert [(r["event"], r["duration"], r["qmin"]) for r in got] == [(1, 1, 1.0), (2, 1, 2.0)]
    warned = ev.na_warnings(series({"a": [9, 1, None, 2, 9]}), 5.0)
    assert warned.count() == 2


def test_first_minimum_wins(series):
    got = rows(ev.drought_events(series({"a": [9, 2, 1, 1, 9]}), 5.0), "first_day")
    assert str(got[0]["tqmin"]) == "2001-01-03"


def test_volume_pooling_restarts_with_every_pool(series):
    # deficits 4, 4 | wet excess 1 joins, excess 30 does not
    flow = [9, 1, 6, 1, 20, 20, 1, 6, 1, 9]
    got = rows(ev.drought_events(series({"a": flow}), 5.0, "inter-event", min_duration=5, min_vol_ratio=0.5),
               "first_day")
    assert [(r["duration"], r["pooled"]) for r in got] == [(3, 1), (3, 1)]


def test_varying_threshold_joins_on_its_period(spark, series):
    days = series({"a": [5] * 40 + [7] * 20})
    monthly = thr.var_threshold(days, "month", F.max)
    assert ev.drought_events(days, monthly).count() == 1  # only the days of February below 7
    assert rows(ev.drought_events(days, thr.period_threshold("month", F.max)), "first_day") == rows(ev.drought_events(days, monthly), "first_day")
    with pytest.raises(ValueError):
        thr.period_threshold("day", F.max)


def test_synthetic_leap_day(spark, series):
    days = series({"a": [1.0] * 31 + list(range(28)) + [30.0] * 31})  # 2001: Feb 28 = 27, Mar 1 = 30
    table = thr.var_threshold(days, "day", F.avg).table
    leap = table.where("day = 229").first()
    assert leap["threshold"] == pytest.approx(28.5)
    appended = thr.append_threshold(days, thr.var_threshold(days, "day", F.avg))
    assert appended.count() == days.count()


def test_baseflow_fixture(series):
    blocks = [[5, 9, 9, 9, 9], [9, 9, 4, 9, 9], [9, 9, 9, 9, 5], [3, 9, 9, 9, 9], [9, 6, 9, 9, 9]]
    flow = [v for b in blocks for v in b]
    got = ev.baseflow(series({"a": flow})).orderBy("time").collect()
    # block minima 5, 4, 5, 3, 6: turning points where 0.9 * minimum is not above both neighbours
    assert [i for i, r in enumerate(got) if r["turning_point"]] == [7, 15]
    assert got[6]["baseflow"] is None and got[16]["baseflow"] is None
    assert got[11]["baseflow"] == pytest.approx(3.5)


def test_recession_slope(series):
    flow = [10.0 * 0.9 ** i for i in range(12)] + [50.0]
    row = ev.recession(series({"a": flow}), minlen=5).first()
    assert row["k"] == pytest.approx(0.9)
    assert row["alpha"] == pytest.approx(0.10536, abs=1e-4)


def test_recession_survives_missing_values(series):
    flow = [None] + [10.0 * 0.8 ** i for i in range(8)] + [None] + [10.0 * 0.8 ** i for i in range(8)]
    row = ev.recession(series({"a": flow}), minlen=5).first()
    assert row["k"] == pytest.approx(0.8) and row["pairs"] == 12


def test_peaks(series):
    flow = [1, 2, 5, 2, 1, 4, 4, 1, 0, 9, 9]
    df = series({"a": flow}).withColumn("peak", win.is_peak(F.col("value"), 2))
    assert [i for i, r in enumerate(df.orderBy("time").collect()) if r["peak"]] == [2, 6]


def test_gaps_with_whole_span(spark, series):
    a = series({"a": [1, 2]}, "2001-01-03").unionByName(series({"b": [5]}, "2001-01-06"))
    out = add_missing_days(a, whole_span=True, fill=0.0)
    got = {k: [r["value"] for r in out.where(F.col("series_id") == k).orderBy("time").collect()] for k in "ab"}
    assert got == {"a": [1, 2, 0, 0], "b": [0, 0, 0, 5]}


def test_event_at_the_end_of_an_irregular_series(spark):
    """Without a regular step the last day of the series is one day long and belongs to the event."""
    days = [1, 2, 4, 5, 6, 7]
    df = spark.createDataFrame([("a", f"2001-01-0{d}", 5.0 if d < 5 else 1.0) for d in days], "series_id string, time string, value double")
    got = ev.drought_events(df.withColumn("time", F.to_date("time")), 2.0).first()
    assert (str(got["last_day"]), got["duration"], got["volume"]) == ("2001-01-07", 3, 3 * 86400.0)


@pytest.mark.parametrize("flows", [
    [41, 42, 42, 42, 44, 44, 41, 43, 44, 40, 41, 44, 42, 42, 41, 42, 41, 40, 42, 41, 40, 44, 40, 44, 42, 40, 42],
    [43, 44, 41, 40, 44, 42, 44, 41, 40, 41, 42, 40, 41, 40, 40, 44, 42, 44, 42, 44, 43, 43]])
def test_mean_that_equals_the_threshold_is_no_drought(spark, tmp_path, flows):
    """The quantile is 41.4, as are some means of ten days; one unit in the last place more makes them droughts."""
    import duckdb

    from ebbflow.plans import load

    start = dt.date(2001, 1, 1)
    rows = [("A", dt.datetime.combine(start + dt.timedelta(days=i), dt.time()), float(v)) for i, v in enumerate(flows)]
    spark.createDataFrame(rows, "l_returnflag string, l_shipdate timestamp, l_quantity double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    query = load()["drought_events_smoothed"]
    got = sorted(tuple(r) for r in query.run(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == sorted(con.execute(query.check_sql()).fetchall())
    means = [sum(flows[i:i + 10]) / 10 for i in range(len(flows) - 9)]
    assert 41.4 in means and all(r[6] < 41.4 for r in got)
