import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ebbflow.operators import clean
from ebbflow.operators import windows as win


def values(df):
    return [r["value"] for r in df.orderBy("series_id", "time").collect()]


@pytest.mark.parametrize("limit, expected", [(2, [1, 2, 3, 4]), (1, [1, None, None, 4]), (None, [1, 2, 3, 4])])
def test_interpolation(series, limit, expected):
    assert values(win.fill_gaps(series({"a": [1, None, None, 4]}), limit)) == expected


def test_interpolation_at_the_ends(series):
    assert values(win.fill_gaps(series({"a": [None, 3, None, 5, None, None]}), 1)) == [3, 3, 4, 5, None, None]


def test_interpolation_of_an_empty_series(series):
    assert values(win.fill_gaps(series({"a": [None, None]}))) == [None, None]


def test_sanitize(spark):
    d = [dt.date(2001, 1, i) for i in range(1, 10)]
    raw = [(1, d[0], 1.0), (2, d[1], -5.0), (3, d[1], 7.0), (4, d[0], 1.0), (5, None, 3.0),
           (6, d[4], math.nan), (7, d[6], 0.0), (8, d[5], 4.0)]
    df = spark.createDataFrame([("x", *r) for r in raw], "series_id string, n long, time date, value double")
    result = clean.sanitize_ts(df, "n", force_positive=True, approx_missing=1)
    assert values(result.series) == [1, None, None, None, None, 4, 0]
    log = {r["what"]: r["n"] for r in result.log.collect()}
    assert log == {"no value": 1, "negative": 1, "zero": 1,
                   "undated": 1, "identical rows": 2,
                   "day repeated": 2, "out of order": 1,
                   "days absent": 2}


def test_sanitize_keeping_duplicates(spark):
    d = [dt.date(2001, 1, i) for i in range(1, 5)]
    raw = [(0, d[2], 1.0), (1, d[0], 2.0), ((1 << 20) + 1, d[0], 3.0), ((1 << 20) + 2, d[1], 1.0),
           ((1 << 21) + 5, d[0], 9.0)]
    df = spark.createDataFrame([("x", *r) for r in raw], "series_id string, n long, time date, value double")
    result = clean.sanitize_ts(df, "n", remove_duplicates=False)
    log = {r["what"]: r["n"] for r in result.log.collect()}
    assert log["out of order"] == 2
    assert log["day repeated"] == 3
    assert result.series.count() == 5


def test_runs_treat_null_as_a_value(series):
    df = win.with_run_id(series({"a": [1, 1, None, None, 1]}), F.col("value"))
    assert [r["run"] for r in df.orderBy("time").collect()] == [0, 0, 1, 1, 2]


def test_moving_average_sides(series):
    df = series({"a": [1, 2, 3, 4, 5, 6]})
    got = df.select("time", *[win.moving_average(F.col("value"), 4, s).alias(s)
                              for s in ("past", "center", "future")]).orderBy("time").collect()
    assert [r["past"] for r in got] == [None, None, None, 2.5, 3.5, 4.5]
    assert [r["center"] for r in got] == [None, 2.5, 3.5, 4.5, None, None]  # leans to the future
    assert [r["future"] for r in got] == [2.5, 3.5, 4.5, None, None, None]


def test_moving_average_of_missing_values(series):
    df = series({"a": [1, None, 3, 4]})
    got = df.select("time", win.moving_average(F.col("value"), 2).alias("m")).orderBy("time").collect()
    assert [r["m"] for r in got] == [None, None, None, 3.5]


def test_first_and_last_year_only(spark, series):
    days = series({"a": [1.0] * 5}, "2000-12-27").unionByName(series({"a": [2.0] * 100}, "2001-03-01")) \
        .unionByName(series({"a": [3.0] * 365}, "2002-01-01"))
    kept = clean.remove_incomplete_first_last(days)
    assert {r["y"] for r in kept.select(F.year("time").alias("y")).distinct().collect()} == {2001, 2002}


def test_two_year_series_can_lose_both(series):
    assert clean.remove_incomplete_first_last(series({"a": [1.0] * 20}, "2000-12-22")).count() == 0


def test_coverage_counts_values_not_rows(series):
    row = clean.coverage_yearly(series({"a": [1, None, 3]})).first()
    assert (row["days_with_data"], row["days_missing"]) == (2, 363)


def test_unknown_policy(series):
    with pytest.raises(ValueError):
        clean.treat_missing_values(series({"a": [1]}), "drop_week")


def test_findings_of_awkward_rows(spark):
    """Missing, infinite, negative, zero, undated, repeated and unordered rows, and two gaps."""
    rows = [("a", 5, 1.0, 1), ("a", 1, 2.0, 2), ("a", 1, 2.0, 3), ("a", 1, 3.0, 4), ("a", 2, None, 5), ("a", 2, float("nan"), 6), ("a", 9, -1.0, 7), ("a", 9, 0.0, 8), ("a", None, 4.0, 9),
            ("a", None, 4.0, 10), ("a", 10, float("inf"), 11), (None, 1, 1.0, 12), (None, 3, 1.0, 13)]
    day = lambda n: None if n is None else dt.date(2001, 1, n)
    df = spark.createDataFrame([(k, day(d), v, o, "x") for k, d, v, o in rows], "series_id string, time date, value double, line long, what string")
    got = clean.sanitize_findings(df, "line").collect()
    seen = sorted((str(r["series_id"]), r["step"], r["gap"] or 0, r["first_day"].day if r["first_day"] else 0, r["last_day"].day if r["last_day"] else 0, r["n"]) for r in got)
    assert seen == sorted([
        ("a", 1, 0, 2, 2, 1), ("a", 1, 0, 2, 2, 1), ("a", 1, 0, 10, 10, 1), ("a", 2, 0, 9, 9, 1), ("a", 3, 0, 9, 9, 1), ("a", 4, 0, 0, 0, 2), ("a", 5, 0, 1, 1, 2),
        ("a", 6, 0, 1, 1, 2), ("a", 6, 0, 1, 1, 1), ("a", 6, 0, 2, 2, 1), ("a", 6, 0, 2, 2, 1), ("a", 6, 0, 9, 9, 1), ("a", 6, 0, 9, 9, 1), ("a", 7, 0, 1, 1, 1),
        ("a", 8, 1, 3, 4, 2), ("a", 8, 2, 6, 8, 3), ("None", 8, 1, 2, 2, 1)])
    assert clean.sanitize_findings(df.limit(0), "line").collect() == []
