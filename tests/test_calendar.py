import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbflow.functions import calendar as cal


def one(spark, day, column):
    df = spark.createDataFrame([(dt.date.fromisoformat(day),)], "time date")
    return df.select(column(F.col("time")).alias("x")).first()["x"]


@pytest.mark.parametrize("day, expected", [("1990-08-31", 1989), ("1990-09-01", 1990)])
def test_water_year(spark, day, expected):
    assert one(spark, day, lambda t: cal.water_year(t, "-09-01")) == expected


def test_week_is_not_iso(spark):
    assert one(spark, "2021-01-01", lambda t: cal.group_ts(t, "week")) == 1
    assert one(spark, "2020-12-31", lambda t: cal.group_ts(t, "week")) == 53


def test_leap_day_is_no_origin():
    with pytest.raises(ValueError):
        cal.parse_origin("-02-29")
    with pytest.raises(ValueError):
        cal.parse_origin("09-01")


@pytest.mark.parametrize("origin", ["-01-01", "-02-01", "-03-01", "-09-01", "-12-31"])
def test_month_day_number_covers_all_slots(spark, origin):
    month, day = cal.parse_origin(origin)
    df = spark.sql("SELECT explode(sequence(date'2000-01-01', date'2000-12-31')) AS time")
    rows = df.select("time", cal.month_day_number(F.col("time"), origin).alias("n")).collect()
    assert sorted(r["n"] for r in rows) == list(range(1, 367))
    assert {r["n"] for r in rows if (r["time"].month, r["time"].day) == (month, day)} == {1}


def test_month_day_number_same_in_normal_years(spark):
    for day in ("02-28", "03-01", "12-31"):
        a = one(spark, f"2000-{day}", cal.month_day_number)
        assert a == one(spark, f"2001-{day}", cal.month_day_number)


def test_period_start_may_be_in_previous_year(spark):
    starts = {"summer": "-04-01", "winter": "-10-01"}
    assert one(spark, "2001-02-03", lambda t: cal.period_start(t, starts)) == dt.date(2000, 10, 1)
    assert one(spark, "2001-02-03", lambda t: cal.season(t, starts)) == "winter"
    assert one(spark, "2001-05-03", lambda t: cal.season(t, ["-04-01", "-10-01"])) == "-04-01"


def test_season_wraps(spark):
    inside = lambda t: cal.in_season(t, "-11-01", "-02-28")
    assert one(spark, "2001-12-24", inside) and one(spark, "2001-02-28", inside)
    assert not one(spark, "2001-03-01", inside)


def test_days_in_year(spark):
    df = spark.createDataFrame([(1999,), (2000,)], "y int")
    got = [r["d"] for r in df.select(cal.days_in_year(F.col("y"), "-09-01").alias("d")).collect()]
    assert got == [366, 365]


def test_day_of_normal_year(spark):
    assert one(spark, "2000-02-29", cal.day_of_normal_year) == 59
    assert one(spark, "2000-12-31", cal.day_of_normal_year) == 365
    assert one(spark, "2001-12-31", cal.day_of_normal_year) == 365
