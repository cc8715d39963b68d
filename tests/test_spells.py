import pytest
from pyspark.sql import functions as F

from ebbflow.operators import spells as sp


def days(series, spans, start):
    flow = [v for v, n in spans for _ in range(n)]
    return series({"a": flow}, start)


def test_rules(series):
    # a no-flow spell from Dec 22 to Jan 5 and flow around it
    df = days(series, [(1, 10), (0, 15), (1, 10)], "2000-12-12")
    classified = sp.classify(df)

    def years(rule):
        out = sp.allocate_spell(classified, {"year": rule}).where("state = 'no-flow'")
        return {r["year"]: r["n"] for r in out.groupBy("year").agg(F.count("*").alias("n")).collect()}

    assert years("cut") == {2000: 10, 2001: 5}
    assert years("onset") == {2000: 15}
    assert years("termination") == {2001: 15}
    assert years("majority") == {2000: 15}
    assert years("duplicate") == {2000: 15, 2001: 15}
    with pytest.raises(ValueError):
        sp.allocate_spell(classified, "unknown")


def test_onset_follows_time_for_cyclic_levels(series):
    df = days(series, [(1, 10), (0, 15), (1, 10)], "2000-12-12")
    out = sp.allocate_spell(sp.classify(df), {"minor": "onset"}).where("state = 'no-flow'")
    assert {r["minor"] for r in out.select("minor").distinct().collect()} == {12}


def test_metric_completes_states_with_defaults(series):
    df = days(series, [(1, 400)], "2001-01-01")
    out = sp.ires_metric(df, agg_spell=sp.duration(), agg_year=sp.over_value("max", F.max))
    got = {(r["year"], r["state"]): r["value"] for r in out.collect()}
    assert got == {(2001, "flow"): 365, (2002, "flow"): 35, (2001, "no-flow"): 0, (2002, "no-flow"): 0,
                   (2001, "no data"): 0, (2002, "no data"): 0}


def test_missing_flow_is_a_state(series):
    df = days(series, [(1, 3), (None, 2), (0, 4)], "2001-01-01")
    out = sp.ires_metric(df, agg_total=sp.duration())
    assert {r["state"]: r["value"] for r in out.collect()} == {"flow": 3, "no data": 2, "no-flow": 4}


def test_named_indices(series):
    year = [(1, 100), (0, 20), (1, 30), (0, 10), (1, 205)]
    dry = days(series, year + [(1, 365)], "2001-01-01")
    row = sp.no_flow_indices(dry).first()
    assert (row["MAN"], row["MAMD"]) == (15.0, 10.0)
    assert row["CVAN"] == pytest.approx(2 ** 0.5)
    assert (row["tau0"], row["tauE"]) == ("-04-11", "-04-30")
    assert row["tau0_r"] == pytest.approx(1.0)
    assert sp.no_flow_years(dry).first()["no_flow_years"] == 0.5
    assert sp.is_intermittent(dry, ndays=20).first()[1] is True
    assert sp.is_intermittent(dry, ndays=21).first()[1] is False
    assert sp.is_intermittent(dry, ndays=30, consecutive=False).first()[1] is True


def test_years_with_missing_days_are_dropped(series):
    df = days(series, [(0, 365), (None, 1), (0, 364)], "2001-01-01")
    assert [r["year"] for r in sp.FAN(df).collect()] == [2001]


def test_circular_mean_wraps(spark):
    df = spark.createDataFrame([(360.0,), (10.0,)], "d double")
    row = df.agg(sp.circular(F.col("d"))["mean"].alias("m")).first()
    assert row["m"] % 365 == pytest.approx(2.5)
