"""Merge counting and selected slopes against all pairs, and on a series too long for them."""

import resource
import time

import numpy as np
import pytest

from ebbflow.operators import events as ev
from ebbflow.operators import trend as tr
from ebbflow.operators.orderings import Slopes, inversions, inverted_pairs, kendall_s


def pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    return y[j] - y[i], x[j] - x[i]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 301, 333])
def test_inversions(n):
    rng = np.random.default_rng(n)
    y = rng.integers(0, max(2, n // 3), n)
    rise = pairs(np.arange(n), y)[0]
    assert inversions(y) == (rise < 0).sum() and kendall_s(y.astype(float)) == np.sign(rise).sum()
    order = rng.permutation(n)
    a, b = inverted_pairs(order) if n > 1 else (order[:0], order[:0])
    assert sorted(zip(a.tolist(), b.tolist())) == sorted((order[i], order[j]) for i in range(n) for j in range(i + 1, n) if order[j] < order[i])


def series(kind, n):
    rng = np.random.default_rng(n)
    x = np.sort(rng.choice(4 * n, n, replace=False)).astype(float) + 1900
    return x, {"noise": rng.normal(0, 1, n) + 0.001 * x, "ties": rng.integers(0, 4, n).astype(float), "flat": np.full(n, 3.5), "line": 2 * x - 7,
               "mostly zero": np.where(rng.random(n) < 0.1, rng.exponential(1, n), 0.0), "large": 1e9 + rng.normal(0, 1e-3, n), "steps": np.floor(np.arange(n) / 50)}[kind]


@pytest.mark.parametrize("kind", ["noise", "ties", "flat", "line", "mostly zero", "large", "steps"])
@pytest.mark.parametrize("n", [12, 400])
def test_selected_slopes(kind, n):
    x, y = series(kind, n)
    rise, run = pairs(x, y)
    steep = np.sort(rise / run)
    chosen = Slopes(x, y)
    for k in {1, 2, len(steep) // 4, len(steep) // 2, len(steep) // 2 + 1, len(steep) - 1, len(steep)}:
        assert chosen.smallest(k) == pytest.approx(steep[k - 1], rel=1e-12, abs=1e-15), (kind, k)


def test_long_series_in_little_memory():
    """As many values as the longest known gauge has days: 1.9 billion pairs."""
    n = 61_498
    rng = np.random.default_rng(8)
    x, y = np.arange(n, dtype=float), rng.gamma(2, 30, n).round(1) + np.arange(n) * 1e-4
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    s, slope = kendall_s(y), Slopes(x, y).smallest(n * (n - 1) // 4)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert s > 0 and slope == pytest.approx(1e-4, rel=0.2) and grown < 100 and time.time() - start < 60


def test_long_and_short_series_agree(spark):
    """One series above the limit and one below, against all pairs."""
    rows = [(str(n), float(t), float(v)) for n in (40, 700) for t, v in zip(*series("noise", n))]
    df = spark.createDataFrame(rows, "series_id string, year double, value double")
    sen = {r["series_id"]: r for r in tr.theil_sen(df, "value").collect()}
    kendall = {r["series_id"]: r for r in tr.mann_kendall(df, "value").collect()}
    for n in (40, 700):
        rise, run = pairs(*series("noise", n)[::1])[0], pairs(*series("noise", n))[1]
        assert kendall[str(n)]["s"] == np.sign(rise).sum() and sen[str(n)]["slope"] == pytest.approx(np.median(rise / run), rel=1e-12)
        assert sen[str(n)]["slope_lower"] < sen[str(n)]["slope"] < sen[str(n)]["slope_upper"]


def test_volume_pooling_of_a_hundred_thousand_events(spark):
    """A linear scan: pools of two events, each closed by an excess above the limit."""
    n = 100_000
    day = "date_add(DATE'1000-01-01', CAST(id * 4 AS int))"
    events = spark.range(n).selectExpr("'a' AS series_id", f"{day} AS first_day", f"date_add({day}, 1) AS last_day", "1 AS dbt", "1.0 AS volume", "0.5 AS qmin", f"{day} AS tqmin",
                                       "true AS _near", "CASE WHEN id % 2 = 1 THEN 0.1 ELSE 5.0 END AS _wet")
    start = time.time()
    sizes = ev._pool_by_volume(events, 0.5, "series_id").groupBy("_pool").count().groupBy("count").count().collect()
    assert [tuple(r) for r in sizes] == [(2, n // 2)] and time.time() - start < 60
