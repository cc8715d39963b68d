"""Formulas with known answers and models against brute force on small data."""

import datetime as dt
import itertools
import math
import os
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbflow.functions import special as sf
from ebbflow.operators import frequency as fr
from ebbflow.operators import impact as im
from ebbflow.operators import indices as idx
from ebbflow.operators import areas as ar
from ebbflow.operators import regional as rg
from ebbflow.operators import skill as sk
from ebbflow.operators import trend as tr
from ebbflow.operators import windows as win
from ebbflow.sources import io


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


# ---- special functions -----------------------------------------------------------------------

def test_normal_distribution(spark):
    ps = [1e-12, 1e-6, 0.01, 0.07, 0.3, 0.5, 0.77, 0.975, 1 - 1e-6]
    rows = frame(spark, p=ps).withColumn("x", sf.qnorm(F.col("p"))).withColumn(
        "back", sf.pnorm(F.col("x"))).collect()
    for r in rows:
        assert r["x"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), rel=1e-9, abs=1e-12)
        assert r["back"] == pytest.approx(r["p"], rel=1e-8)
    assert frame(spark, p=[0.0, 1.0]).select(sf.qnorm(F.col("p")).alias("x")).dropna().count() == 0


def test_gamma(spark):
    xs = [0.1, 0.5, 1.0, 3.7, 25.0, 150.0]
    for r in frame(spark, x=xs).withColumn("l", sf.lgamma(F.col("x"))).collect():
        assert r["l"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-13)


def test_student_and_f(spark):
    # tabulated: t(0.975) for 1, 10 and 100 degrees of freedom; F(0.95; 2, 10)
    rows = frame(spark, d=[1.0, 10.0, 100.0]).withColumn("t", sf.qt(F.lit(0.975), F.col("d"))).withColumn(
        "p", sf.t_pvalue(F.col("t"), F.col("d"))).collect()
    assert [round(r["t"], 4) for r in rows] == [12.7062, 2.2281, 1.9840]
    assert [r["p"] for r in rows] == pytest.approx([0.05] * 3)
    f = frame(spark, f=[4.102821]).select(sf.f_pvalue(F.col("f"), F.lit(2.0), F.lit(10.0)).alias("p")).first()
    assert f["p"] == pytest.approx(0.05, abs=1e-6)


# ---- formulas --------------------------------------------------------------------------------

def test_weibull_golden(spark):
    fit = fr.fit_weibull(frame(spark, l1=[3.8930400], l2=[0.5560016]))
    row = fit.select("shape", "scale", *[
        fr.quantile_weibull(F.lit(1.0 / t), F.col("shape"), F.col("scale")).alias(f"q{t}") for t in (50, 100)]).first()
    assert (round(row["scale"], 6), round(row["shape"], 6)) == (4.266122, 4.497841)
    assert (round(row["q50"], 2), round(row["q100"], 2)) == (1.79, 1.53)


def test_pareto_golden(spark):
    fitted = frame(spark, location=[5.0], scale=[8.7770258], shape=[-0.2128228], rate=[100 / 49])
    got = [r["quantile"] for r in fr.return_levels(fitted).orderBy("return_period").collect()]
    assert [round(q, 3) for q in got] == [42.117, 91.670, 112.002]


def test_quantile_fixture(series):
    row = idx.lfquantile(series({"a": range(1, 11)}), (0.95, 0.9, 0.5)).first()
    assert [row["Q95"], row["Q90"], row["Q50"]] == pytest.approx([1.45, 1.9, 5.5])


def test_average_rank_fixture(series):
    got = idx.sgi(series({"a": [3, 3, 5, 1, None]}), ["series_id"]).orderBy("time").collect()
    assert [r["rank"] for r in got] == [2.5, 2.5, 4, 1, None]
    assert got[0]["sgi"] == pytest.approx(0.0) and got[4]["sgi"] is None


def test_scenario_change_golden(spark):
    events = frame(spark, s=["b", "i"], duration=[90.59375, 304.45], volume=[0.6709144, 3.58603])
    got = {r["characteristic"]: r["change_percent"] for r in sk.scenario_change(events, "s", "b", "i").collect()}
    assert got["mean_duration"] == pytest.approx(236.0607, abs=1e-3)
    assert got["mean_deficit"] == pytest.approx(434.4990, abs=1e-3)


def test_l_moments_of_ties(spark):
    x = [1.0, 2.0, 2.0, 2.0, 5.0, 7.0, 7.0, 9.0]
    row = fr.lmoments(frame(spark, x=x), "x", []).first()
    n = len(x)
    b = [sum(v * math.comb(i, r) / math.comb(n - 1, r) for i, v in enumerate(sorted(x))) / n for r in range(4)]
    l2 = 2 * b[1] - b[0]
    assert row["l1"] == pytest.approx(b[0]) and row["l2"] == pytest.approx(l2)
    assert row["t3"] == pytest.approx((6 * b[2] - 6 * b[1] + b[0]) / l2)
    assert row["t4"] == pytest.approx((20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]) / l2)


def test_brier(spark):
    pairs = frame(spark, event=[1, 0, 0, 0], probability=[0.9, 0.1, 0.2, 0.0])
    row = sk.brier_skill(pairs).first()
    assert row["brier"] == pytest.approx((0.01 + 0.01 + 0.04) / 4)
    assert row["skill"] == pytest.approx(1 - row["brier"] / row["brier_benchmark"])


# ---- ranks and quantiles of hot groups -------------------------------------------------------

def test_ranks_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.4, "hot", rng.integers(0, 30, 4000).astype(str)),
                        "v": np.round(rng.lognormal(0, 2, 4000), 1)})
    pdf.loc[rng.random(4000) < 0.35, "v"] = 7.0  # one value holds a third of the rows
    ranked = win.ranked_values(spark.createDataFrame(pdf), ["k"], "v").toPandas()
    pdf["low"] = pdf.groupby("k")["v"].rank(method="min")
    pdf["avg"] = pdf.groupby("k")["v"].rank(method="average")
    both = pdf.drop_duplicates().merge(ranked, on=["k", "v"])
    assert len(both) == len(ranked)
    assert (both["low"] == both["rank_min"]).all() and (both["avg"] == both["rank_avg"]).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 999, p=[0.9, 0.1]), "v": rng.normal(size=999)})
    got = win.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", (0.05, 0.5, 0.9), ("a", "b", "c")).collect()
    for r in got:
        expected = np.quantile(pdf.loc[pdf["k"] == r["k"], "v"], (0.05, 0.5, 0.9))
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(expected))


# ---- trend and breaks ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def annual(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in ("a", "b", "c"):
        y = rng.normal(size=40) + np.where(np.arange(40) < 17, 0, 3 if k != "c" else 0)
        rows += [(k, 1960 + i, float(round(v, 1))) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, year int, value double")


def test_theil_sen_and_kendall(annual):
    pdf = annual.toPandas()
    sen = {r["series_id"]: r for r in tr.theil_sen(annual, "value").collect()}
    mk = {r["series_id"]: r for r in tr.mann_kendall(annual, "value").collect()}
    for k, g in pdf.groupby("series_id"):
        pairs = [(b, a) for a, b in itertools.combinations(g[["year", "value"]].to_numpy(), 2)]
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for b, a in pairs]
        assert sen[k]["slope"] == pytest.approx(np.median(slopes))
        assert sen[k]["slope_lower"] <= sen[k]["slope"] <= sen[k]["slope_upper"]
        assert mk[k]["s"] == sum(np.sign(b[1] - a[1]) for b, a in pairs)


def test_untied_variance(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(78)], "series_id string, year int, value double")
    row = tr.mann_kendall(df, "value").first()
    assert row["var_s"] == pytest.approx(53720.33, abs=0.01) and row["tau"] == pytest.approx(1.0)


@pytest.mark.parametrize("slope", [False, True])
def test_breaks_equal_brute_force(annual, slope):
    pdf = annual.toPandas()
    table = tr.breakpoints(annual, "value", slope=slope, max_breaks=2).toPandas()
    best = tr.best_breaks(tr.breakpoints(annual, "value", slope=slope)).toPandas().set_index("series_id")

    def rss(y, x):
        return np.sum((y - np.polyval(np.polyfit(x, y, int(slope)), x)) ** 2)

    h = 6
    for k, g in pdf.groupby("series_id"):
        g = g.sort_values("year")
        x, y = g["year"].to_numpy(float) - 1980, g["value"].to_numpy()
        n = len(y)
        two = min(rss(y[:i], x[:i]) + rss(y[i:j], x[i:j]) + rss(y[j:], x[j:])
                  for i in range(h, n - 2 * h + 1) for j in range(i + h, n - h + 1))
        mine = table[(table["series_id"] == k) & (table["m"] == 2)]["rss"].iloc[0]
        assert mine == pytest.approx(two)
    if not slope:
        assert list(best.loc["a", "breaks"]) == [1976] and best.loc["c", "m"] == 0


def test_break_date_distribution():
    for xi, phi in ((1.0, 1.0), (0.5, 2.0), (3.0, 0.7)):
        assert tr.break_date_cdf(-1e-12, xi, phi) == pytest.approx(tr.break_date_cdf(1e-12, xi, phi), abs=1e-5)
    # tabulated quantiles of the symmetric case
    assert tr.break_date_quantile(0.95, 1.0, 1.0) == pytest.approx(7.7, abs=0.05)
    assert tr.break_date_quantile(0.975, 1.0, 1.0) == pytest.approx(11.0, abs=0.05)
    assert tr.break_date_quantile(0.025, 1.0, 1.0) == pytest.approx(-11.0, abs=0.05)


def test_break_intervals(annual):
    best = tr.best_breaks(tr.breakpoints(annual, "value"))
    got = {r["series_id"]: r for r in tr.break_intervals(annual, best, "value").collect()}
    assert set(got) == {"a", "b"}
    for r in got.values():
        assert r["lower"] < r["break_after"] < r["upper"] and r["upper"] - r["lower"] < 10


def test_criterion_golden():
    # residual sum of squares and criterion of a published segmentation of 169 values
    bic = 169 * (math.log(2 * math.pi) + 1 + math.log(951054.5 / 169)) + 2 * 2 * math.log(169)
    assert round(bic) == 1960
    assert round((5448868 - 951054.5) / (951054.5 / 167), 2) == pytest.approx(789.79, abs=0.01)


def test_short_series_have_no_breaks(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 2.0)], "series_id string, year int, value double")
    assert tr.breakpoints(df, "value").count() == 0
    assert tr.sup_f(df, "value").count() == 0


# ---- components and regression ---------------------------------------------------------------

def test_pca(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = frame(spark, **{f"v{i}": m[:, i] for i in range(4)})
    load = tr.pca_loadings(df, ["v0", "v1", "v2", "v3"]).toPandas()
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(m.T)))[::-1]
    assert load.drop_duplicates("component")["eigenvalue"].to_list() == pytest.approx(list(values))
    scores = tr.pca_scores(df, ["v0", "v1", "v2", "v3"], tr.pca_loadings(df, ["v0", "v1", "v2", "v3"])).toPandas()
    assert scores.var().to_list() == pytest.approx(list(values))


def regression_data(n=200, p=4, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = 2 + x[:, 0] * 3 - x[:, 1] + rng.normal(size=n)
    return x, y


def test_regression(spark):
    x, y = regression_data()
    df = frame(spark, y=y, **{f"x{i}": x[:, i] for i in range(4)})
    got = rg.regression(df, "y", ["x0", "x1", "x2", "x3"]).toPandas()
    design = np.column_stack([np.ones(len(y)), x])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    assert got["estimate"].to_list() == pytest.approx(list(beta))
    s2 = rss[0] / (len(y) - 5)
    assert got["se"].to_list() == pytest.approx(list(np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)))
    cook = rg.cooks_distance(df, "y", ["x0", "x1", "x2", "x3"]).toPandas()
    assert cook["leverage"].sum() == pytest.approx(5)


def test_aliased_terms(spark):
    """A column that others determine, a constant and a column of zeros have no estimate and cost no degree of freedom."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=12)
    y = 1 + 2 * x + rng.normal(size=12)
    df = frame(spark, y=y, x=x, twice=2 * x + 3, one=[5.0] * 12, zero=[0.0] * 12)
    alone = rg.regression(df, "y", ["x"]).toPandas().set_index("term")
    got = rg.regression(df, "y", ["zero", "x", "one", "twice"]).toPandas().set_index("term")
    for column in ("estimate", "se", "t", "p_value", "aic", "sigma", "adj_r2"):
        assert got.loc[["(intercept)", "x"], column].to_list() == pytest.approx(alone[column].to_list())
        if column not in ("aic", "sigma", "adj_r2"):
            assert got.loc[["zero", "one", "twice"], column].isna().all()
    assert set(rg.stepwise(df, "y", ["x", "twice", "one"], ["x"]).toPandas()["term"]) == {"(intercept)", "x"}
    cooks = [rg.cooks_distance(df, "y", xs).toPandas()["cooks_d"].to_list() for xs in (["x"], ["x", "twice", "zero"])]
    assert cooks[0] == pytest.approx(cooks[1])


def test_large_means(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=200)
    y = x + rng.normal(size=200)
    df = frame(spark, x=x + 1e8, y=y + 1e8, c=[1e9] * 200)
    got = tr.pearson_matrix(df, ["x", "y", "c"]).toPandas().set_index(["index", "index2"])["pearson"]
    assert got["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7) and np.isnan(got["x", "c"])
    fit = rg.regression(df, "y", ["x"]).toPandas()["estimate"].to_list()
    assert fit[1] == pytest.approx(np.polyfit(x, y, 1)[0], abs=1e-6)
    load = tr.pca_loadings(df, ["x", "c", "y"]).toPandas()
    assert load["eigenvalue"].min() == 0 and not load["loading"].isna().any()
    assert (load[load["component"] < 3].query("variable == 'c'")["loading"] == 0).all()
    assert not tr.pca_scores(df, ["x", "c", "y"], tr.pca_loadings(df, ["x", "c", "y"])).toPandas().isna().any().any()


def test_break_date_quantiles_of_unequal_moments():
    """Against a simulation: two-sided random walk with drift, steeper and noisier on the right by ``xi``."""
    rng, step, reach, xi = np.random.default_rng(10), 0.05, 1200, 4.0
    at = []
    for _ in range(1500):
        left = np.cumsum(rng.normal(size=reach)) * np.sqrt(step) - 0.5 * step * np.arange(1, reach + 1)
        right = np.cumsum(rng.normal(size=reach)) * np.sqrt(step * xi) - 0.5 * xi * step * np.arange(1, reach + 1)
        i, j = left.argmax(), right.argmax()
        at.append(0.0 if max(left[i], right[j]) <= 0 else -step * (i + 1) if left[i] > right[j] else step * (j + 1))
    for p in (0.025, 0.975):
        assert tr.break_date_quantile(p, xi, xi) == pytest.approx(np.quantile(at, p), abs=1.0)


def test_stepwise(spark):
    x, y = regression_data()
    df = frame(spark, y=y, **{f"x{i}": x[:, i] for i in range(4)})
    terms = [r["term"] for r in rg.stepwise(df, "y", ["x0", "x1", "x2", "x3"], ["x3"]).collect()]
    assert {"x0", "x1"} <= set(terms)
    # no single change improves the result
    final = [t for t in terms if t != "(intercept)"]
    changes = rg.single_term_changes(df, "y", ["x0", "x1", "x2", "x3"], final).toPandas()
    assert changes["aic"].min() == pytest.approx(changes.loc[changes["change"] == "none", "aic"].iloc[0])


def test_robust_regression_ignores_outliers(spark):
    x, y = regression_data(300, 2)
    y[:90] += 100
    df = frame(spark, y=y, x0=x[:, 0], x1=x[:, 1])
    got = {r["term"]: r["estimate"] for r in rg.robust_regression(df, "y", ["x0", "x1"], subsets=60).collect()}
    assert got["(intercept)"] == pytest.approx(2, abs=0.3)
    assert got["x0"] == pytest.approx(3, abs=0.3) and got["x1"] == pytest.approx(-1, abs=0.3)


@pytest.mark.skipif("EBBFLOW_DESCRIPTORS" not in os.environ, reason="descriptor table not given")
def test_descriptor_goldens(spark):
    df = io.read_descriptors(spark, os.environ["EBBFLOW_DESCRIPTORS"])
    ids = ("_row", "DBMSNR", "HZBNR", "X_LB", "Y_LB", "q95s", "q95w", "q95", "A")
    scope = [c for c in df.columns if c not in ids]
    assert len(scope) == 28
    simple = rg.regression(df, "q95", ["P"]).toPandas()
    assert simple["estimate"].to_list() == pytest.approx([-2.06314576, 0.00528924], abs=1e-7)
    assert simple["r2"].iloc[0] == pytest.approx(0.25084606) and simple["aic"].iloc[0] == pytest.approx(-0.520430, abs=1e-5)
    assert round(simple["p_value"].iloc[1], 5) == 0.00482
    full = rg.single_term_changes(df, "q95", ["P", "Hm", "Sm", "Gq", "Lf"], ["P", "Hm", "Sm", "Gq", "Lf"]).toPandas()
    aic = {r["term"]: round(r["aic"], 3) for _, r in full.iterrows()}
    assert aic == {"": 1.981, "Hm": 0.207, "Sm": 0.431, "Lf": 0.472, "Gq": 3.044, "P": 4.662}
    first = rg.single_term_changes(df, "q95", scope, ["P"]).where("change = 'add'").orderBy("aic").first()
    assert first["term"] == "Lwa" and first["aic"] == pytest.approx(-7.099, abs=1e-3)
    both = rg.stepwise(df, "q95", scope, ["P"]).toPandas().set_index("term")
    expected = {"(intercept)": -0.371534, "Lwa": 2.640617, "Ggs": 0.046486, "Sm": 0.144978, "Gc": 0.015409}
    assert both["estimate"].to_dict() == pytest.approx(expected, abs=1e-6)
    assert both["aic"].iloc[0] == pytest.approx(-20.195783) and both["r2"].iloc[0] == pytest.approx(0.681667, abs=1e-6)
    chosen = [t for t in both.index if t != "(intercept)"]
    far = rg.cooks_distance(df, "q95", chosen, "HZBNR", "_row").where("cooks_d >= 1").collect()
    assert [(r["_row"], int(r["HZBNR"]), round(r["cooks_d"], 2)) for r in far] == [(12, 207985, 2.39)]
    again = rg.stepwise(df.where("_row <> 12"), "q95", scope, ["P"]).toPandas()
    assert set(again["term"]) == {"(intercept)", "Ggs", "Gc", "Sm", "H0"}
    assert again["aic"].iloc[0] == pytest.approx(-29.150168) and again["r2"].iloc[0] == pytest.approx(0.719240, abs=1e-6)


# ---- impacts ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def impacts(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=120)
    y = (rng.random(120) < 1 / (1 + np.exp(1.5 + 1.2 * x))).astype(int)
    return frame(spark, x=x, y=y), x, y


def loglik(a, b, x, y):
    eta = a + b * x
    return float(np.sum(y * eta - np.logaddexp(0, eta)))


def newton(x, y, fixed=None):
    a, b = 0.0, fixed or 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-a - b * x))
        w = p * (1 - p)
        if fixed is not None:
            a += np.sum(y - p) / np.sum(w)
            continue
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]])
        a, b = np.array([a, b]) + np.linalg.solve(h, [np.sum(y - p), np.sum((y - p) * x)])
    return a, b


def test_logistic(impacts):
    df, x, y = impacts
    a, b = newton(x, y)
    table = im.logistic_table(df, "y", ["x"]).toPandas()
    assert table["estimate"].to_list() == pytest.approx([a, b], rel=1e-5)
    assert table["deviance"].iloc[0] == pytest.approx(-2 * loglik(a, b, x, y))
    predicted = im.predict_likelihood(df, df, "y", ["x"]).toPandas()
    assert (predicted["predict_lower"] <= predicted["predict"]).all()
    assert (predicted["predict"] <= predicted["predict_upper"]).all()


def test_profile_interval(impacts):
    df, x, y = impacts
    a, b = newton(x, y)
    top = loglik(a, b, x, y)
    for limit in im.profile_interval(df, "y", "x"):
        a_limit, _ = newton(x, y, limit)
        assert 2 * (top - loglik(a_limit, limit, x, y)) == pytest.approx(3.841458820694124, abs=1e-4)


def test_index_with_impacts(spark):
    index = frame(spark, year=[2000, 2000, 2001, 2001], month=[7, 6, 7, 7], index=["a", "a", "a", "b"],
                  index_val=[1.0, 9.0, 2.0, 3.0])
    reported = frame(spark, year=[2000, 2001, 2002], impact=[True, False, True])
    joined = im.index_with_impacts(index, reported)
    assert joined.count() == 4
    wide = im.spread_indices(joined, ["a", "b"]).orderBy("year").collect()
    assert [(r["year"], r["a"], r["b"]) for r in wide] == [(2000, 1.0, None), (2001, 2.0, 3.0), (2002, None, None)]


def test_class_density_sums_every_kernel(spark):
    """Held against the plain sum over all rows: a narrow class beside far values shows any binning."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.normal(size=300) * 0.01, 3), [0.002] * 20, rng.normal(size=200), [40.0]])
    y = np.array([0] * 320 + [1] * 201)
    got = im.class_density(frame(spark, x=x, y=y), "x", "y", points=9, lower=-0.04, upper=0.04).toPandas()
    assert len(got) == 18
    for _, r in got.iterrows():
        v = x[y == r["y"]]
        h = 0.9 * min(v.std(ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.34) * len(v) ** -0.2
        exact = np.exp(-0.5 * ((r["x"] - v) / h) ** 2).sum() / (h * len(v) * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(exact, rel=1e-9)


# ---- areas -----------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [7, 5000])
def test_variogram_of_a_crowded_cell(spark, block):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.random((120, 2)) * 0.1, rng.random((60, 2))])
    z = rng.normal(size=180)
    got = rg.sample_variogram(frame(spark, x=xy[:, 0], y=xy[:, 1], z=z), 0.1, 0.3, block=block).toPandas()
    i, j = np.triu_indices(180, 1)
    h = np.hypot(*(xy[i] - xy[j]).T)
    g = 0.5 * (z[i] - z[j]) ** 2
    for _, r in got.iterrows():
        inside = (h >= 0.1 * r["bin"]) & (h < 0.1 * (r["bin"] + 1)) & (h < 0.3)
        assert r["n"] == inside.sum() and r["gamma"] == pytest.approx(g[inside].mean())


@pytest.mark.parametrize("block", [5, 2000])
def test_variogram_by_cells_counts_every_pair(spark, block):
    """Enough points for fine cells: same pairs, distances and differences as all pairs one by one."""
    rng = np.random.default_rng(6)
    p = np.vstack([rng.normal(size=(3000, 3)) * 0.125, rng.normal(size=(50, 3))])
    p[:200] = p[200:400]
    p[:, 2] += 1000
    got = rg.sample_variogram(frame(spark, x=p[:, 0], y=p[:, 1], z=p[:, 2]), 0.05, 0.25, block=block).toPandas().sort_values("bin")
    i, j = np.triu_indices(len(p), 1)
    h = np.sqrt(((p[i, :2] - p[j, :2]) ** 2).sum(1))
    inside = h < 0.25
    at, g = np.minimum((h[inside] / 0.05).astype(int), 4), 0.5 * (p[i, 2] - p[j, 2])[inside] ** 2
    n = np.bincount(at)
    assert got["n"].tolist() == n.tolist()
    assert got["distance"].to_numpy() == pytest.approx(np.bincount(at, h[inside]) / n, rel=1e-10)
    assert got["gamma"].to_numpy() == pytest.approx(np.bincount(at, g) / n, rel=1e-9)


def test_variogram_groups_do_not_follow_the_square(spark, monkeypatch):
    """Four times the points of a cell do not mean sixteen times the points that are sent to pairs of strips."""
    rows = []
    frames = type(spark.range(1).groupBy("id"))
    whole = frames.applyInPandas

    def counted(self, func, schema):
        rows.append(self._df.count())
        return whole(self, func, schema)

    monkeypatch.setattr(frames, "applyInPandas", counted)
    rng = np.random.default_rng(7)
    for size in (2000, 8000):
        p = rng.random((size, 3)) * 0.2
        rg.sample_variogram(frame(spark, x=p[:, 0], y=p[:, 1], z=p[:, 2]), 0.05, 0.25, block=20)
    assert rows[1] < 10 * rows[0]


def test_variogram_of_unknown_values(spark):
    """A point without a place has no pairs; one without a value spoils only the bins of its pairs."""
    x, y = [0.0, 1.5, 9.0, math.nan, math.inf, 9.2], [0.0] * 6
    rows = list(zip(x, y, [1.0, 3.0, math.nan, 1.0, 1.0, 1.0], strict=True))
    got = rg.sample_variogram(spark.createDataFrame(rows, "x double, y double, z double"), 1.0, 2.0).toPandas().set_index("bin")
    assert got["n"].to_dict() == {0: 1, 1: 1} and got["gamma"][1] == 2.0 and math.isnan(got["gamma"][0])


def test_variogram_of_equal_points(spark):
    x, z = [0.0] * 9 + [1.5], [1.0] * 9 + [3.0]
    got = rg.sample_variogram(frame(spark, x=x, y=[0.0] * 10, z=z), 1.0, 2.0, block=3).toPandas().set_index("bin")
    assert got["n"].to_dict() == {0: 36, 1: 9}
    assert got["gamma"].to_dict() == {0: 0.0, 1: 2.0}


def test_kriging(spark):
    rng = np.random.default_rng(6)
    ids = [f"a{i}" for i in range(12)]
    cells = [(a, float(rng.random()), float(rng.random()), 0.5) for a in ids for _ in range(2)]
    cells = spark.createDataFrame(cells, "area_id string, x double, y double, weight double")
    z = spark.createDataFrame([(a, float(i)) for i, a in enumerate(ids)], "area_id string, z double")
    exact = ar.top_kriging(cells, z, z, 0.0, 1.0, 0.5, radius=5.0).join(z, "area_id").toPandas()
    assert exact["pred"].to_list() == pytest.approx(exact["z"].to_list(), abs=1e-6)  # observed areas are honoured
    left_out = ar.top_kriging(cells, z, z, 0.0, 1.0, 0.5, radius=5.0, leave_one_out=True).toPandas()
    assert (left_out["neighbours"] == 11).all() and (left_out["variance"] > 0).all()
    c = cells.toPandas().groupby("area_id")
    pts = {a: g[["x", "y"]].to_numpy() for a, g in c}

    def mean_gamma(a, b):
        h = np.hypot(*(pts[a][:, None, :] - pts[b][None, :, :]).transpose(2, 0, 1))
        return np.mean(1 - np.exp(-h / 0.5))

    def gamma(a, b):
        return mean_gamma(a, b) - 0.5 * (mean_gamma(a, a) + mean_gamma(b, b)) if a != b else 0.0

    others = ids[1:]
    system = np.ones((12, 12))
    system[:11, :11] = [[gamma(a, b) for b in others] for a in others]
    system[11, 11] = 0
    w = np.linalg.solve(system, [*[gamma(a, ids[0]) for a in others], 1.0])
    mine = left_out.set_index("area_id").loc["a0", "pred"]
    assert mine == pytest.approx(sum(w[:11] * np.arange(1, 12)))


def test_whittaker(spark):
    y = np.sin(np.arange(50) / 5) + 2
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, md int, flow double")
    z = idx.whittaker(df, ["k"]).orderBy("md").toPandas()["smoothed"].to_numpy()
    d = np.diff(np.eye(50), 2, axis=0)
    assert np.allclose((np.eye(50) + 1600 * d.T @ d) @ z, y)
    line = spark.createDataFrame([("a", i, 1.0 + i) for i in range(30)], "k string, md int, flow double")
    smooth = idx.whittaker(line, ["k"]).toPandas()
    assert np.allclose(smooth["smoothed"], smooth["flow"])  # a straight line stays as it is


def test_extreme_year_tie_goes_to_the_earlier(spark):
    rows = [("a", dt.date(y, 1, d), float(d)) for y in (2001, 2002) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "series_id string, time date, value double")
    assert {r["state"]: r["year"] for r in idx.extreme_years(df).collect()} == {"wet": 2001, "dry": 2001}


def test_registered_breaks_are_not_capped(spark):
    """Series with three and five clear breaks, through the registered queries' own functions."""
    from unittest import mock

    from ebbflow.plans import trends

    steps = {"a": [0, 9, 0, 9], "b": [0, 9, 0, 9, 0, 9]}
    rows = [(k, 24_000 + 20 * s + i, float(level + (i * 7 % 5) / 10)) for k, levels in steps.items() for s, level in enumerate(levels) for i in range(20)]
    flows = spark.createDataFrame(rows, "series_id string, year int, value double")
    with mock.patch.object(trends, "monthly_flow", lambda *_: flows):
        best = {r.series_id: r.m for r in tr.best_breaks(trends.mean_breaks(spark, "")).collect()}
        counts = {(r.series_id, r.m) for r in trends.trend_breaks(spark, "").collect()}
        segments = {(r.series_id, r.segment) for r in trends.trend_break_segments(spark, "").select("series_id", "segment").distinct().collect()}
    assert best == {"a": 3, "b": 5} and counts == {(k, m) for k in "ab" for m in range(6)}
    assert {s for k, s in segments if k == "b"} == set(range(1, 7))
