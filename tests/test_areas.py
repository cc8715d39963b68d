"""Areas: nearest centres and kriging against brute force, and the variogram fit by back-calculation."""

import itertools

import numpy as np
import pytest

from ebbflow.operators import areas as ar
from ebbflow.session import settle


def frame(spark, names, xy):
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in zip(names, xy, strict=True)], "area_id string, px double, py double")


def brute(names, xy, targets, txy, k, others):
    out = []
    for t, p in zip(targets, txy, strict=True):
        near = sorted((float(np.sqrt((x[0] - p[0]) * (x[0] - p[0]) + (x[1] - p[1]) * (x[1] - p[1]))), n) for n, x in zip(names, xy, strict=True) if not (others and n == t))
        out += [(t, n, i + 1) for i, (_, n) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize(("k", "others"), [(1, False), (4, True), (100, True)])
def test_nearest_against_all(spark, k, others):
    """A crowd, a few far away, and a point on top of another: rings widen until the answer is certain."""
    rng = np.random.default_rng(k)
    xy = np.concatenate([rng.normal(0, 0.01, (60, 2)), rng.uniform(-50, 50, (15, 2)), [[1.0, 1.0], [1.0, 1.0]]])
    names = [f"a{i:02d}" for i in range(len(xy))]
    got = ar.nearest_areas(frame(spark, names, xy), frame(spark, names, xy), k, others)
    assert sorted((r["target"], r["area_id"], r["rank"]) for r in got.collect()) == brute(names, xy, names, xy, k, others)


def test_nearest_from_afar_and_from_nothing(spark):
    names, xy = ["a", "b", "c"], np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 3.0]])
    far = frame(spark, ["t", "u"], [(1000.0, -2000.0), (0.4, 0.0)])
    got = ar.nearest_areas(frame(spark, names, xy), far, 2)
    assert sorted((r["target"], r["area_id"], r["rank"]) for r in got.collect()) == brute(names, xy, ["t", "u"], [(1000.0, -2000.0), (0.4, 0.0)], 2, False)
    assert ar.nearest_areas(frame(spark, names, xy).limit(0), far, 2).collect() == []
    assert ar.nearest_areas(frame(spark, names, xy), far.limit(0), 2).collect() == []
    alone = frame(spark, ["x"], [(5.0, 5.0)])
    assert ar.nearest_areas(alone, alone, 3, others=True).collect() == []
    same = frame(spark, ["b", "a", "c"], [(5.0, 5.0)] * 3)
    assert [r["area_id"] for r in ar.nearest_areas(same, alone, 2).orderBy("rank").collect()] == ["a", "b"]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, j in itertools.product(range(6), range(5)):
        weights = rng.uniform(0.5, 2, 7)
        rows += [(f"{i}/{j}", float(i + rng.random()), float(j + rng.random()), float(w / weights.sum())) for w in weights]
    return spark.createDataFrame(rows, "area_id string, x double, y double, weight double").cache()


def gamma(h, nugget, sill, reach):
    return np.where(h == 0, 0.0, nugget + sill * (1 - np.exp(-h / reach)))


def areal(c, a, b, *model):
    def mean(p, q):
        h = np.hypot(p[0][:, None] - q[0], p[1][:, None] - q[1])
        return p[2] @ gamma(h, *model) @ q[2]

    p, q = (tuple(c[c["area_id"] == n][col].to_numpy() for col in ("x", "y", "weight")) for n in (a, b))
    return mean(p, q) - (mean(p, p) + mean(q, q)) / 2


def test_pairs_and_semivariances(cells):
    pairs = ar.area_pairs(cells, 2.0)
    at = {r["area_id"]: (r["px"], r["py"]) for r in ar.centres(cells).collect()}
    expected = {(a, b) for a, b in itertools.combinations(sorted(at), 2) if np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) < 2}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == expected
    c = cells.toPandas()
    for r in ar.areal_semivariances(cells, pairs.limit(20), 0.1, 1.0, 0.7).collect():
        assert r["gamma"] == pytest.approx(areal(c, r["a"], r["b"], 0.1, 1.0, 0.7), abs=1e-12)


def test_histograms_hold_all_distances(cells):
    found = ar.distance_histograms(cells, ar.area_pairs(cells, 2.0), 0.25).groupBy("a", "b").agg({"weight": "sum"}).collect()
    assert all(r["sum(weight)"] == pytest.approx(1.0) for r in found) and any(r["a"] == r["b"] for r in found)


def test_back_calculation_finds_the_model(spark, cells):
    """Values whose half squared differences are the regularised semivariances of a model have that model as the best."""
    truth = (0.05, 0.75, 1.5)
    pairs = ar.area_pairs(cells, 3.0).cache()
    gammas = ar.areal_semivariances(cells, pairs, *truth)
    sample = pairs.join(gammas, ["a", "b"]).selectExpr("CAST(floor(distance / 0.5) AS int) AS class", "gamma").groupBy("class").agg({"gamma": "avg", "*": "count"})
    sample = sample.withColumnsRenamed({"avg(gamma)": "gamma", "count(1)": "n"})
    terms = ar.class_terms(ar.distance_histograms(cells, pairs, 0.02), pairs, 0.5)
    errors = ar.variogram_errors(terms, sample, [0.0, 0.05, 0.1], [0.5, 0.75, 1.0], [0.75, 1.5, 3.0]).orderBy("error").collect()
    assert len(errors) == 27 and tuple(errors[0][c] for c in ("nugget", "sill", "reach")) == truth
    assert errors[0]["error"] < 1e-6 < errors[1]["error"]


def test_many_parameter_sets_do_not_touch_cells(spark, cells):
    pairs = ar.area_pairs(cells, 2.0)
    terms = settle(ar.class_terms(ar.distance_histograms(cells, pairs, 0.25), pairs, 0.5))
    sample = spark.createDataFrame([(k, 10, 0.1 * k + 0.1) for k in range(4)], "class int, n long, gamma double")
    errors = ar.variogram_errors(terms, sample, [0.0, 0.1], [k / 50 for k in range(1, 51)], [k / 50 for k in range(1, 101)])
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert terms.count() < 200 and errors.count() == 10_000 and "area_id" not in plan


def test_nothing_to_fit(cells):
    one = cells.where("area_id = '0/0'").select("area_id").distinct().selectExpr("area_id", "1.0 AS z")
    assert ar.back_calculated_variogram(cells, one, 2.0, 0.5, 0.1, [0.0], [1.0], [1.0]).collect() == []


def test_kriging_of_nearest(spark, cells):
    c = cells.toPandas()
    names = sorted(c["area_id"].unique())
    z = spark.createDataFrame([(n, float(i % 7)) for i, n in enumerate(names[:20])] + [(names[20], None)], "area_id string, z double")
    got = ar.top_kriging(cells, z, cells.select("area_id"), 0.1, 1.0, 0.7, k=5).toPandas()
    assert len(got) == 30 and (got["neighbours"] == 5).all()
    at = {r["area_id"]: (r["px"], r["py"]) for r in ar.centres(cells).collect()}
    for target in ("0/0", "5/4", names[20]):
        near = [n for _, n, _ in brute(names[:20], [at[n] for n in names[:20]], [target], [at[target]], 5, False)]
        system = np.ones((6, 6))
        system[:5, :5] = [[areal(c, a, b, 0.1, 1.0, 0.7) if a != b else 0.0 for b in near] for a in near]
        system[5, 5] = 0
        right = np.array([areal(c, a, target, 0.1, 1.0, 0.7) if a != target else 0.0 for a in near] + [1.0])
        weights = np.linalg.solve(system, right)
        row = got[got["area_id"] == target].iloc[0]
        assert row["pred"] == pytest.approx(weights[:5] @ [float(names.index(n) % 7) for n in near], abs=1e-9)
        assert row["variance"] == pytest.approx(max(weights @ right, 0), abs=1e-9)
    with pytest.raises(ValueError, match="neighbours"):
        ar.top_kriging(cells, z, z, 0.1, 1.0, 0.7)
    near = ar.top_kriging(cells, z, z, 0.1, 1.0, 0.7, k=5, radius=1.2, leave_one_out=True).toPandas()
    assert near["neighbours"].between(1, 5).all() and (near["neighbours"] < 5).any()
