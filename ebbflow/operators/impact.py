"""Drought indices against reported impacts: class densities and logistic regression."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.special import plogis
from ebbflow.operators.windows import exact_quantiles

# 97.5 % quantile of the normal distribution, exact and as rounded in partial-effect plots.
Z_975 = 1.959963984540054
Z_ROUNDED = 1.96
CHI2_95 = 3.841458820694124


def index_with_impacts(index: DataFrame, impacts: DataFrame, month: int = 7) -> DataFrame:
    """Index values of one month with the impacts of the year; years without a report are left out."""
    return index.where(F.col("month") == month).join(impacts, "year", "full").where(
        F.col("impact").isNotNull())


def spread_indices(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per index (explicit names: no extra pass to find them)."""
    return long.groupBy("year", "impact").pivot("index", list(names)).agg(F.first("index_val", True))


def class_density(df: DataFrame, x: str, label: str, points: int = 64, lower: float | None = None,
                  upper: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Kernel density of each class along the index and its share of the stacked densities.

    Every density integrates to one, as in a filled density plot; the bandwidth is the rule of thumb
    ``0.9 min(sd, IQR / 1.34) n^-0.2``.

    The kernel of every row is summed at every grid point.  Equal values are counted first, ahead of the shuffle; each distinct
    value then meets the few rows of class statistics and the grid, an ``explode`` whose kernels are summed
    before anything is shuffled again.
    """
    groups = list(by)
    known = df.where(F.col(x).isNotNull()).select(*groups, label, F.col(x).cast("double").alias("_x"))
    stats = known.groupBy(*groups, label).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    span = stats.groupBy(*groups).agg(F.min("_lo").alias("_from"), F.max("_hi").alias("_to"))
    quartiles = exact_quantiles(known, [*groups, label], "_x", (0.25, 0.75), ("_q1", "_q3")).drop("n")
    stats = stats.join(quartiles, [*groups, label])
    spread = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
    stats = stats.withColumn("_h", 0.9 * F.when(spread > 0, spread).when(F.col("_sd") > 0, F.col("_sd"))
                             .otherwise(1.0) * F.pow(F.col("_n"), F.lit(-0.2)))

    def with_span(rows: DataFrame) -> DataFrame:
        if groups:
            return rows.join(span, groups)
        return rows.withColumn("_span", span.select(F.struct("_from", "_to")).scalar()).select("*", "_span.*").drop("_span")

    counts = known.groupBy(*groups, label, "_x").agg(F.count(F.lit(1)).alias("_c"))
    counts = with_span(counts.join(stats.select(*groups, label, "_n", "_h"), [*groups, label]))
    first = F.lit(float(lower)) if lower is not None else F.col("_from")
    last = F.lit(float(upper)) if upper is not None else F.col("_to")
    grid = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = first + (last - first) * F.col("i") / (points - 1)
    u = (at - F.col("_x")) / F.col("_h")
    kernel = F.col("_c") * F.exp(-0.5 * u * u) / (F.col("_h") * F.col("_n") * math.sqrt(2 * math.pi))
    sums = grid.groupBy(*groups, "i", label).agg(F.max(at).alias("x"), F.sum(kernel).alias("density"))
    total = sums.groupBy(*groups, "i").agg(F.sum("density").alias("_all"))
    return sums.join(total, [*groups, "i"]).select(
        *groups, "i", "x", label, "density", F.when(F.col("_all") > 0, F.col("density") / F.col("_all")).alias("share"))


def features(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="skip").transform(df)


def fit_logistic(df: DataFrame, y: str, xs: Sequence[str], offset: str | None = None
                 ) -> GeneralizedLinearRegressionModel:
    """Logistic regression by iteratively reweighted least squares over the distributed rows."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                      labelCol="_label", maxIter=50, tol=1e-10)
    if offset:
        glm = glm.setOffsetCol(offset)
    rows = features(df.withColumn("_label", F.col(y).cast("double")), xs)
    model = glm.fit(rows)
    if model.summary.numIterations >= glm.getMaxIter():
        warnings.warn(f"the logistic regression did not settle in {glm.getMaxIter()} rounds; the classes may be separable", stacklevel=2)
    return model


def logistic_table(df: DataFrame, y: str, xs: Sequence[str], level: float = 0.95) -> DataFrame:
    """Coefficients with standard error, z, p and Wald interval, deviance and AIC."""
    model = fit_logistic(df, y, xs)
    s = model.summary
    estimates = [model.intercept, *[float(v) for v in model.coefficients]]
    # the summary lists the predictors first and the intercept last
    errors = [s.coefficientStandardErrors[-1], *s.coefficientStandardErrors[:-1]]
    pvalues = [s.pValues[-1], *s.pValues[:-1]]
    rows = [(t, float(b), float(e), float(b / e), float(p), float(b - Z_975 * e), float(b + Z_975 * e),
             float(s.nullDeviance), float(s.deviance), float(s.aic))
            for t, b, e, p in zip(("(intercept)", *xs), estimates, errors, pvalues, strict=True)]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, se double, z double, p_value double, lower double, "
              "upper double, null_deviance double, deviance double, aic double")


def profile_interval(df: DataFrame, y: str, x: str, rounds: int = 30) -> tuple[float, float]:
    """Profile-likelihood interval of the slope of ``x``.

    At a limit the deviance has risen by the 95 % chi-square value while the intercept is at its best.
    These two equations are solved by Newton's method (Venzon and Moolgavkar 1988) for both limits
    together: each step is one aggregation over the rows.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    model = fit_logistic(df, y, [x])
    best, a0, b0 = model.summary.deviance, float(model.intercept), float(model.coefficients[0])
    error = float(model.summary.coefficientStandardErrors[0])

    def sums(points: list[tuple[float, float]]):
        aggs = []
        for i, (a, b) in enumerate(points):
            eta = F.lit(a) + F.lit(b) * F.col("x")
            p = plogis(eta)
            # log(1 + exp(eta)) without overflow
            soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
            aggs += [F.sum(F.col("y") - p).alias(f"ga{i}"), F.sum((F.col("y") - p) * F.col("x")).alias(f"gb{i}"),
                     F.sum(p * (1 - p)).alias(f"haa{i}"), F.sum(p * (1 - p) * F.col("x")).alias(f"hab{i}"),
                     F.sum(2 * (soft - F.col("y") * eta)).alias(f"d{i}")]
        return rows.agg(*aggs).first()

    start = sums([(a0, b0)])
    tilt = start["hab0"] / start["haa0"]
    points = [(a0 - tilt * side * Z_975 * error, b0 + side * Z_975 * error) for side in (-1.0, 1.0)]
    for _ in range(rounds):
        r = sums(points)
        moved, new = 0.0, []
        for i, (a, b) in enumerate(points):
            # unknown step (da, db): score of the intercept to 0, deviance to its target
            m = [[-r[f"haa{i}"], -r[f"hab{i}"]], [-2 * r[f"ga{i}"], -2 * r[f"gb{i}"]]]
            v = [-r[f"ga{i}"], best + CHI2_95 - r[f"d{i}"]]
            det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
            da = (v[0] * m[1][1] - m[0][1] * v[1]) / det
            db = (m[0][0] * v[1] - m[1][0] * v[0]) / det
            shrink = min(1.0, error / max(abs(db), 1e-300))
            new.append((a + shrink * da, b + shrink * db))
            moved = max(moved, abs(shrink * db) / error)
        points = new
        if moved < 1e-8:
            break
    else:
        warnings.warn(f"the profile interval did not settle in {rounds} rounds", stacklevel=2)
    return points[0][1], points[1][1]


def _link_band(df: DataFrame, model: GeneralizedLinearRegressionModel, train: DataFrame,
               xs: Sequence[str], z: float) -> DataFrame:
    """Linear predictor with its standard error and the probability with a band of ``z`` errors.

    The covariance is the inverse of the weighted cross products at the fit: one aggregation.
    """
    import numpy as np

    names = list(xs)
    p = len(names) + 1
    beta = [model.intercept, *[float(v) for v in model.coefficients]]

    def design(columns) -> list[Column]:
        return [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]

    x = design(names)
    eta = sum((F.lit(b) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(beta[0]))
    mu = plogis(eta)
    row = train.dropna(subset=names).agg(*[F.sum(mu * (1 - mu) * x[i] * x[j]).alias(f"g{i}_{j}")
                                           for i in range(p) for j in range(i, p)]).first()
    information = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    covariance = np.linalg.inv(information)
    variance = sum((F.lit(float(covariance[i, j])) * x[i] * x[j]
                    for i in range(p) for j in range(p) if (i, j) != (0, 0)),
                   F.lit(float(covariance[0, 0])))
    out = df.withColumns({"link": eta, "se_link": F.sqrt(variance)})
    return out.withColumns({"predict": plogis(F.col("link")),
                            "predict_lower": plogis(F.col("link") - z * F.col("se_link")),
                            "predict_upper": plogis(F.col("link") + z * F.col("se_link"))})


def predict_likelihood(df: DataFrame, train: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Impact likelihood with a 95 % band computed in logit space."""
    return _link_band(df, fit_logistic(train, y, xs), train, xs, Z_975)


def partial_effect(train: DataFrame, y: str, xs: Sequence[str], vary: str, points: int = 100) -> DataFrame:
    """Likelihood along one predictor, the others at zero, over its range widened by one bin."""
    model = fit_logistic(train, y, xs)
    span = train.where(F.col(vary).isNotNull()).agg(
        F.min(vary).cast("double").alias("lo"), F.max(vary).cast("double").alias("hi"),
        F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / (F.ceil(F.log2("n")) + 1)
    grid = span.withColumn("w", width).select("lo", "hi", "w", F.explode(
        F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    start, length = F.col("lo") - F.col("w"), F.col("hi") - F.col("lo") + 2 * F.col("w")
    grid = grid.select("i", (start + length * F.col("i") / (points - 1)).alias(vary),
                       *[F.lit(0.0).alias(c) for c in xs if c != vary])
    return _link_band(grid, model, train, xs, Z_ROUNDED)
