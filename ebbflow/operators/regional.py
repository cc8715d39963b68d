"""Regional regression on catchment descriptors and interpolation between catchments.

A least squares problem with ``p`` predictors needs its rows only through the ``(p+2) x (p+2)`` matrix
of cross products.  That matrix comes from one distributed aggregation; selection of variables, tests
and refits then work on the matrix alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.columns import finite
from ebbflow.functions.special import t_two_sided
from ebbflow.operators.moments import gram
from ebbflow.session import settle

# Fixed value: a predictor whose part not explained by those before it is a smaller share of its sum of squares is aliased.
ALIASED = 1e-11
# Variograms: fine cells nearer than this are taken by points; so are strips with so few pairs to a cell of the grid that it does not pay.
NEAR_CELLS = 12
PAIRS_PER_CELL = 100


class Cross:
    """Count, means and centred cross products of predictors and, last, the response."""

    def __init__(self, n: float, mean: np.ndarray, s: np.ndarray):
        self.n, self.mean, self.s = n, mean, s

    @classmethod
    def raw(cls, g: np.ndarray) -> Cross:
        """From sums of products of ``(1, predictors, response)``."""
        mean = g[0, 1:] / g[0, 0]
        return cls(g[0, 0], mean, g[1:, 1:] - g[0, 0] * np.outer(mean, mean))


class Model:
    """Least squares on chosen predictors, in order; a predictor that those before it determine is left out.

    ``beta`` is NaN for such an aliased term (constant columns among them) and ``inverse`` 0; degrees of freedom and the
    selection criterion count the rank.
    """

    def __init__(self, cross: Cross, names: Sequence[str], chosen: Sequence[str]):
        self.n, self.chosen = int(cross.n), list(chosen)
        index = [names.index(c) for c in self.chosen]
        s, xy = cross.s[np.ix_(index, index)], cross.s[index, -1]
        self.tss = float(cross.s[-1, -1])
        kept: list[int] = []
        for j in range(len(index)):
            if s[j, j] <= 0:
                continue
            scale = np.sqrt(np.diag(s)[[*kept, j]])
            part = s[np.ix_([*kept, j], [*kept, j])] / np.outer(scale, scale)
            left = part[-1, -1] - part[-1, :-1] @ np.linalg.solve(part[:-1, :-1], part[:-1, -1]) if kept else 1.0
            if left > ALIASED:
                kept.append(j)
        scale = np.sqrt(np.diag(s)[kept])
        inner = np.linalg.inv(s[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale) if kept else np.zeros((0, 0))
        slope, mean = inner @ xy[kept], cross.mean[index][kept]
        self.rank, self.dof = len(kept) + 1, self.n - len(kept) - 1
        self.aliased = [c for j, c in enumerate(self.chosen) if j not in kept]
        self.rss = max(float(self.tss - slope @ xy[kept]), 0.0)
        self.beta, self.inverse = np.full(len(index) + 1, np.nan), np.zeros((len(index) + 1, len(index) + 1))
        at = [k + 1 for k in kept]
        self.beta[0], self.beta[at] = cross.mean[-1] - slope @ mean, slope
        self.inverse[np.ix_(at, at)] = inner
        self.inverse[0, at] = self.inverse[at, 0] = -inner @ mean
        self.inverse[0, 0] = 1 / max(cross.n, 1e-300) + mean @ inner @ mean

    @property
    def coefficients(self) -> np.ndarray:
        """``beta`` with 0 for aliased terms."""
        return np.nan_to_num(self.beta)

    @property
    def aic(self) -> float:
        """Selection criterion ``n ln(RSS / n) + 2 p``."""
        if self.rss <= 0:
            return -math.inf
        return self.n * math.log(self.rss / self.n) + 2 * self.rank


def _on_gram(row: DataFrame, names: Sequence[str], solve: Callable[[Cross], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``solve`` to the single cross-product row, still lazily."""
    size = len(names) + 1

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for n, m, g in zip(pdf["n"], pdf["m"], pdf["g"], strict=True):
                yield solve(Cross(float(n), np.asarray(m, float), np.asarray(g, float).reshape(size, size)))

    return row.mapInPandas(run, schema)


# ---- regression ------------------------------------------------------------------------------

COEFFICIENTS = ("term string, estimate double, se double, t double, p_value double, r2 double, "
                "adj_r2 double, sigma double, aic double, n long")


def _coefficient_rows(model: Model) -> pd.DataFrame:
    s2 = model.rss / model.dof if model.dof > 0 else math.nan
    se = np.where(np.isnan(model.beta), np.nan, np.sqrt(np.maximum(np.diag(model.inverse) * s2, 0.0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, model.beta / se, np.nan)
    p = t_two_sided(t, np.full(len(t), float(model.dof))) if model.dof > 0 else np.full(len(t), np.nan)
    r2 = 1 - model.rss / model.tss if model.tss > 0 else math.nan
    adj = 1 - (1 - r2) * (model.n - 1) / model.dof if model.dof > 0 else math.nan
    return pd.DataFrame({"term": ["(intercept)", *model.chosen], "estimate": model.beta, "se": se, "t": t,
                         "p_value": p, "r2": r2, "adj_r2": adj, "sigma": math.sqrt(s2) if s2 >= 0 else None,
                         "aic": model.aic, "n": model.n})


def regression(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Multiple least squares with a summary: one row per coefficient."""
    names = list(xs)
    return _on_gram(gram(df, [*names, y]), names,
                    lambda cross: _coefficient_rows(Model(cross, names, names)), COEFFICIENTS)


def single_term_changes(df: DataFrame, y: str, scope: Sequence[str], current: Sequence[str]) -> DataFrame:
    """RSS and AIC of the current model, of dropping each of its terms and of adding each other one."""
    names, start = list(scope), list(current)

    def solve(cross: Cross) -> pd.DataFrame:
        rows = [("none", "", start)]
        rows += [("drop", c, [x for x in start if x != c]) for c in start]
        rows += [("add", c, [*start, c]) for c in names if c not in start]
        models = [(kind, term, Model(cross, names, chosen)) for kind, term, chosen in rows]
        return pd.DataFrame([(k, t, m.rss, m.aic) for k, t, m in models],
                            columns=["change", "term", "rss", "aic"])

    return _on_gram(gram(df, [*names, y]), names, solve, "change string, term string, rss double, aic double")


def _select(cross: Cross, names: list[str], start: list[str]) -> Model:
    best = Model(cross, names, start)
    while True:
        moves = [[x for x in best.chosen if x != c] for c in best.chosen]
        moves += [[*best.chosen, c] for c in names if c not in best.chosen and len(best.chosen) < cross.n - 2]
        models = (Model(cross, names, m) for m in moves)
        trial = min((m for m in models if len(m.aliased) <= len(best.aliased)), key=lambda m: m.aic, default=None)
        if trial is None or trial.aic >= best.aic - 1e-9:
            return best
        best = trial


def stepwise(df: DataFrame, y: str, scope: Sequence[str], start: Sequence[str] = ()) -> DataFrame:
    """Stepwise selection in both directions by AIC; coefficient rows of the final model."""
    names, first = list(scope), list(start)
    return _on_gram(gram(df, [*names, y]), names,
                    lambda cross: _coefficient_rows(_select(cross, names, first)), COEFFICIENTS)


def cooks_distance(df: DataFrame, y: str, xs: Sequence[str], *keep: str) -> DataFrame:
    """Fitted value, residual, leverage and Cook's distance of every complete row.

    The small inverse matrix reaches the rows as a scalar subquery; the distances are expressions.
    """
    names = list(xs)
    p = len(names) + 1

    def solve(cross: Cross) -> pd.DataFrame:
        m = Model(cross, names, names)
        s2 = m.rss / m.dof if m.dof > 0 else None
        return pd.DataFrame({"beta": [m.coefficients.tolist()], "inverse": [m.inverse.ravel().tolist()], "s2": [s2], "rank": [m.rank]})

    fit = _on_gram(gram(df, [*names, y]), names, solve, "beta array<double>, inverse array<double>, s2 double, rank int")
    rows = df.dropna(subset=[*names, y]).withColumn("_m", fit.select(F.struct("*")).scalar())
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    fitted = _sum(F.col("_m.beta")[i] * x[i] for i in range(p))
    leverage = _sum(F.col("_m.inverse")[i * p + j] * x[i] * x[j] for i in range(p) for j in range(p))
    rows = rows.withColumns({"fitted": fitted, "leverage": leverage, "_s2": F.col("_m.s2"), "_rank": F.col("_m.rank")})
    rows = rows.withColumn("resid", F.col(y) - F.col("fitted"))
    h, e = F.col("leverage"), F.col("resid")
    return rows.withColumn("cooks_d", F.try_divide(e * e * h, F.col("_rank") * F.col("_s2") * (1 - h) * (1 - h))).select(
        *keep, *names, y, "fitted", "resid", "leverage", "cooks_d")


def _sum(terms: Iterable[Column]) -> Column:
    terms = list(terms)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def term_contributions(df: DataFrame, y: str, xs: Sequence[str], *keep: str) -> DataFrame:
    """Centred contribution of each term and its partial residual, long over the term."""
    names = list(xs)

    def solve(cross: Cross) -> pd.DataFrame:
        return pd.DataFrame({"beta": [Model(cross, names, names).coefficients.tolist()], "means": [cross.mean[:-1].tolist()]})

    fit = _on_gram(gram(df, [*names, y]), names, solve, "beta array<double>, means array<double>")
    rows = df.dropna(subset=[*names, y]).withColumn("_m", fit.select(F.struct("*")).scalar())
    fitted = F.col("_m.beta")[0] + _sum(F.col("_m.beta")[i + 1] * F.col(c) for i, c in enumerate(names))
    rows = rows.withColumn("fitted", fitted).withColumn("resid", F.col(y) - F.col("fitted"))
    terms = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("x"),
                               (F.col("_m.beta")[i + 1] * (F.col(c) - F.col("_m.means")[i])).alias("contribution"))
                      for i, c in enumerate(names)])
    long = rows.select(*keep, y, "fitted", "resid", F.explode(terms).alias("e"))
    return long.select(*keep, y, "fitted", "e.term", "e.x", "e.contribution",
                       (F.col("e.contribution") + F.col("resid")).alias("partial_residual"))


# Tuning constants of the bisquare function for 50 % breakdown and 95 % efficiency.
S_TUNING, M_TUNING = 1.54764, 4.685061


def _rho(u: np.ndarray, c: float) -> np.ndarray:
    v = np.minimum((u / c) ** 2, 1.0)
    return 1.0 - (1.0 - v) ** 3


def robust_regression(df: DataFrame, y: str, xs: Sequence[str], subsets: int = 200, rounds: int = 100,
                      seed: int = 42) -> DataFrame:
    """MM regression: scale from an S-estimate, coefficients by bisquare reweighting.

    Starting values are fits to many small random subsets, which hashes of the rows draw from all of them.  All
    candidates are carried together: one pass over the rows sums, for every candidate, the bounded loss and the
    weighted cross products of the next reweighting step.  Only matrices of the size of the model and the subsets
    reach the driver.  ``converged`` tells whether both searches came to rest within ``rounds`` passes.
    """
    names = list(xs)
    p = len(names) + 1
    data = df.select(*[F.col(c).cast("double").alias(c) for c in (y, *names)]).dropna()
    means = data.agg(*[F.avg(c).alias(c) for c in data.columns]).first()
    if means[0] is None:
        raise ValueError("too few complete rows for a robust fit")
    data = settle(data.select(*[(F.col(c) - F.lit(means[c])).alias(c) for c in data.columns]))
    drawn = data.withColumns({"_g": F.pmod(F.xxhash64(F.lit(seed), *data.columns), F.lit(subsets)),
                              "_o": F.xxhash64(F.lit(seed + 1), *data.columns)})

    def least(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pd.concat([held, pdf]).drop_duplicates().sort_values(["_g", "_o"]).groupby("_g").head(p + 1)
        if held is not None:
            yield held

    of_group = Window.partitionBy("_g").orderBy("_o", *data.columns)
    few = drawn.mapInPandas(least, drawn.schema).distinct().withColumn("_n", F.row_number().over(of_group))
    pool = few.where(F.col("_n") <= p + 1).orderBy("_g", "_n").toPandas()
    starts = [g[data.columns].to_numpy(float) for _, g in pool.groupby("_g") if len(g) > p]
    if not starts:
        starts = [pool[data.columns].to_numpy(float)]
    if len(starts[0]) <= p:
        raise ValueError("too few complete rows for a robust fit")
    betas = np.array([np.linalg.lstsq(np.column_stack([np.ones(len(m)), m[:, 1:]]), m[:, 0], rcond=None)[0] for m in starts])
    subsets = len(betas)

    def first_scales() -> np.ndarray:
        """Mean absolute residual of every candidate over all rows, on the scale of a standard deviation."""
        def partial(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            total, n = np.zeros(len(betas)), 0
            for pdf in batches:
                m = pdf.to_numpy(float)
                total += np.abs(m[:, :1] - np.column_stack([np.ones(len(m)), m[:, 1:]]) @ betas.T).sum(axis=0)
                n += len(m)
            yield pd.DataFrame({"i": np.arange(len(betas)), "v": total, "n": n})

        rows = data.mapInPandas(partial, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
        rows = rows.sort_values("i")
        return np.maximum((rows["v"] / rows["n"]).to_numpy(float) * 1.2533, 1e-12)

    def sweep(candidates: np.ndarray, scales: np.ndarray, tuning: float
              ) -> tuple[np.ndarray, np.ndarray, int]:
        """Reweighted coefficients and mean bounded loss of every candidate, and the row count."""
        cells = (p + 1) ** 2 + 1

        def partial(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            total, n = np.zeros((len(candidates), cells)), 0
            for pdf in batches:
                m = pdf.to_numpy(float)
                full = np.column_stack([np.ones(len(m)), m[:, 1:], m[:, 0]])
                u = (m[:, :1] - full[:, :p] @ candidates.T) / scales
                weight = np.where(np.abs(u) < tuning, (1 - (u / tuning) ** 2) ** 2, 0.0)
                for k in range(len(candidates)):
                    total[k, :-1] += (full.T @ (weight[:, k:k + 1] * full)).ravel()
                total[:, -1] += _rho(u, S_TUNING).sum(axis=0)
                n += len(m)
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel(), "n": n})

        rows = data.mapInPandas(partial, "i int, v double, n long").groupBy("i").agg(
            F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas().sort_values("i")
        n, sums = int(rows["n"].iloc[0]), rows["v"].to_numpy(float).reshape(len(candidates), cells)
        fits = [Model(Cross.raw(g[:-1].reshape(p + 1, p + 1)), names, names).coefficients for g in sums]
        return np.array(fits), sums[:, -1] / n, n

    def rescaled(scales: np.ndarray, loss: np.ndarray) -> np.ndarray:
        return np.maximum(scales * np.sqrt(np.maximum(loss, 1e-12) / 0.5), 1e-12)

    scales = first_scales()
    # judge all candidates, keep the best few and let them converge
    for keep in (max(subsets // 4, 5), 5):
        improved, loss, n = sweep(betas, scales, S_TUNING)
        scales = rescaled(scales, loss)
        best = np.argsort(scales)[:keep]
        betas, scales = improved[best], scales[best]
    rest = [False, False]
    for _ in range(rounds):
        improved, loss, n = sweep(betas, scales, S_TUNING)
        new = rescaled(scales, loss)
        rest[0] = bool(np.max(np.abs(new / scales - 1)) < 1e-7)
        betas, scales = improved, new
        if rest[0]:
            break
    top = int(np.argmin(scales))
    beta, scale = betas[top:top + 1], scales[top:top + 1]
    for _ in range(rounds):
        improved, _, n = sweep(beta, scale, M_TUNING)
        moved = np.max(np.abs(improved - beta)) / max(np.max(np.abs(beta)), 1e-12)
        beta = improved
        rest[1] = bool(moved < 1e-7)
        if rest[1]:
            break
    found = beta[0].copy()
    found[0] += means[y] - sum(b * means[c] for b, c in zip(found[1:], names, strict=True))
    rows = [(t, float(b), float(scale[0]), n, all(rest)) for t, b in zip(("(intercept)", *names), found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, scale double, n long, converged boolean")


# ---- semivariances ---------------------------------------------------------------------------

def sample_variogram(points: DataFrame, width: float, cutoff: float, x: str = "x", y: str = "y",
                     z: str = "z", block: int = 2000) -> DataFrame:
    """Binned sample variogram: ``bin, n, distance, gamma`` of pairs closer than ``cutoff``.

    Equal points are merged with their count.  Points are placed in grid cells of the cutoff size, so
    partners lie in neighbouring cells.  A crowded cell is split into strips, ever more of them from some ``32 * block`` points on,
    and a task handles one pair of strips: no cell, however crowded, ends up in one task, and only bin sums leave a task.

    Within a task, points are summed in a fine grid.  Where all points of two fine cells are as far apart as one bin holds,
    their pairs are counted by the product of their sums: all such cells at once, as a correlation of grids.  Numbers of pairs
    and differences of values are exact so; distances are expanded to fourth order around the cells' centres, which for
    cells ``NEAR_CELLS`` apart leaves a share of less than 1e-9.  Only pairs of cells on a bin's edge, and near ones,
    are taken point by point.  The fine grid follows the root of the number of points, and with it these pairs their power 1.5.
    """
    # a point without a place is near none
    pts = settle(points.where(F.col(z).isNotNull() & finite(F.col(x).cast("double")).isNotNull() & finite(F.col(y).cast("double")).isNotNull()).groupBy(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        F.col(z).cast("double").alias("z")).agg(F.count(F.lit(1)).cast("double").alias("w")))
    size = pts.agg(F.count(F.lit(1)).alias("n"), F.avg(finite("z")).alias("z"), F.count(finite("z")).alias("known")).first()
    if not size["n"]:
        return pts.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"), F.col("x").alias("distance"), F.col("x").alias("gamma"))
    fine = 2 ** min(max(round(math.log2(max(math.sqrt(size["n"]) / 2, 1))), 6), 9)  # fine cells to a cutoff
    cell = cutoff / fine
    pts = pts.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell), "z": F.col("z") - F.lit(size["z"] or 0.0)})
    pts = pts.withColumns({"cx": F.floor(F.col("gx") / fine), "cy": F.floor(F.col("gy") / fine)})
    crowd = pts.groupBy("cx", "cy").agg((F.floor(F.sqrt(F.count(F.lit(1)) / (32 * block))) + 1).cast("int").alias("k"))
    pts = pts.join(crowd, ["cx", "cy"])
    pts = pts.withColumn("b", F.floor((F.col("gy") - F.col("cy") * fine) * F.col("k") / fine).cast("int"))
    blocks = pts.groupBy("cx", "cy", "b").agg(F.min("gy").alias("low"), F.max("gy").alias("high"))
    # one half of the neighbourhood: each unordered pair of cells once
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in steps]))
    other = blocks.select(F.col("cx").alias("cx2"), F.col("cy").alias("cy2"), F.col("b").alias("b2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = F.greatest(F.col("low2") - F.col("high"), F.col("low") - F.col("high2"))
    pairs = (blocks.withColumn("s", near)
             .withColumns({"cx2": F.col("cx") + F.col("s.dx"), "cy2": F.col("cy") + F.col("s.dy"),
                           "same": (F.col("s.dx") == 0) & (F.col("s.dy") == 0)})
             .join(other, ["cx2", "cy2"]).where((~F.col("same") | (F.col("b2") >= F.col("b"))) & (apart <= fine + 1))
             .select("cx", "cy", "b", "cx2", "cy2", "b2",
                     F.concat_ws("|", "cx", "cy", "b", "cx2", "cy2", "b2").alias("pair")))
    kept = ["x", "y", "z", "w", "gx", "gy"]
    left = pairs.join(pts, ["cx", "cy", "b"]).select("pair", F.lit(0).alias("side"), *kept)
    right = (pairs.where("cx <> cx2 or cy <> cy2 or b <> b2")
             .join(pts.select(F.col("cx").alias("cx2"), F.col("cy").alias("cy2"), F.col("b").alias("b2"), *kept), ["cx2", "cy2", "b2"])
             .select("pair", F.lit(1).alias("side"), *kept))
    bins = int(math.ceil(cutoff / width))
    near_cells, chunk, order = NEAR_CELLS, 1 << 19, 4
    few = PAIRS_PER_CELL * fine ** 2 if size["known"] == size["n"] else math.inf  # NaN stays in the bins of its pairs
    powers = [(p, r) for p in range(order + 1) for r in range(order + 1 - p)]

    def binned(h: np.ndarray) -> np.ndarray:
        return np.minimum((h / width).astype(np.int64), bins - 1)

    def kinds(di: np.ndarray, dj: np.ndarray) -> np.ndarray:
        """Of cells so many columns and rows apart: their bin, -1 to be taken by points, -2 beyond the cutoff."""
        ai, aj = np.abs(di), np.abs(dj)
        least = np.hypot(np.maximum(ai - 1, 0), np.maximum(aj - 1, 0)) * cell - 1e-6 * cell
        most = np.hypot(ai + 1, aj + 1) * cell + 1e-6 * cell
        first = binned(np.maximum(least, 0))
        whole = (first == binned(most)) & (most < cutoff) & (np.hypot(ai, aj) >= near_cells)
        return np.where(least >= cutoff, -2, np.where(whole, first, -1))

    def slopes(u: np.ndarray, v: np.ndarray) -> dict:
        """Derivatives of the length of (u, v), divided by the factorials of their orders."""
        h = np.hypot(u, v)
        u2, v2 = u * u, v * v
        return {(0, 0): h, (1, 0): u / h, (0, 1): v / h,
                (2, 0): v2 / h ** 3 / 2, (1, 1): -u * v / h ** 3, (0, 2): u2 / h ** 3 / 2,
                (3, 0): -3 * u * v2 / h ** 5 / 6, (2, 1): v * (2 * u2 - v2) / h ** 5 / 2,
                (1, 2): u * (2 * v2 - u2) / h ** 5 / 2, (0, 3): -3 * v * u2 / h ** 5 / 6,
                (4, 0): 3 * v2 * (4 * u2 - v2) / h ** 7 / 24, (3, 1): 3 * u * v * (3 * v2 - 2 * u2) / h ** 7 / 6,
                (2, 2): (2 * u2 * u2 - 11 * u2 * v2 + 2 * v2 * v2) / h ** 7 / 4,
                (1, 3): 3 * u * v * (3 * u2 - 2 * v2) / h ** 7 / 6, (0, 4): 3 * u2 * (4 * v2 - u2) / h ** 7 / 24}

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        n, d, g = np.zeros(bins), np.zeros(bins), np.zeros(bins)
        side = pdf["side"].to_numpy()
        px, py, pz, pw = (pdf[c].to_numpy(float) for c in ("x", "y", "z", "w"))
        gx, gy = pdf["gx"].to_numpy(np.int64), pdf["gy"].to_numpy(np.int64)
        inside = not side.any()
        la = np.flatnonzero(side == 0)
        la = la[np.lexsort((gx[la], gy[la]))]
        lb = la if inside else np.flatnonzero(side == 1)
        lb = lb if inside else lb[np.lexsort((gx[lb], gy[lb]))]

        def tally(i: np.ndarray, j: np.ndarray, share: float = 1.0) -> None:
            dx, dy = px[j] - px[i], py[j] - py[i]
            h = np.sqrt(dx * dx + dy * dy)
            ok = np.flatnonzero(h < cutoff)
            h, i, j = h[ok], i[ok], j[ok]
            at, w = binned(h), pw[i] * pw[j] * share
            nonlocal n, d, g
            n = n + np.bincount(at, w, minlength=bins)
            d = d + np.bincount(at, w * h, minlength=bins)
            g = g + np.bincount(at, w * 0.5 * (pz[j] - pz[i]) ** 2, minlength=bins)

        def ranges(i: np.ndarray, first: np.ndarray, length: np.ndarray, share: float = 1.0) -> None:
            """Pairs of each point ``i`` with ``length`` partners from place ``first`` on, so many at a time."""
            some = length > 0
            i, first, length = i[some], first[some], length[some]
            ends = np.cumsum(length)
            start = 0
            while start < len(i):
                done = ends[start - 1] if start else 0
                stop = max(int(np.searchsorted(ends, done + chunk, "right")), start + 1)
                size = length[start:stop]
                total = int(size.sum())
                places = np.arange(total) + np.repeat(first[start:stop] - (np.cumsum(size) - size), size)
                tally(np.repeat(i[start:stop], size), lb[places], share)
                start = stop

        def result() -> pd.DataFrame:
            # pandas' NaN arrives as NULL, which a sum passes over
            return pd.DataFrame({"bin": np.arange(bins), "n": np.rint(n).astype("int64"), "d": d, "g": g, "bad": np.isnan(g)})

        if inside:
            n[0] -= 0.5 * pw.sum()  # a point of weight w has w (w - 1) / 2 pairs with its like
        if len(la) * len(lb) <= few:
            if inside:
                here = np.arange(len(la))
                ranges(la, here, np.ones(len(la), np.int64), 0.5)
                ranges(la, here + 1, len(la) - 1 - here)
            else:
                ranges(la, np.zeros(len(la), np.int64), np.full(len(la), len(lb)))
            return result()

        corners = {}
        for name, of in (("a", la), ("b", lb)):
            corners[name] = gx[of].min(), gy[of].min(), gx[of].max(), gy[of].max()
        ax, ay, ax2, ay2 = corners["a"]
        bx, by, bx2, by2 = corners["b"]
        cols_a, rows_a, cols_b, rows_b = ax2 - ax + 1, ay2 - ay + 1, bx2 - bx + 1, by2 - by + 1

        # whole cells: correlations of their sums
        shape = tuple(1 << int(v - 1).bit_length() for v in (rows_a + rows_b, cols_a + cols_b))
        def grids(of, x0, y0) -> dict:
            ix, iy = gx[of] - x0, gy[of] - y0
            place = iy * shape[1] + ix
            u, v, w, q = px[of] / cell - gx[of] - 0.5, py[of] / cell - gy[of] - 0.5, pw[of], pz[of]
            terms = {(p, r): w * u ** p * v ** r for p, r in powers} | {"z": w * q, "zz": w * q * q}
            return {k: np.fft.rfft2(np.bincount(place, t, minlength=shape[0] * shape[1]).reshape(shape)) for k, t in terms.items()}

        fa = grids(la, ax, ay)
        fb = fa if inside else grids(lb, bx, by)
        fa = {k: np.conj(v) for k, v in fa.items()}
        dj = np.arange(shape[0])
        dj = np.where(dj >= rows_b, dj - shape[0], dj) + (by - ay)
        di = np.arange(shape[1])
        di = np.where(di >= cols_b, di - shape[1], di) + (bx - ax)
        every = kinds(di[None, :], dj[:, None])
        if inside:
            every = np.where((dj[:, None] > 0) | ((dj[:, None] == 0) & (di[None, :] > 0)), every, -2)
        at = np.nonzero(every >= 0)
        to = every[at]

        def product(spectrum: np.ndarray) -> np.ndarray:
            return np.fft.irfft2(spectrum, shape)[at]

        n += np.bincount(to, np.rint(product(fa[0, 0] * fb[0, 0])), minlength=bins)
        g += np.bincount(to, product(0.5 * (fa[0, 0] * fb["zz"] + fa["zz"] * fb[0, 0]) - fa["z"] * fb["z"]), minlength=bins)
        far = slopes(di[at[1]].astype(float), dj[at[0]].astype(float))
        for p, r in powers:
            spectrum = sum(math.comb(p, e) * math.comb(r, f) * (-1) ** (e + f) * fa[e, f] * fb[p - e, r - f]
                           for e in range(p + 1) for f in range(r + 1))
            d += np.bincount(to, product(spectrum) * far[p, r], minlength=bins) * cell

        # cells on an edge of a bin: runs of columns in each row, so partners lie side by side
        del fa, fb, far
        begin = np.concatenate([[0], np.cumsum(np.bincount((gy[lb] - by) * cols_b + gx[lb] - bx, minlength=rows_b * cols_b))])
        for step in range(max(by - ay2, -fine - 1, 0 if inside else -fine - 1), min(by2 - ay, fine + 1) + 1):
            row = gy[la] + step - by
            mine = (row >= 0) & (row < rows_b)
            if not mine.any():
                continue
            i, row = la[mine], row[mine]
            column = gx[i] - bx
            across = np.arange(-fine - 1, fine + 2)
            open_ = kinds(across, np.full(len(across), step)) == -1
            if inside and step == 0:
                open_ &= across > 0
                first = begin[row * cols_b + column]
                ranges(i, first, begin[row * cols_b + column + 1] - first, 0.5)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                one = np.clip(column + across[lo], 0, cols_b)
                two = np.clip(column + across[hi - 1] + 1, 0, cols_b)
                first = begin[row * cols_b + one]
                ranges(i, first, begin[row * cols_b + two] - first)
        return result()

    # few bytes hold much work: a number of tasks of its own, which is not lowered by size
    tasks = max(int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size["n"] // 2000, 2000))
    parts = left.unionByName(right).repartition(tasks, "pair").groupBy("pair").applyInPandas(sums, "bin int, n long, d double, g double, bad boolean")
    total = parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("g").alias("g"), F.max("bad").alias("bad"))
    gamma = F.when(F.col("bad"), F.lit(math.nan)).otherwise(F.col("g") / F.col("n"))
    return total.where("n > 0").select("bin", "n", (F.col("d") / F.col("n")).alias("distance"), gamma.alias("gamma"))


def fit_point_variogram(binned: DataFrame, nuggets: Sequence[float], sills: Sequence[float],
                        reaches: Sequence[float]) -> DataFrame:
    """Variogram parameters with the smallest error, weighted by pairs and relative to the model.

    A fixed grid of parameters is crossed with the few bins by ``explode`` and summed.
    """
    grid = F.array(*[F.struct(F.lit(float(a)).alias("nugget"), F.lit(float(b)).alias("sill"),
                              F.lit(float(c)).alias("reach"))
                     for a, b, c in itertools.product(nuggets, sills, reaches)])
    tried = binned.withColumn("p", F.explode(grid)).select("*", "p.*")
    model = F.col("nugget") + F.col("sill") * (1 - F.exp(-F.col("distance") / F.col("reach")))
    tried = tried.withColumn("m", model)
    err = tried.groupBy("nugget", "sill", "reach").agg(
        (F.sum(F.col("n") * F.pow(F.try_divide(F.col("gamma"), F.col("m")) - 1, F.lit(2))) / F.sum("n")).alias("error"))
    return err.agg(F.min(F.struct("error", "nugget", "sill", "reach")).alias("b")).select("b.*")
