"""Semivariances, variogram fit and kriging of areas (catchments) that are made of weighted cells.

The cells of two areas meet in joins on the areas' names, and what leaves a join is summed at once: a semivariance or a
histogram of distances for each pair of areas.  A histogram does not depend on variogram parameters, so it is made
once, and every set of parameters then costs one sum over a few bins.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.session import settle


def discretise(points: DataFrame, cell: float, area: str = "area_id", x: str = "x", y: str = "y") -> DataFrame:
    """Areas as weighted grid cells: ``area_id, x, y, weight`` (weights of an area sum to one).

    Crowded areas shrink to one row per grid cell before any shuffle.
    """
    cx, cy = F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)
    cells = points.groupBy(F.col(area).alias("area_id"), cx.alias("_cx"), cy.alias("_cy")).agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("_n"))
    total = cells.groupBy("area_id").agg(F.sum("_n").alias("_t"))
    return cells.join(total, "area_id").select("area_id", "x", "y", (F.col("_n") / F.col("_t")).alias("weight"))


def centres(cells: DataFrame) -> DataFrame:
    """``area_id, px, py``: the weighted centre of every area."""
    return cells.groupBy("area_id").agg(F.sum(F.col("x") * F.col("weight")).alias("px"),
                                        F.sum(F.col("y") * F.col("weight")).alias("py"))


def semivariance(h: Column, nugget: float | Column, sill: float | Column, reach: float | Column, shape: float = 1.0) -> Column:
    """Exponential point variogram (zero at zero distance)."""
    lag = h / reach if shape == 1.0 else F.pow(h / reach, F.lit(shape))
    return F.when(h == 0, 0.0).otherwise(nugget + sill * (1 - F.exp(-lag)))


def area_pairs(cells: DataFrame, cutoff: float) -> DataFrame:
    """``a, b, distance`` of all pairs of areas (``a < b``) whose centres are closer than ``cutoff``."""
    at = centres(cells).withColumns({"gx": F.floor(F.col("px") / cutoff), "gy": F.floor(F.col("py") / cutoff)})
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                               for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    left = at.withColumn("s", half).select(F.col("area_id").alias("l"), F.col("px").alias("lx"), F.col("py").alias("ly"), "s",
                                           (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
    met = left.join(at, ["gx", "gy"]).where((F.col("s.i") != 0) | (F.col("s.j") != 0) | (F.col("l") < F.col("area_id")))
    met = met.withColumn("distance", _distance("lx", "ly", "px", "py")).where(F.col("distance") < cutoff)
    return met.select(F.least("l", "area_id").alias("a"), F.greatest("l", "area_id").alias("b"), "distance")


def _distance(x: str, y: str, x2: str, y2: str) -> Column:
    dx, dy = F.col(x) - F.col(x2), F.col(y) - F.col(y2)
    return F.sqrt(dx * dx + dy * dy)


def _cell_pairs(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, h, w`` for all cells of the two areas of each pair, and of every area with itself."""
    pairs = pairs.select("a", "b")
    own = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumn("b", F.col("a"))
    left = cells.select(F.col("area_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("weight").alias("wa"))
    right = cells.select(F.col("area_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("weight").alias("wb"))
    met = pairs.unionByName(own).distinct().join(left, "a").join(right, "b")
    return met.select("a", "b", _distance("xa", "ya", "xb", "yb").alias("h"), (F.col("wa") * F.col("wb")).alias("w"))


def areal_semivariances(cells: DataFrame, pairs: DataFrame, nugget: float, sill: float, reach: float) -> DataFrame:
    """``a, b, gamma``: regularised semivariance of the given area pairs ``a, b`` from their cells.

    The mean point semivariance between the two areas less half the mean within each of them.  Cells meet in a join and
    are summed with map-side partial sums; no list of cells is gathered.
    """
    mean = _cell_pairs(cells, pairs).groupBy("a", "b").agg(
        F.sum(F.col("w") * semivariance(F.col("h"), nugget, sill, reach)).alias("g"))
    mean = settle(mean)
    own = mean.where("a = b")
    out = pairs.select("a", "b").join(mean, ["a", "b"])
    out = out.join(own.select("a", F.col("g").alias("ga")), "a").join(own.select("b", F.col("g").alias("gb")), "b")
    return out.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(
        F.col("g") - 0.5 * (F.col("ga") + F.col("gb"))).alias("gamma"))


# ---- variogram fit by back-calculation ----------------------------------------------------------

def distance_histograms(cells: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """``a, b, bin, weight, h``: the distances between the cells of each pair, and within each area of a pair.

    ``weight`` is the share of the bin in all products of weights, ``h`` its mean distance.  Bin -1 holds distance zero,
    where a variogram is zero whatever its nugget.  One distributed aggregation over the cells.
    """
    met = _cell_pairs(cells, pairs).withColumn("bin", F.when(F.col("h") == 0, -1).otherwise(F.floor(F.col("h") / width)).cast("int"))
    return met.groupBy("a", "b", "bin").agg(F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("h"))


def area_variogram(areas: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """``class, n, distance, gamma``: sample variogram of ``areas(area_id, z)`` by classes of the distance of centres."""
    za = areas.select(F.col("area_id").alias("a"), F.col("z").alias("za"))
    zb = areas.select(F.col("area_id").alias("b"), F.col("z").alias("zb"))
    half = 0.5 * (F.col("za") - F.col("zb")) * (F.col("za") - F.col("zb"))
    met = pairs.join(za, "a").join(zb, "b").where("za IS NOT NULL AND zb IS NOT NULL")
    return met.groupBy(F.floor(F.col("distance") / width).cast("int").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance"), F.avg(half).alias("gamma"))


def class_terms(histograms: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """``class, part, bin, weight, h``: the mean histogram of the pairs of each class.

    The semivariance of a class is the sum of ``weight`` times the point semivariance at ``h``: distances between areas
    (``part`` 1) count in full, those within each of the two (``part`` 0) by minus a half.  Their number depends on classes
    and bins, not on areas or cells.
    """
    pairs = pairs.select("a", "b", F.floor(F.col("distance") / width).cast("int").alias("class"))
    size = pairs.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    between = pairs.join(histograms, ["a", "b"]).select("class", F.lit(1).alias("part"), "bin", "weight", "h")
    areas = pairs.select("class", "a").unionByName(pairs.select("class", F.col("b").alias("a"))).groupBy("class", "a").agg(F.count(F.lit(1)).alias("k"))
    own = histograms.where("a = b").drop("b")
    within = areas.join(own, "a").select("class", F.lit(0).alias("part"), "bin", (F.col("weight") * F.col("k") * -0.5).alias("weight"), "h")
    total = between.unionByName(within).groupBy("class", "part", "bin").agg(
        F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("h")) / F.sum("weight")).alias("h"))
    return total.join(size, "class").select("class", "part", "bin", (F.col("weight") / F.col("n")).alias("weight"), "h")


def variogram_errors(terms: DataFrame, sample: DataFrame, nuggets: Sequence[float], sills: Sequence[float],
                     reaches: Sequence[float]) -> DataFrame:
    """``nugget, sill, reach, error`` of every set of parameters: squared relative errors of the classes, weighted by pairs.

    Sets are numbered and built from three short lists, so the plan holds no grid; each meets the ``terms`` only.
    """
    sizes = [len(nuggets), len(sills), len(reaches)]

    def pick(values: Sequence[float], step: int) -> Column:
        at = F.floor(F.col("set") / step) % len(values)
        return F.get(F.array(*[F.lit(float(v)) for v in values]), at.cast("int"))

    every = F.explode(F.sequence(F.lit(0), F.lit(math.prod(sizes) - 1)))
    tried = terms.withColumn("set", every).withColumns(
        {"nugget": pick(nuggets, sizes[1] * sizes[2]), "sill": pick(sills, sizes[2]), "reach": pick(reaches, 1)})
    point = semivariance(F.col("h"), F.col("nugget"), F.col("sill"), F.col("reach"))
    model = tried.groupBy("nugget", "sill", "reach", "class").agg(F.sum(F.col("weight") * point).alias("model"))
    off = F.try_divide("gamma", "model") - 1
    return model.join(sample, "class").groupBy("nugget", "sill", "reach").agg(
        (F.sum(F.col("n") * off * off) / F.sum("n")).alias("error"))


def back_calculated_variogram(cells: DataFrame, areas: DataFrame, cutoff: float, class_width: float, bin_width: float,
                              nuggets: Sequence[float], sills: Sequence[float], reaches: Sequence[float]) -> DataFrame:
    """Point variogram whose regularised semivariances come closest to the sample variogram of ``areas(area_id, z)``.

    One row ``nugget, sill, reach, error``.  Cells are read once, for the histograms; of equal errors the least parameters win.
    Areas without a value or without cells take no part; without any pair within ``cutoff`` there is no row.
    """
    valued = areas.where(F.col("z").isNotNull()).select("area_id", "z")
    cells = cells.join(valued.select("area_id"), "area_id", "left_semi")
    pairs = settle(area_pairs(cells, cutoff))
    terms = settle(class_terms(settle(distance_histograms(cells, pairs, bin_width)), pairs, class_width))
    errors = variogram_errors(terms, area_variogram(valued, pairs, class_width), nuggets, sills, reaches)
    best = errors.where(F.col("error").isNotNull()).agg(F.min(F.struct("error", "nugget", "sill", "reach")).alias("b"))
    return best.where(F.col("b").isNotNull()).select("b.nugget", "b.sill", "b.reach", "b.error")


# ---- nearest areas ------------------------------------------------------------------------------

def nearest_areas(observed: DataFrame, targets: DataFrame, k: int, others: bool = False) -> DataFrame:
    """``target, area_id, distance, rank``: the ``k`` observed centres closest to each target, exactly.

    Both tables hold ``area_id, px, py``.  Ties go to the smaller name; with ``others`` a target does not count itself.
    Round by round the grid grows twice as coarse, and the targets left look at their cell and the ring around it.  A
    target is settled when its ``k``-th neighbour is nearer than the outer border of that ring, or the ring holds everything.
    Only the first ``k`` of a round leave a task.
    """
    box = observed.agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("x0"), F.max("px").alias("x1"),
                       F.min("py").alias("y0"), F.max("py").alias("y1")).first()
    target = F.col("area_id").alias("target")
    left = settle(targets.select(target, F.col("px").alias("tx"), F.col("py").alias("ty")).distinct())
    if not box["n"]:
        return left.select("target", F.col("target").alias("area_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    side = max(box["x1"] - box["x0"], box["y1"] - box["y0"])
    cell = side * math.sqrt(k / box["n"]) / 2 or 1.0
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    order = Window.partitionBy("target").orderBy("distance", "area_id")
    done = None
    while True:
        gx, gy = F.floor(F.col("tx") / cell), F.floor(F.col("ty") / cell)
        border = F.least(F.col("tx") - (gx - 1) * cell, (gx + 2) * cell - F.col("tx"), F.col("ty") - (gy - 1) * cell, (gy + 2) * cell - F.col("ty"))
        covers = ((gx - 1) * cell <= box["x0"]) & ((gx + 2) * cell > box["x1"]) & ((gy - 1) * cell <= box["y0"]) & ((gy + 2) * cell > box["y1"])
        asked = left.withColumns({"border": F.when(covers, F.lit(math.inf)).otherwise(border), "s": around}).withColumns(
            {"gx": gx + F.col("s.i"), "gy": gy + F.col("s.j")})
        here = observed.select("area_id", "px", "py", F.floor(F.col("px") / cell).alias("gx"), F.floor(F.col("py") / cell).alias("gy"))
        met = asked.join(here, ["gx", "gy"])
        if others:
            met = met.where(F.col("target") != F.col("area_id"))
        met = met.withColumn("distance", _distance("tx", "ty", "px", "py")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        certain = (F.col("border") == math.inf) | (F.col("rank") == k) & (F.col("distance") < F.col("border"))
        met = settle(met.withColumn("certain", F.max(certain).over(Window.partitionBy("target"))).select("target", "area_id", "distance", "rank", "certain"))
        found = met.where("certain").drop("certain")
        done = found if done is None else done.unionByName(found)
        reached = F.coalesce(covers, F.lit(False))  # all was looked at, found or not
        left = settle(left.where(~reached).join(found.select("target").distinct(), "target", "left_anti"))
        if left.isEmpty():
            return done
        cell *= 2


# ---- kriging ------------------------------------------------------------------------------------

def top_kriging(cells: DataFrame, observed: DataFrame, targets: DataFrame, nugget: float, sill: float, reach: float, *,
                k: int | None = None, radius: float | None = None, leave_one_out: bool = False) -> DataFrame:
    """``area_id, neighbours, pred, variance``: ordinary kriging of areas.

    ``observed`` holds ``area_id, z``; ``targets`` holds ``area_id``.  A target uses its ``k`` nearest observed areas (by their
    centres), or all of those within ``radius``, or with both the nearest ones within; one of them must be stated.  With
    ``leave_one_out`` a target never uses its own value.  Semivariances are taken once for each pair of areas that meets in
    some system; a task solves one small system a target.  A target without neighbours has no row.
    """
    if k is None and radius is None:
        raise ValueError("state how many neighbours to use, or how far to look for them")
    at = settle(centres(cells))
    valued = observed.where(F.col("z").isNotNull()).select("area_id", "z")
    known = at.join(valued.select("area_id"), "area_id", "left_semi")
    aim = at.join(targets.select("area_id").distinct(), "area_id", "left_semi")
    if k is None:
        near = _within(known, aim, radius, leave_one_out)
    else:
        near = nearest_areas(known, aim, k, leave_one_out)
        near = near if radius is None else near.where(F.col("distance") <= radius)
    near = settle(near.select("target", "area_id"))
    other = near.select("target", F.col("area_id").alias("b"))
    both = near.withColumnRenamed("area_id", "a").join(other, "target").where("a < b")
    aimed = near.select("target", F.col("area_id").alias("a"), F.col("target").alias("b"))
    wanted = both.select("target", "a", "b", F.lit(False).alias("right")).unionByName(aimed.select("target", "a", "b", F.lit(True).alias("right")))
    pairs = wanted.select("a", "b").distinct()
    gammas = areal_semivariances(cells, pairs, nugget, sill, reach)
    entries = wanted.join(gammas, ["a", "b"]).join(valued.select(F.col("area_id").alias("a"), "z"), "a")
    kind = targets.schema["area_id"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf[pdf["right"]].sort_values("a")
        place = {a: i for i, a in enumerate(right["a"])}
        n = len(place)
        system = np.ones((n + 1, n + 1))
        system[:n, :n] = 0.0
        system[n, n] = 0.0
        rest = pdf[~pdf["right"]]
        i, j = rest["a"].map(place).to_numpy(int), rest["b"].map(place).to_numpy(int)
        system[i, j] = system[j, i] = rest["gamma"].to_numpy(float)
        target = np.append(right["gamma"].to_numpy(float), 1.0)
        weights = np.linalg.lstsq(system, target, rcond=None)[0]
        return pd.DataFrame({"area_id": [pdf["target"].iloc[0]], "neighbours": [n],
                             "pred": [float(weights[:n] @ right["z"].to_numpy(float))], "variance": [float(max(weights @ target, 0.0))]})

    return entries.groupBy("target").applyInPandas(solve, f"area_id {kind}, neighbours int, pred double, variance double")


def _within(known: DataFrame, aim: DataFrame, radius: float, others: bool) -> DataFrame:
    """``target, area_id`` of all observed centres within ``radius``; they meet through grid cells of that size."""
    cell = {"gx": F.floor(F.col("px") / radius), "gy": F.floor(F.col("py") / radius)}
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in itertools.product((-1, 0, 1), repeat=2)]))
    asked = aim.withColumns({**cell, "s": around}).select(
        F.col("area_id").alias("target"), F.col("px").alias("tx"), F.col("py").alias("ty"),
        (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
    near = asked.join(known.withColumns(cell), ["gx", "gy"]).where(_distance("px", "py", "tx", "ty") <= radius)
    return near.where(F.col("target") != F.col("area_id")) if others else near
