"""Centroid clustering with geometric drift tightening.

Every vector keeps its cluster, an upper bound on the distance to its centroid and a lower bound on the distance to
any other.  When centroids move, the upper bound grows by the drift of its own.  The lower bound need not fall by the
drift of the others: all vectors of a cluster lie in a sphere around its old centroid, and in the plane through that
centre and the move of another centroid, from ``q`` to ``q'`` with midpoint ``m``,

    |x - q| - |x - q'| = 2 (x - m)(q' - q) / (|x - q| + |x - q'|) <= |q' - q| cos(angle at m between x - m and the move),

because the two distances add up to at least ``2 |x - m|``.  Over the sphere the angle is at least that of the centre
less the sphere's angular radius, which bounds the loss by less than the drift, and by nothing where the sphere lies
behind.  Vectors whose bounds do not part are ambiguous: first their own distance is taken exactly, and where that does
not settle it, all centroids are scanned.  Components are integers, so that distances and sums are exact.

Centroids are the only thing that the driver holds.  Sums follow the vectors that changed their cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.session import settle

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components from here on have squares whose sum may not fit a long.
LIMIT = 1 << 27


def whole_numbers(vector: Column, scale: int, limit: int) -> Column:
    """``floor(scale * x)`` of every component; null if one is null, not finite or not below ``limit`` after that."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < limit / scale, F.lit(False)))  # false for NaN, which is above all
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("int")))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if top * top * x.shape[1] < 1 << 50 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)


def own_squares(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c[cluster]
    return (d * d).sum(axis=1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equals the first), and the exact distances to it and to the next."""
    d = squares(x, c)
    at = d.argmin(axis=1)
    rows = np.arange(len(x))
    best = np.sqrt(d[rows, at].astype(float))
    d[rows, at] = np.iinfo(np.int64).max
    return at, best, np.sqrt(d.min(axis=1).astype(float)) if len(c) > 1 else np.full(len(x), np.inf)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster how far its own centroid moved, and by how much at most the distance to another one shrank.

    The vectors of cluster ``a`` lie within ``radius[a]`` of ``old[a]``.
    """
    old, new = old.astype(float), new.astype(float)
    move, middle = new - old, (old + new) / 2
    drift = np.sqrt((move * move).sum(axis=1))
    most = np.zeros(len(old))
    for a in range(len(old)):
        to = old[a] - middle
        far = np.sqrt((to * to).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((to * move).sum(axis=1) / (far * drift), -1, 1))
            outside = angle - np.arcsin(np.clip(radius[a] / far, 0, 1))
        shrink = np.where(radius[a] < far, drift * np.cos(np.clip(outside, 0, np.pi / 2)), drift)
        shrink[(drift == 0) | (np.arange(len(old)) == a)] = 0
        most[a] = shrink.max()
    return drift, most


class Round:
    """Assigns vectors to ``new`` centroids, given their bounds under ``old`` ones."""

    def __init__(self, old: np.ndarray, new: np.ndarray, radius: np.ndarray):
        self.new = new
        self.drift, self.shrink = loosening(old, new, radius)
        gaps = np.sqrt(squares(new, new).astype(float))
        np.fill_diagonal(gaps, np.inf)
        self.gap = gaps.min(axis=1)
        self.slack = 1e-9 * (1 + float(np.sqrt((new.astype(float) ** 2).sum(axis=1)).max()) + float(radius.max()))

    def __call__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """Cluster, upper and lower bound of every row, and which rows were scanned."""
        cluster = cluster.copy()
        upper, lower = upper + self.drift[cluster], lower - self.shrink[cluster]
        lower = np.maximum(lower, self.gap[cluster] - upper)
        unsure = np.flatnonzero(upper + self.slack >= lower)
        upper[unsure] = np.sqrt(own_squares(x[unsure], self.new, cluster[unsure]).astype(float))
        lower[unsure] = np.maximum(lower[unsure], self.gap[cluster[unsure]] - upper[unsure])
        unsure = unsure[upper[unsure] + self.slack >= lower[unsure]]
        if len(unsure):
            cluster[unsure], upper[unsure], lower[unsure] = scan(x[unsure], self.new)
        return cluster, upper, lower, unsure


def assigned(state: DataFrame, centroids: np.ndarray, step: Round | None, last: bool) -> DataFrame:
    """The next ``state``: all rows scanned if there is no ``step``, else by their bounds; the ``last`` one has exact distances."""
    names = state.columns

    def run(batches):
        for batch in batches:
            n = len(batch)
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, centroids.shape[1])
            scans = batch.column("scans").to_numpy().copy()
            was = batch.column("cluster").to_numpy()
            if step is None:
                cluster, upper, lower = scan(x, centroids) if n else (was, np.empty(0), np.empty(0))
                scans += 1
            else:
                cluster, upper, lower, unsure = step(x, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                scans[unsure] += 1
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper),
                                              pa.array(lower), pa.array(own_squares(x, centroids, cluster) if last else np.zeros(n, np.int64)), pa.array(scans.astype(np.int32))], names=names)

    return settle(state.mapInArrow(run, state.schema))


class Sums:
    """Exact sums and counts of the clusters, kept up to date from the vectors that moved."""

    def __init__(self, clusters: int, size: int):
        self.size = size
        self.total = [[0] * size for _ in range(clusters)]
        self.count = [0] * clusters

    def follow(self, state: DataFrame) -> None:
        sides = F.explode(F.array(F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("at"), F.lit(-1).alias("sign"))))
        moved = state.where("cluster <> was").select("v", sides.alias("s")).where("s.at >= 0").select("v", "s.*")
        sums = [F.sum(F.get("v", F.lit(k)).cast("long") * F.col("sign")).alias(f"x{k}") for k in range(self.size)]
        for row in moved.groupBy("at").agg(F.sum("sign").alias("n"), *sums).collect():
            self.count[row["at"]] += row["n"]
            self.total[row["at"]] = [t + row[f"x{k}"] for k, t in enumerate(self.total[row["at"]])]

    def means(self, centroids: np.ndarray) -> np.ndarray:
        return np.array([[t // n for t in total] if n else list(old) for total, n, old in zip(self.total, self.count, centroids.tolist())], np.int64)


def cluster(vectors: DataFrame, *, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, scans`` for every vector of ``vectors(vec_id, embedding)`` that takes part, and the centroids.

    ``distance`` is squared and in units of 1/``scale``; ``scans`` counts the rounds, the last assignment included, in which all
    centroids were looked at.  A vector takes part if it has ``size`` components, none of them null, NaN or infinite; those of
    2^27 / ``scale`` and more are left out with their vector, since distances to them do not fit a long.  Components become
    ``floor(scale * x)``.  Of equally near centroids the first counts.  Centroids start as the vectors with the least sha256 of
    ``seed:vec_id``; rows of one vec_id follow each other by their components, a null vec_id comes last; with fewer vectors than
    ``clusters`` each starts a cluster.  Repeated rows count as often as they occur.  Without vectors there are no rows and no
    centroids.  Other columns are left out, whatever their names.
    """
    v = F.when(F.size("embedding") == size, whole_numbers(F.col("embedding"), scale, LIMIT))
    kept = vectors.select("vec_id", v.alias("v")).where("v is not null")
    blank = {"cluster": "int", "was": "int", "upper": "double", "lower": "double", "distance": "long", "scans": "int"}
    state = settle(kept.select("*", *[F.lit(-1 if c == "cluster" else 0).cast(t).alias(c) for c, t in blank.items()]))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select("v", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return state.select("vec_id", "cluster", "distance", "scans"), np.empty((0, size), np.int64)
    centroids, step, sums = np.array([r["v"] for r in first], np.int64), None, Sums(len(first), size)
    for k in range(rounds + 1):
        state = assigned(state, centroids, step, k == rounds)
        if k == rounds:
            break
        sums.follow(state)
        radius = np.zeros(len(centroids))
        for row in state.groupBy("cluster").agg(F.max("upper").alias("r")).collect():
            radius[row["cluster"]] = row["r"]
        moved = sums.means(centroids)
        centroids, step = moved, Round(centroids, moved, radius)
    return state.select("vec_id", "cluster", "distance", "scans"), centroids


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors with their cluster, its inertia and the hash of its centroid."""
    found, centroids = cluster(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = F.array(*[F.lit(inertia.get(k, 0)).cast("long") for k in range(max(1, len(names)))])
    return found.select("vec_id", "cluster", "distance", F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                        F.get(F.array(*map(F.lit, names or [""])), F.col("cluster")).alias("centroid_sha256"))


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The rounds as a chain of tables, every distance taken."""
    parts = [f"""e AS MATERIALIZED (SELECT vec_id, i, CAST(floor(256 * x) AS BIGINT) AS x FROM (
  SELECT vec_id, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM (SELECT DISTINCT vec_id FROM e)),
c0 AS MATERIALIZED (SELECT k, i, x FROM e JOIN s USING (vec_id) WHERE k < {clusters})"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT e.vec_id, c.k, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{r} c USING (i) GROUP BY 1, 2),
a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CAST(CASE WHEN n IS NULL THEN c.x ELSE (s - (s % n + n) % n) // n END AS BIGINT) AS x FROM c{r} c LEFT JOIN m{r} USING (k, i))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k) USING (k)"""


SQL = sql()
