"""Queries on regional regression and interpolation between areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import areas as ar
from ebbflow.operators import regional as rg
from ebbflow.operators import trend as tr
from ebbflow.operators.skill import cv_summary
from ebbflow.plans.registry import query
from ebbflow.session import settle
from ebbflow.sources import series

DESC = """WITH per_part AS (SELECT l_partkey, count(*) AS lines, avg(l_quantity) AS quantity, avg(l_discount) AS discount,
  avg(l_tax) AS tax, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
d AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS retail, CAST(lines AS DOUBLE) AS lines, quantity,
  discount, tax, price / 1000 AS target FROM part JOIN per_part ON l_partkey = p_partkey)
"""

SCOPE = ["size", "retail", "lines", "quantity", "discount", "tax"]


def descriptors(spark, folder):
    """Descriptor table: one row per part with a target and six predictors."""
    lines = series.table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.avg("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
        (F.avg("l_extendedprice") / 1000).alias("target"))
    parts = series.table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("retail"))
    return parts.join(lines, "l_partkey").withColumnRenamed("l_partkey", "id")


TWO = DESC + """, m AS (SELECT count(*) AS n, avg(target) AS my, avg(quantity) AS m1, avg(discount) AS m2,
  regr_sxx(target, quantity) AS s11, regr_sxx(target, discount) AS s22, regr_sxy(discount, quantity) AS s12,
  regr_sxy(target, quantity) AS sy1, regr_sxy(target, discount) AS sy2, regr_syy(target, discount) AS tss FROM d),
f AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM m),
b AS (SELECT *, (sy1 * s22 - sy2 * s12) / det AS b1, (sy2 * s11 - sy1 * s12) / det AS b2 FROM f),
r AS (SELECT *, tss - b1 * sy1 - b2 * sy2 AS rss2, tss - sy1 * sy1 / s11 AS rss1, my - b1 * m1 - b2 * m2 AS b0 FROM b)
"""


@query("regional_regression", "term:s estimate:f6 r2:f8 sigma:f6 aic:f4 n:i",
       TWO + """SELECT term, CASE term WHEN 'quantity' THEN b1 WHEN 'discount' THEN b2 ELSE b0 END AS estimate,
  1 - rss2 / tss AS r2, sqrt(rss2 / (n - 3)) AS sigma, n * ln(rss2 / n) + 6 AS aic, n
FROM r, (SELECT unnest(['(intercept)', 'quantity', 'discount']) AS term)""")
def regional_regression(spark, folder):
    """Multiple regression on two descriptors."""
    return rg.regression(descriptors(spark, folder), "target", ["quantity", "discount"])


# All descriptors: normal equations of centred columns, solved and inverted by elimination over lists.
ALL = DESC.replace("WITH ", "WITH RECURSIVE ", 1) + f""", e AS MATERIALIZED (SELECT id, j, v - avg(v) OVER (PARTITION BY j) AS v, avg(v) OVER (PARTITION BY j) AS mean FROM (
  SELECT id, unnest(range(1, 8)) AS j, unnest([{', '.join(SCOPE)}, target]) AS v FROM d)),
sm AS (SELECT a.j AS i, b.j, sum(a.v * b.v) AS s FROM e a JOIN e b USING (id) GROUP BY 1, 2),
el AS (SELECT CAST(1 AS BIGINT) AS s, list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) || list_transform(range(1, 7), lambda k: CASE WHEN k = i THEN 1.0 ELSE 0.0 END) AS r
    FROM sm WHERE i < 7 GROUP BY i) UNION ALL
  SELECT s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda x: x / r[s])
    ELSE list_transform(r, lambda x, j: x - r[s] * m[s][j] / m[s][s]) END) FROM el WHERE s <= 6),
b AS MATERIALIZED (SELECT i, {SCOPE}[i] AS term, m[i][7] AS b, m[i][8:13] AS inv FROM (SELECT m, unnest(range(1, 7)) AS i FROM el WHERE s = 7)),
f AS (SELECT (SELECT s FROM sm WHERE i = 7 AND j = 7) AS tss, (SELECT s FROM sm WHERE i = 7 AND j = 7) - (SELECT sum(b * s) FROM b JOIN sm USING (i) WHERE j = 7) AS rss, (SELECT count(*) FROM d) AS n,
  (SELECT any_value(mean) FROM e WHERE j = 7) - (SELECT sum(b * mean) FROM b JOIN (SELECT DISTINCT j AS i, mean FROM e) USING (i)) AS b0)
"""


@query("full_regression", "term:s estimate:f6 r2:f8 sigma:f6 aic:f4 n:i",
       ALL + """SELECT term, b AS estimate, 1 - rss / tss AS r2, sqrt(rss / (n - 7)) AS sigma, n * ln(rss / n) + 14 AS aic, n
FROM (SELECT term, b FROM b UNION ALL SELECT '(intercept)', b0 FROM f), f""")
def full_regression(spark, folder):
    """Multiple regression on all descriptors."""
    return rg.regression(descriptors(spark, folder), "target", SCOPE)


@query("collinear_regression", "term:s estimate:f6 r2:f8 sigma:f6 aic:f4 n:i",
       TWO + """SELECT term, CASE term WHEN 'quantity' THEN b1 WHEN 'discount' THEN b2 WHEN '(intercept)' THEN b0 END AS estimate,
  1 - rss2 / tss AS r2, sqrt(rss2 / (n - 3)) AS sigma, n * ln(rss2 / n) + 6 AS aic, n
FROM r, (SELECT unnest(['(intercept)', 'quantity', 'discount', 'both', 'constant']) AS term)""")
def collinear_regression(spark, folder):
    """Regression with a descriptor that two others determine and one that is constant: neither gets an estimate."""
    table = descriptors(spark, folder).withColumns({"both": 2 * F.col("quantity") - 3 * F.col("discount"), "constant": F.lit(7.0)})
    return rg.regression(table, "target", ["quantity", "discount", "both", "constant"])


@query("large_mean_correlation", "index:s index2:s pearson:f6 n:i",
       DESC + """, l AS (SELECT id, unnest(['target', 'quantity', 'discount']) AS index, unnest([target, quantity, discount]) AS v FROM d)
SELECT a.index, b.index AS index2, corr(a.v, b.v) AS pearson, count(*) AS n FROM l a JOIN l b USING (id) GROUP BY 1, 2""")
def large_mean_correlation(spark, folder):
    """Correlations of columns whose means are far larger than their spread."""
    table = descriptors(spark, folder).select(*[(F.col(c) + 1e6).alias(c) for c in ("target", "quantity", "discount")])
    return tr.pearson_matrix(table, ["target", "quantity", "discount"])


@query("regression_tests", "term:s se:f6 t:f4",
       ALL + "SELECT term, sqrt(rss / (n - 7) * inv[i]) AS se, b / sqrt(rss / (n - 7) * inv[i]) AS t FROM b, f")
def regression_tests(spark, folder):
    """Standard errors and t values of the slopes of all descriptors."""
    fit = rg.regression(descriptors(spark, folder), "target", SCOPE)
    return fit.where(F.col("term") != "(intercept)")


@query("term_changes", "change:s term:s rss:f4 aic:f4",
       TWO + """SELECT 'none' AS change, '' AS term, rss1 AS rss, n * ln(rss1 / n) + 4 AS aic FROM r
UNION ALL SELECT 'drop', 'quantity', tss, n * ln(tss / n) + 2 FROM r
UNION ALL SELECT 'add', 'discount', rss2, n * ln(rss2 / n) + 6 FROM r""")
def term_changes(spark, folder):
    """Dropping and adding single terms."""
    return rg.single_term_changes(descriptors(spark, folder), "target", ["quantity", "discount"], ["quantity"])


def _subsets(table: str, start: int) -> str:
    """Every subset of the descriptors swept out of the cross products of ``table``; then the path of least AIC from subset ``start``."""
    t = table
    return f"""e_{t} AS MATERIALIZED (SELECT id, j, v - avg(v) OVER (PARTITION BY j) AS v, avg(v) OVER (PARTITION BY j) AS mean FROM (
  SELECT id, unnest(range(1, 8)) AS j, unnest([{', '.join(SCOPE)}, target]) AS v FROM {t})),
mean_{t} AS (SELECT j, any_value(mean) AS mean FROM e_{t} GROUP BY 1),
cross_{t} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) || list_transform(range(1, 8), lambda k: CASE WHEN k = i THEN 1.0 ELSE 0.0 END) AS r
  FROM (SELECT a.j AS i, b.j, sum(a.v * b.v) AS s FROM e_{t} a JOIN e_{t} b USING (id) GROUP BY 1, 2) GROUP BY i)),
swept_{t} AS (SELECT u AS sub, CAST(1 AS BIGINT) AS s, m FROM cross_{t}, (SELECT unnest(range(0, 64)) AS u) UNION ALL
  SELECT sub, s + 1, CASE WHEN (sub // CAST(pow(2, s - 1) AS BIGINT)) % 2 = 0 THEN m ELSE list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda x: x / r[s])
    ELSE list_transform(r, lambda x, j: x - r[s] * m[s][j] / m[s][s]) END) END FROM swept_{t} WHERE s <= 6),
model_{t} AS MATERIALIZED (SELECT sub, m, n, bit_count(sub) + 1 AS p, m[7][7] AS rss, n * ln(m[7][7] / n) + 2 * (bit_count(sub) + 1) AS aic
  FROM swept_{t}, (SELECT count(*) AS n FROM {t}) WHERE s = 7),
path_{t} AS (SELECT CAST({start} AS BIGINT) AS sub, 0 AS k UNION ALL SELECT nxt, k + 1 FROM (
  SELECT k, arg_min(f.sub, f.aic) AS nxt, min(f.aic) AS least, any_value(c.aic) AS now FROM path_{t} z JOIN model_{t} c ON c.sub = z.sub
  JOIN model_{t} f ON bit_count(xor(f.sub, z.sub)) = 1 GROUP BY k) WHERE least < now),
last_{t} AS (SELECT * FROM model_{t} WHERE sub = (SELECT arg_max(sub, k) FROM path_{t})),
term_{t} AS (SELECT l.*, i, l.m[i][7] AS b, x.mean FROM last_{t} l, (SELECT unnest(range(1, 7)) AS i) JOIN mean_{t} x ON x.j = i WHERE (sub // CAST(pow(2, i - 1) AS BIGINT)) % 2 = 1),
level_{t} AS (SELECT (SELECT mean FROM mean_{t} WHERE j = 7) - coalesce((SELECT sum(b * mean) FROM term_{t}), 0) AS b0,
  coalesce((SELECT sum(u.mean * u.m[u.i][7 + v.i] * v.mean) FROM term_{t} u, term_{t} v), 0) AS q),
chosen_{t} AS (SELECT {SCOPE}[i] AS term, b AS estimate, sqrt(rss / (n - p) * m[i][7 + i]) AS se, 1 - rss / (SELECT rss FROM model_{t} WHERE sub = 0) AS r2, aic, n FROM term_{t}
  UNION ALL SELECT '(intercept)', b0, sqrt(rss / (n - p) * (1.0 / n + q)), 1 - rss / (SELECT rss FROM model_{t} WHERE sub = 0), aic, n FROM last_{t}, level_{t})"""


@query("stepwise_selection", "term:s estimate:f4 se:f4 r2:f6 aic:f2 n:i",
       DESC.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _subsets("d", 1) + " SELECT * FROM chosen_d")
def stepwise_selection(spark, folder):
    """Stepwise selection among all descriptors."""
    return rg.stepwise(descriptors(spark, folder), "target", SCOPE, ["size"])


ROWS = ALL + """, h AS (SELECT a.id, sum(a.v * inv[c.j] * c.v) AS h FROM e a JOIN b ON b.i = a.j JOIN e c ON c.id = a.id AND c.j < 7 GROUP BY 1),
y AS (SELECT id, sum(b * v) AS part FROM e JOIN b ON i = j GROUP BY 1),
r AS MATERIALIZED (SELECT *, target - fitted AS resid FROM (SELECT d.*, part + mean AS fitted, 1.0 / n + h AS leverage, rss / (n - 7) AS s2
  FROM d JOIN y USING (id) JOIN h USING (id), f, (SELECT any_value(mean) AS mean FROM e WHERE j = 7)))
"""


@query("cooks_distance", "id:i fitted:f4 resid:f4 leverage:f8 cooks_d:f8",
       ROWS + "SELECT id, fitted, resid, leverage, resid * resid / (7 * s2) * leverage / pow(1 - leverage, 2) AS cooks_d FROM r")
def cooks_distance(spark, folder):
    """Leverage and Cook's distance of every row, from the regression on all descriptors."""
    return rg.cooks_distance(descriptors(spark, folder), "target", SCOPE, "id")


@query("refit_without_outliers", "term:s estimate:f4 r2:f6 n:i",
       ROWS + ", d2 AS MATERIALIZED (SELECT * FROM d WHERE id NOT IN (SELECT id FROM r WHERE resid * resid / (7 * s2) * leverage / pow(1 - leverage, 2) >= 1)), "
       + _subsets("d2", 63) + " SELECT term, estimate, r2, n FROM chosen_d2")
def refit_without_outliers(spark, folder):
    """Stepwise selection again without rows whose Cook's distance is one or more."""
    table = descriptors(spark, folder)
    distance = rg.cooks_distance(table, "target", SCOPE, "id")
    kept = table.join(distance.where("cooks_d >= 1").select("id"), "id", "left_anti")
    return rg.stepwise(kept, "target", SCOPE, SCOPE)


@query("term_contributions", "id:i term:s contribution:f6 partial_residual:f4 fitted:f4",
       ROWS + """SELECT id, term, b * v AS contribution, b * v + resid AS partial_residual, fitted FROM e JOIN b ON i = j JOIN r USING (id)""")
def term_contributions(spark, folder):
    """Contribution of each descriptor and partial residuals."""
    return rg.term_contributions(descriptors(spark, folder), "target", SCOPE, "id")


@query("robust_regression", "term:s estimate:f3 scale:f3 n:i converged:b")
def robust_regression(spark, folder):
    """MM regression on all descriptors."""
    return rg.robust_regression(descriptors(spark, folder), "target", SCOPE)


@query("transformed_target", "id:i root:f6 logged:f6",
       DESC + "SELECT id, sqrt(target) AS root, ln(target) AS logged FROM d")
def transformed_target(spark, folder):
    """Square root and logarithm of the target."""
    return descriptors(spark, folder).select("id", F.sqrt("target").alias("root"), F.log("target").alias("logged"))


# ---- areas -----------------------------------------------------------------------------------

def points(spark, folder):
    """Vectors as points: the first two components are coordinates, the third is the variable."""
    return series.table(spark, folder, "embeddings").select(
        "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"),
        F.get("embedding", F.lit(2)).cast("double").alias("z"))


POINTS = """WITH pt AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
"""


@query("sample_variogram", "bin:i n:i distance:f6 gamma:f8",
       POINTS + """, h AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS h, 0.5 * pow(a.z - b.z, 2) AS g
  FROM pt a JOIN pt b ON a.vec_id < b.vec_id)
SELECT least(CAST(floor(h / 0.05) AS INTEGER), 4) AS bin, count(*) AS n, avg(h) AS distance, avg(g) AS gamma
FROM h WHERE h < 0.25 GROUP BY 1""")
def sample_variogram(spark, folder):
    """Binned variogram of all point pairs closer than the cutoff."""
    return rg.sample_variogram(points(spark, folder), 0.05, 0.25, block=200)


SIZE = 0.1


def area_cells(spark, folder):
    """Square areas, discretised on a finer grid."""
    p = points(spark, folder)
    name = F.concat_ws("/", F.floor(F.col("x") / SIZE).cast("string"), F.floor(F.col("y") / SIZE).cast("string"))
    p = p.withColumn("area_id", name)
    return ar.discretise(p, SIZE / 4), p.groupBy("area_id").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))


AREAS = POINTS + f""", nm AS (SELECT *, CAST(CAST(floor(x / {SIZE}) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(floor(y / {SIZE}) AS BIGINT) AS VARCHAR) AS area_id FROM pt),
cell AS (SELECT area_id, floor(x / {SIZE / 4}) AS cx, floor(y / {SIZE / 4}) AS cy, avg(x) AS x, avg(y) AS y, count(*) AS n FROM nm GROUP BY 1, 2, 3),
cw AS (SELECT area_id, x, y, n / sum(n) OVER (PARTITION BY area_id) AS w FROM cell)
"""


@query("area_cells", "area_id:s cells:i weight:f6 cx:f6 cy:f6",
       AREAS + "SELECT area_id, count(*) AS cells, sum(w) AS weight, sum(w * x) AS cx, sum(w * y) AS cy FROM cw GROUP BY 1")
def area_discretisation(spark, folder):
    """Areas as weighted cells: count, total weight and centre."""
    cells = area_cells(spark, folder)[0]
    return cells.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("weight").alias("weight"),
        F.sum(F.col("x") * F.col("weight")).alias("cx"), F.sum(F.col("y") * F.col("weight")).alias("cy"))


@query("areal_semivariance", "a:s b:s gamma:f8",
       AREAS + """, g AS (SELECT p.area_id AS a, q.area_id AS b, sum(p.w * q.w * CASE WHEN p.x = q.x AND p.y = q.y THEN 0 ELSE
  0.002 + 0.015 * (1 - exp(-sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) / 0.2)) END) AS g FROM cw p, cw q GROUP BY 1, 2)
SELECT g.a, g.b, g.g - 0.5 * (ga.g + gb.g) AS gamma FROM g JOIN g ga ON ga.a = g.a AND ga.b = g.a JOIN g gb ON gb.a = g.b AND gb.b = g.b
WHERE (split_part(g.a, '/', 1) = split_part(g.b, '/', 1) AND CAST(split_part(g.b, '/', 2) AS BIGINT) = CAST(split_part(g.a, '/', 2) AS BIGINT) + 1)
  OR (split_part(g.a, '/', 2) = split_part(g.b, '/', 2) AND CAST(split_part(g.b, '/', 1) AS BIGINT) = CAST(split_part(g.a, '/', 1) AS BIGINT) + 1)""")
def areal_semivariance(spark, folder):
    """Regularised semivariance of every area and its neighbours in both directions."""
    cells, areas = area_cells(spark, folder)
    ids = areas.select(F.col("area_id").alias("a"), F.split("area_id", "/").alias("s"))
    x, y = (F.col("s")[k].cast("bigint") for k in (0, 1))
    there = F.array(F.concat_ws("/", x.cast("string"), (y + 1).cast("string")), F.concat_ws("/", (x + 1).cast("string"), y.cast("string")))
    pairs = ids.select("a", F.explode(there).alias("b"))
    return ar.areal_semivariances(cells, pairs, 0.002, 0.015, 0.2)


@query("variogram_fit", "nugget:f4 sill:f4 reach:f4 error:f6",
       POINTS + """, h AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS h, 0.5 * pow(a.z - b.z, 2) AS g
  FROM pt a JOIN pt b ON a.vec_id < b.vec_id),
v AS (SELECT least(CAST(floor(h / 0.05) AS INTEGER), 4) AS bin, count(*) AS n, avg(h) AS d, avg(g) AS gamma FROM h WHERE h < 0.25 GROUP BY 1),
p AS (SELECT * FROM (SELECT unnest([0.0, 0.005, 0.01]) AS nugget), (SELECT unnest([0.005, 0.01, 0.015]) AS sill), (SELECT unnest([0.05, 0.1, 0.2]) AS reach)),
e AS (SELECT nugget, sill, reach, sum(n * pow(gamma / (nugget + sill * (1 - exp(-d / reach))) - 1, 2)) / sum(n) AS error FROM v, p GROUP BY 1, 2, 3)
SELECT * FROM e ORDER BY error, nugget, sill, reach LIMIT 1""")
def variogram_fit(spark, folder):
    """Point variogram parameters with the smallest weighted error."""
    binned = rg.sample_variogram(points(spark, folder), 0.05, 0.25, block=200)
    return rg.fit_point_variogram(binned, (0.0, 0.005, 0.01), (0.005, 0.01, 0.015), (0.05, 0.1, 0.2))


NEAR = 6
#: Areas with fewer points than this have no observation.
LEAST = 3

# Ordinary kriging in SQL: covariances instead of semivariances, so that elimination needs no exchange of rows.
KRIGED = AREAS + f""", az AS (SELECT area_id, avg(z) AS z FROM nm GROUP BY 1 HAVING count(*) >= {LEAST}),
ctr AS (SELECT area_id, sum(x * w) AS px, sum(y * w) AS py FROM cw GROUP BY 1),
g AS MATERIALIZED (SELECT p.area_id AS a, q.area_id AS b, 0.017 - sum(p.w * q.w * CASE WHEN p.x = q.x AND p.y = q.y THEN 0 ELSE
  0.002 + 0.015 * (1 - exp(-sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) / 0.2)) END) AS c FROM cw p, cw q GROUP BY 1, 2),
nb AS MATERIALIZED (SELECT t.area_id AS t, o.area_id AS a, row_number() OVER (PARTITION BY t.area_id ORDER BY sqrt(pow(t.px - o.px, 2) + pow(t.py - o.py, 2)), o.area_id) AS i
  FROM ctr t, ctr o JOIN az USING (area_id) WHERE OTHERS QUALIFY i <= {NEAR}),
rw AS (SELECT p.t, p.i, list(g.c ORDER BY q.i) || [any_value(g0.c), 1.0] AS r FROM nb p JOIN nb q ON q.t = p.t JOIN g ON g.a = p.a AND g.b = q.a
  JOIN g g0 ON g0.a = p.a AND g0.b = p.t GROUP BY 1, 2),
mx AS (SELECT t, list(r ORDER BY i) AS m, count(*) AS n FROM rw GROUP BY 1),
el AS (SELECT t, n, CAST(1 AS BIGINT) AS s, m FROM mx UNION ALL
  SELECT t, n, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda x: x / r[s])
    ELSE list_transform(r, lambda x, j: x - r[s] * m[s][j] / m[s][s]) END) FROM el WHERE s <= n),
xy AS (SELECT t, i, m[i][n + 1] AS x, m[i][n + 2] AS y FROM (SELECT t, n, m, unnest(range(1, n + 1)) AS i FROM el WHERE s = n + 1)),
tt AS (SELECT t, (1 - sum(x)) / sum(y) AS f FROM xy GROUP BY 1),
kr AS (SELECT t AS area_id, count(*) AS neighbours, sum((x + y * f) * z) AS pred, greatest(any_value(g0.c) - sum((x + y * f) * g.c) + any_value(f), 0) AS variance
  FROM xy JOIN tt USING (t) JOIN nb USING (t, i) JOIN az ON az.area_id = nb.a JOIN g ON g.a = nb.a AND g.b = t JOIN g g0 ON g0.a = t AND g0.b = t GROUP BY 1)
"""


def _kriged(spark, folder, leave_one_out: bool):
    cells, areas = area_cells(spark, folder)
    areas = settle(areas)
    observed = areas.where(F.col("n") >= LEAST)
    return observed, ar.top_kriging(cells, observed.select("area_id", "z"), areas.select("area_id"), 0.002, 0.015, 0.2, k=NEAR, leave_one_out=leave_one_out)


@query("area_kriging", "area_id:s neighbours:i pred:f6 variance:f6",
       KRIGED.replace("OTHERS", "true").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT * FROM kr")
def area_kriging(spark, folder):
    """Kriging prediction and variance of every area from the nearest areas that are observed."""
    return _kriged(spark, folder, False)[1]


@query("kriging_cross_validation", "scale:s rmse:f6 bias:f6 r2:f4",
       KRIGED.replace("OTHERS", "t.area_id <> o.area_id").replace("WITH ", "WITH RECURSIVE ", 1)
       + """, cv AS (SELECT 'transformed' AS scale, pred AS p, z AS o FROM kr JOIN az USING (area_id) UNION ALL SELECT 'original', pred * pred, z * z FROM kr JOIN az USING (area_id))
SELECT scale, sqrt(avg(pow(p - o, 2))) AS rmse, avg(p - o) AS bias, 1 - avg(pow(p - o, 2)) / var_samp(o) AS r2 FROM cv GROUP BY 1""")
def kriging_cross_validation(spark, folder):
    """Leave-one-out skill, for the variable and for its square."""
    areas, kriged = _kriged(spark, folder, True)
    both = kriged.join(areas, "area_id").select("pred", "z", (F.col("pred") ** 2).alias("pred2"), (F.col("z") ** 2).alias("z2"))
    return cv_summary(both, "pred", "z").withColumn("scale", F.lit("transformed")).unionByName(
        cv_summary(both, "pred2", "z2").withColumn("scale", F.lit("original")))


NUGGETS, SILLS, REACHES = [k / 2000 for k in range(10)], [k / 400 for k in range(1, 21)], [k / 50 for k in range(1, 51)]
PAIRS = AREAS + """, az AS (SELECT area_id, avg(z) AS z FROM nm GROUP BY 1),
ctr AS (SELECT area_id, sum(x * w) AS px, sum(y * w) AS py FROM cw GROUP BY 1),
pr AS MATERIALIZED (SELECT *, CAST(floor(distance / 0.05) AS INTEGER) AS class FROM (SELECT a.area_id AS a, b.area_id AS b, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS distance
  FROM ctr a JOIN ctr b ON a.area_id < b.area_id) WHERE distance < 0.3),
hb AS MATERIALIZED (SELECT a, b, CASE WHEN h = 0 THEN -1 ELSE CAST(floor(h / 0.02) AS INTEGER) END AS bin, sum(w) AS weight, sum(w * h) / sum(w) AS h FROM (
  SELECT p.area_id AS a, q.area_id AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS h, p.w * q.w AS w FROM cw p, cw q) GROUP BY 1, 2, 3),
sv AS (SELECT class, count(*) AS n, avg(distance) AS distance, avg(0.5 * pow(x.z - y.z, 2)) AS gamma FROM pr JOIN az x ON x.area_id = a JOIN az y ON y.area_id = b GROUP BY 1)
"""


@query("areal_variogram", "class:i n:i distance:f6 gamma:f8", PAIRS + "SELECT * FROM sv")
def areal_variogram(spark, folder):
    """Sample variogram of areas by the distance of their centres."""
    cells, areas = area_cells(spark, folder)
    return ar.area_variogram(areas, ar.area_pairs(cells, 0.3), 0.05)


@query("variogram_back_calculated", "nugget:f5 sill:f5 reach:f4 error:f6",
       PAIRS + f""", tm AS MATERIALIZED (SELECT class, part, bin, sum(f * weight) AS weight, sum(f * weight * h) / sum(f * weight) AS h FROM (
  SELECT class, 1 AS part, bin, weight, h, 1.0 AS f FROM pr JOIN hb USING (a, b) UNION ALL
  SELECT class, 0, bin, weight, h, -0.5 FROM (SELECT class, a AS e FROM pr UNION ALL SELECT class, b FROM pr) JOIN hb ON hb.a = e AND hb.b = e) GROUP BY 1, 2, 3),
ps AS (SELECT * FROM (SELECT unnest({NUGGETS}) AS nugget), (SELECT unnest({SILLS}) AS sill), (SELECT unnest({REACHES}) AS reach)),
md AS (SELECT nugget, sill, reach, class, sum(weight * CASE WHEN h = 0 THEN 0 ELSE nugget + sill * (1 - exp(-h / reach)) END) AS model FROM tm, ps GROUP BY ALL),
er AS (SELECT nugget, sill, reach, sum(v.n * pow(gamma / (model / v.n) - 1, 2)) / sum(v.n) AS error FROM md JOIN sv v USING (class) GROUP BY 1, 2, 3)
SELECT * FROM er ORDER BY error, nugget, sill, reach LIMIT 1""")
def variogram_back_calculated(spark, folder):
    """Point variogram, out of 10,000, whose values regularised to areas come closest to the variogram of areas."""
    cells, areas = area_cells(spark, folder)
    return ar.back_calculated_variogram(cells, areas, 0.3, 0.05, 0.02, NUGGETS, SILLS, REACHES)


@query("prediction_skill", "by:s rmse:f6 bias:f6 r2:f6",
       DESC + """, p AS (SELECT target, retail * quantity / 1000 AS pred FROM d)
SELECT 'all' AS "by", sqrt(avg(pow(pred - target, 2))) AS rmse, avg(pred - target) AS bias,
  1 - avg(pow(pred - target, 2)) / var_samp(target) AS r2 FROM p""")
def prediction_skill(spark, folder):
    """RMSE, bias and R2 of a prediction."""
    table = descriptors(spark, folder).withColumn("pred", F.col("retail") * F.col("quantity") / 1000)
    return cv_summary(table, "pred", "target").withColumn("by", F.lit("all"))
