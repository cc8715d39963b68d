"""Queries on trend, structural change, correlation and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import indices as idx
from ebbflow.operators import trend as tr
from ebbflow.plans import fragments as sql
from ebbflow.plans.flows import INDEX_CTES
from ebbflow.plans.frequency import MONTHLY, monthly_flow
from ebbflow.plans.registry import query
from ebbflow.session import settle
from ebbflow.sources import series

OLS = """lin AS (SELECT series_id, count(*) AS n, regr_slope(value, year) AS slope, regr_intercept(value, year) AS intercept,
  regr_r2(value, year) AS r2, regr_sxx(value, year) AS sxx, regr_syy(value, year) AS syy, avg(year) AS x_mean FROM mon GROUP BY 1),
fit AS (SELECT *, n - 2 AS dof, sqrt(syy * (1 - r2) / (n - 2)) AS sigma FROM lin),
ols AS (SELECT *, sigma / sqrt(sxx) AS se_slope, sigma * sqrt(1.0 / n + x_mean * x_mean / sxx) AS se_intercept,
  slope / (sigma / sqrt(sxx)) AS t_slope FROM fit)"""


@query("linear_trend", "series_id:s n:i slope:f8 intercept:f4 r2:f6 adj_r2:f6 sigma:f6 se_slope:f8 se_intercept:f4 "
                       "t_slope:f6 f_statistic:f4 p_slope:f6",
       sql.with_(sql.SUPP, MONTHLY, OLS) + f"""SELECT *, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2,
  t_slope * t_slope AS f_statistic, {sql.t_pvalue('t_slope', 'dof')} AS p_slope FROM ols""")
def linear_trend(spark, folder):
    """Least squares trend of many series with tests."""
    return tr.ols_pvalues(tr.ols(monthly_flow(spark, folder), "value"))


@query("trend_residuals", "series_id:s year:i fitted:f6 resid:f6",
       sql.with_(sql.SUPP, MONTHLY, OLS) + """SELECT mon.series_id, year, intercept + slope * year AS fitted,
  value - (intercept + slope * year) AS resid FROM mon JOIN lin USING (series_id)""")
def trend_residuals(spark, folder):
    """Fitted values and residuals of the trend."""
    flows = monthly_flow(spark, folder)
    return tr.ols_residuals(flows, tr.ols(flows, "value"), "value")


@query("trend_intervals", "series_id:s year:i interval:s fit:f6 centre:f6 ratio:f6",
       sql.with_(sql.SUPP, MONTHLY, OLS, """gr AS (SELECT ols.*, g.year FROM ols, (SELECT unnest(generate_series(min(year), max(year))) AS year FROM mon) g),
hh AS (SELECT *, 1.0 / n + (year - x_mean) * (year - x_mean) / sxx AS h FROM gr)""")
       + """SELECT series_id, year, k AS interval, intercept + slope * year AS fit, intercept + slope * year AS centre,
  sqrt(h + e) / sqrt(h) AS ratio FROM hh, (VALUES ('Confidence', 0.0), ('Prediction', 1.0)) AS kinds(k, e)""")
def trend_intervals(spark, folder):
    """Confidence and prediction intervals; their widths are compared with each other."""
    monthly = monthly_flow(spark, folder)
    years = monthly.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.struct("*")).scalar()
    bands = tr.trend_intervals(tr.ols(monthly, "value"), years.getField("a"), years.getField("b"))
    conf = bands.where("interval = 'Confidence'").select("series_id", "year", (F.col("upr") - F.col("lwr")).alias("_w"))
    return bands.join(conf, ["series_id", "year"]).withColumns({
        "centre": (F.col("lwr") + F.col("upr")) / 2, "ratio": (F.col("upr") - F.col("lwr")) / F.col("_w")})


@query("residual_interval", "year:i n:i mean:f6 half_sd:f6",
       sql.with_(sql.SUPP, MONTHLY) + """SELECT year, count(*) AS n, avg(value) AS mean,
  stddev_samp(value) / sqrt(count(*)) AS half_sd FROM mon GROUP BY 1""")
def residual_interval(spark, folder):
    """Mean with confidence interval per month over all series (half width in t units removed)."""
    from ebbflow.functions.special import qt

    out = tr.mean_interval(monthly_flow(spark, folder), "value", ["year"])
    half = (F.col("upper") - F.col("lower")) / 2 / qt(F.lit(0.975), (F.col("n") - 1).cast("double"))
    return out.withColumn("half_sd", half)


PAIRS = """pr AS (SELECT a.series_id, (a.value - b.value) AS dy, (a.value - b.value) / (a.year - b.year) AS m
  FROM mon a JOIN mon b ON a.series_id = b.series_id AND b.year < a.year),
s_ AS (SELECT series_id, sum(sign(dy)) AS s, quantile_cont(m, 0.5) AS slope FROM pr GROUP BY 1),
tie AS (SELECT series_id, sum(t * (t - 1) * (2 * t + 5)) AS vt, sum(t * (t - 1) / 2) AS tp FROM
  (SELECT series_id, value, count(*) AS t FROM mon GROUP BY 1, 2) GROUP BY 1),
cnt AS (SELECT series_id, count(*) AS n FROM mon GROUP BY 1),
mk AS (SELECT series_id, n, s, (n * (n - 1) * (2 * n + 5) - vt) / 18.0 AS var_s,
  sqrt(n * (n - 1) / 2.0) * sqrt(n * (n - 1) / 2.0 - tp) AS denominator FROM s_ JOIN tie USING (series_id) JOIN cnt USING (series_id))"""


@query("mann_kendall", "series_id:s n:i s:i var_s:f4 denominator:f4 tau:f8 z:f8 p_value:f8",
       sql.with_(sql.SUPP, MONTHLY, PAIRS, "zz AS (SELECT *, (s - sign(s)) / sqrt(var_s) AS z FROM mk)")
       + f"SELECT *, s / denominator AS tau, least(2 * ({sql.pnorm('(-abs(z))')}), 1.0) AS p_value FROM zz")
def mann_kendall(spark, folder):
    """Mann-Kendall test of many series."""
    return tr.mann_kendall(monthly_flow(spark, folder), "value")


@query("theil_sen", "series_id:s slope:f8 intercept:f4 slope_lower:f8 slope_upper:f8",
       sql.with_(sql.SUPP, MONTHLY, PAIRS, """so AS (SELECT series_id, list_sort(list(m)) AS ms FROM pr GROUP BY 1),
ic AS (SELECT mon.series_id, quantile_cont(value - slope * year, 0.5) AS intercept FROM mon JOIN s_ USING (series_id) GROUP BY 1)""")
       + """SELECT series_id, slope, intercept,
  ms[CAST(greatest(round_even((len(ms) - 1.959963984540054 * sqrt(var_s)) / 2, 0), 1) AS INTEGER)] AS slope_lower,
  ms[CAST(least(round_even((len(ms) + 1.959963984540054 * sqrt(var_s)) / 2, 0) + 1, len(ms)) AS INTEGER)] AS slope_upper
FROM s_ JOIN mk USING (series_id) JOIN so USING (series_id) JOIN ic USING (series_id)""")
def theil_sen(spark, folder):
    """Theil-Sen slope with interval."""
    return tr.theil_sen(monthly_flow(spark, folder), "value")


@query("trend_lines", "series_id:s year:i model:s fitted:f6",
       sql.with_(sql.SUPP, MONTHLY, OLS, PAIRS, """ic AS (SELECT mon.series_id, quantile_cont(value - slope * year, 0.5) AS i2
  FROM mon JOIN s_ USING (series_id) GROUP BY 1)""")
       + """SELECT mon.series_id, year, 'ols' AS model, intercept + slope * year AS fitted FROM mon JOIN lin USING (series_id)
UNION ALL SELECT mon.series_id, year, 'sen', i2 + slope * year FROM mon JOIN s_ USING (series_id) JOIN ic USING (series_id)""")
def trend_lines(spark, folder):
    """Least squares and Theil-Sen lines."""
    return tr.trend_lines(monthly_flow(spark, folder), "value")


def _chow(slope: bool) -> str:
    k = 2 if slope else 1

    def rss(p: str) -> str:
        base = f"({p}vv - {p}v * {p}v / {p}n)"
        if not slope:
            return base
        return (f"({base} - pow({p}uv - {p}u * {p}v / {p}n, 2) / ({p}uu - {p}u * {p}u / {p}n))")

    moments = {"n": "1", "u": "u", "v": "v", "uu": "u * u", "uv": "u * v", "vv": "v * v"}
    left = ", ".join(f"sum({e}) OVER w AS l{m}" for m, e in moments.items())
    total = ", ".join(f"sum({e}) OVER p AS t{m}" for m, e in moments.items())
    right = ", ".join(f"t{m} - l{m} AS r{m}" for m in moments)
    return f"""cen AS (SELECT series_id, year, year - avg(year) OVER q AS u, value - avg(value) OVER q AS v FROM mon
  WINDOW q AS (PARTITION BY series_id)),
cum AS (SELECT series_id, year, {left}, {total} FROM cen WINDOW w AS (PARTITION BY series_id ORDER BY year),
  p AS (PARTITION BY series_id)),
both_ AS (SELECT *, {right} FROM cum),
cand AS (SELECT series_id, year, ln AS i, tn AS n, {rss('t')} AS rss0, {rss('l')} + {rss('r')} AS rss1 FROM both_
  WHERE ln >= greatest(floor(tn * 0.15), {k + 1}) AND ln <= least(tn - floor(tn * 0.15), tn - {k + 1})),
chow AS (SELECT *, (rss0 - rss1) / (rss1 / (n - {2 * k})) AS f FROM cand)"""


@query("chow_candidates", "series_id:s break_after:i i:i rss0:f4 rss1:f4 f:f6",
       sql.with_(sql.SUPP, MONTHLY, _chow(False)) + "SELECT series_id, year AS break_after, i, rss0, rss1, f FROM chow")
def chow_candidates(spark, folder):
    """F statistic of a shift in the mean after every candidate month."""
    return tr.chow_candidates(monthly_flow(spark, folder), "value")


@query("structural_change", "series_id:s model:s sup_f:f6 break_after:i",
       "WITH " + sql.SUPP + ", " + MONTHLY + ", " + _chow(False) + ", "
       + _chow(True).replace("cen AS", "cen2 AS").replace("FROM cen ", "FROM cen2 ").replace("cum AS", "cum2 AS")
       .replace("FROM cum)", "FROM cum2)").replace("both_ AS", "both2 AS").replace("FROM both_", "FROM both2")
       .replace("cand AS", "cand2 AS").replace("FROM cand)", "FROM cand2)").replace("chow AS", "chow2 AS")
       + """ SELECT series_id, 'mean' AS model, max(f) AS sup_f, arg_min(year, (-f, i)) AS break_after FROM chow GROUP BY 1
UNION ALL SELECT series_id, 'trend', max(f), arg_min(year, (-f, i)) FROM chow2 GROUP BY 1""")
def structural_change(spark, folder):
    """Largest F statistic for a break in the mean and in the trend."""
    flows = monthly_flow(spark, folder)
    parts = [tr.sup_f(flows, "value", slope=slope).withColumn("model", F.lit(name))
             for name, slope in (("mean", False), ("trend", True))]
    return parts[0].unionByName(parts[1])


@query("nested_model_test", "series_id:s rss0:f4 rss1:f4 df2:i f:f6 p_value:f6",
       sql.with_(sql.SUPP, MONTHLY, _chow(False), """best AS (SELECT series_id, max(f) AS f, arg_max(rss0, f) AS rss0,
  arg_max(rss1, f) AS rss1, max(n) - 2 AS df2 FROM chow GROUP BY 1)""")
       + f"SELECT *, {sql.t_pvalue('sqrt(f)', 'df2')} AS p_value FROM best")
def nested_model_test(spark, folder):
    """F test of the best single break against no break."""
    return tr.nested_anova(tr.sup_f(monthly_flow(spark, folder), "value"))


def _segmentations(slope: bool) -> str:
    """Least residual sum of squares and its breaks for m = 0..5, by adding one segment at a time."""
    k = 2 if slope else 1
    length, u, v = "(b.i - a.i)", "(b.u - a.u)", "(b.v - a.v)"
    rss = f"((b.vv - a.vv) - {v} * {v} / {length})"
    if slope:
        xx = f"((b.uu - a.uu) - {u} * {u} / {length})"
        rss = f"({rss} - CASE WHEN {xx} > 1e-12 THEN pow((b.uv - a.uv) - {u} * {v} / {length}, 2) / {xx} ELSE 0 END)"
    steps = ["d0 AS (SELECT series_id, n, j, rss, CAST([] AS BIGINT[]) AS breaks FROM seg WHERE i = 0)"]
    for m in range(1, 6):
        steps.append(f"""d{m} AS (SELECT s.series_id, max(s.n) AS n, s.j, min(d.rss + s.rss) AS rss,
  arg_min(list_append(d.breaks, s.year), d.rss + s.rss) AS breaks FROM d{m - 1} d JOIN seg s ON s.series_id = d.series_id AND s.i = d.j GROUP BY s.series_id, s.j)""")
    return f"""cen AS (SELECT series_id, year, row_number() OVER (PARTITION BY series_id ORDER BY year) AS i, count(*) OVER q AS n,
  year - avg(year) OVER q AS u, value - avg(value) OVER q AS v FROM mon WINDOW q AS (PARTITION BY series_id)),
cum AS (SELECT series_id, year, i, n, sum(u) OVER w AS u, sum(v) OVER w AS v, sum(u * u) OVER w AS uu, sum(u * v) OVER w AS uv, sum(v * v) OVER w AS vv
  FROM cen WHERE n > {k + 1} WINDOW w AS (PARTITION BY series_id ORDER BY i)
  UNION ALL SELECT DISTINCT series_id, NULL, 0, n, 0, 0, 0, 0, 0 FROM cen WHERE n > {k + 1}),
seg AS (SELECT a.series_id, a.n, a.i, b.i AS j, a.year, greatest({rss}, 0) AS rss FROM cum a JOIN cum b ON a.series_id = b.series_id
  WHERE b.i - a.i >= greatest(floor(a.n * 0.15), {k + 1}) OR (a.i = 0 AND b.i = b.n)),
{", ".join(steps)},
best AS ({" UNION ALL ".join(f"SELECT series_id, n, {m} AS m, rss, breaks FROM d{m} WHERE j = n" for m in range(6))}),
bics AS (SELECT *, CASE WHEN rss > 0 THEN n * (ln(2 * pi()) + 1 + ln(rss / n)) + {k + 1} * (m + 1) * ln(n) END AS bic FROM best)"""


@query("structural_breaks", "series_id:s m:i rss:f4 bic:f4 breaks:s",
       sql.with_(sql.SUPP, MONTHLY, _segmentations(False)) + "SELECT series_id, m, rss, bic, array_to_string(breaks, ',') AS breaks FROM bics")
def structural_breaks(spark, folder):
    """Best positions of up to five breaks in the mean, and where they are."""
    found = tr.breakpoints(monthly_flow(spark, folder), "value")
    return found.withColumn("breaks", F.array_join(F.col("breaks").cast("array<string>"), ","))


@query("mean_breaks", "series_id:s m:i rss:f4 bic:f4",
       sql.with_(sql.SUPP, MONTHLY, _segmentations(False)) + "SELECT series_id, m, rss, bic FROM bics")
def mean_breaks(spark, folder):
    """Best positions of up to five breaks in the mean."""
    return tr.breakpoints(monthly_flow(spark, folder), "value")


@query("trend_breaks", "series_id:s m:i rss:f4 bic:f4",
       sql.with_(sql.SUPP, MONTHLY, _segmentations(True)) + "SELECT series_id, m, rss, bic FROM bics")
def trend_breaks(spark, folder):
    """Best positions of up to five breaks in the trend."""
    return tr.breakpoints(monthly_flow(spark, folder), "value", slope=True)


@query("trend_break_segments", "series_id:s year:i segment:i fitted:f4",
       sql.with_(sql.SUPP, MONTHLY, _segmentations(True), """b AS (SELECT series_id, arg_min(breaks, (bic, m)) AS breaks FROM bics WHERE bic IS NOT NULL GROUP BY 1),
s AS (SELECT mon.*, len(list_filter(breaks, lambda e: e < year)) + 1 AS segment FROM mon JOIN b USING (series_id)),
f AS (SELECT series_id, segment, avg(value) AS m, regr_slope(value, year - 24000) AS b1, regr_intercept(value, year - 24000) AS b0 FROM s GROUP BY 1, 2)""")
       + """SELECT series_id, year, segment, CASE WHEN isfinite(b1) THEN b0 + b1 * (year - 24000) ELSE m END AS fitted
FROM s JOIN f USING (series_id, segment)""")
def trend_break_segments(spark, folder):
    """Trend lines between the breaks of the segmentation with the smallest BIC among up to five breaks in the trend."""
    flows = monthly_flow(spark, folder)
    return tr.segment_fit(flows, tr.best_breaks(tr.breakpoints(flows, "value", slope=True)), "value", slope=True)


@query("break_segments", "series_id:s year:i segment:i fitted:f6",
       sql.with_(sql.SUPP, MONTHLY, _segmentations(False), """b AS (SELECT series_id, arg_min(breaks, (bic, m)) AS breaks FROM bics WHERE bic IS NOT NULL GROUP BY 1),
s AS (SELECT mon.*, len(list_filter(breaks, lambda e: e < year)) + 1 AS segment FROM mon JOIN b USING (series_id))""")
       + "SELECT series_id, year, segment, avg(value) OVER (PARTITION BY series_id, segment) AS fitted FROM s")
def break_segments(spark, folder):
    """Step model of the segmentation with the smallest BIC among up to five breaks."""
    flows = monthly_flow(spark, folder)
    return tr.segment_fit(flows, tr.best_breaks(tr.breakpoints(flows, "value")), "value")


@query("trend_segments", "series_id:s segment:i first_year:i last_year:i slope:f6 level:f4",
       sql.with_(sql.SUPP, MONTHLY, _segmentations(True), """b AS (SELECT series_id, arg_min(breaks, (bic, m)) AS breaks FROM bics WHERE bic IS NOT NULL GROUP BY 1),
s AS (SELECT mon.*, len(list_filter(breaks, lambda e: e < year)) + 1 AS segment FROM mon JOIN b USING (series_id)),
f AS (SELECT series_id, segment, min(year) AS first_year, max(year) AS last_year, avg(value) AS level, regr_slope(value, year - 24000) AS b1 FROM s GROUP BY 1, 2)""")
       + "SELECT series_id, segment, first_year, last_year, CASE WHEN isfinite(b1) THEN b1 ELSE 0 END AS slope, level FROM f")
def trend_segments(spark, folder):
    """The segments between the breaks of the best segmentation into trend lines: their years, slope and mean."""
    flows = monthly_flow(spark, folder)
    fitted = tr.segment_fit(flows, tr.best_breaks(tr.breakpoints(flows, "value", slope=True)), "value", slope=True)
    years = fitted.groupBy("series_id", "segment").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.avg("fitted").alias("level"),
        F.min_by("fitted", "year").alias("a"), F.max_by("fitted", "year").alias("b"))
    return years.withColumn("slope", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.col("last_year") - F.col("first_year")), F.lit(0.0)))


@query("break_intervals", "series_id:s break_after:i lower:i upper:i")
def break_intervals(spark, folder):
    """Confidence intervals of the break dates of the best segmentation."""
    flows = settle(monthly_flow(spark, folder))
    return tr.break_intervals(flows, tr.best_breaks(tr.breakpoints(flows, "value")), "value")


@query("trend_break_intervals", "series_id:s break_after:i lower:i upper:i")
def trend_break_intervals(spark, folder):
    """Confidence intervals of the break dates of the best segmentation into trend lines."""
    flows = settle(monthly_flow(spark, folder))
    return tr.break_intervals(flows, tr.best_breaks(tr.breakpoints(flows, "value", slope=True)), "value", slope=True)


# ---- dependence ------------------------------------------------------------------------------

COLUMNS = ["mean_flow", "Q50", "MAM1", "MAM10", "MAM30", "Q95", "Q90", "Q70", "ALPHA"]


def indices(spark, folder):
    """The index table; queries that need it several times write it once with ``settle``."""
    return idx.station_indices(series.by_series(
        series.supplier_daily(spark, folder), series.tasks_for(series.table(spark, folder, "lineitem"))))


_LONG = "lg AS (" + " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS index, round(\"{c}\", 9) AS value FROM ind" for c in COLUMNS) + ")"


@query("index_ranks", "series_id:s index:s value:f6 rank:i",
       sql.with_(*INDEX_CTES, _LONG) + """SELECT series_id, index, value, CASE WHEN value IS NOT NULL THEN
  rank() OVER (PARTITION BY series_id ORDER BY value NULLS LAST) END AS rank FROM lg""")
def index_ranks(spark, folder):
    """Ranks of the indices within each station (rounded, so that equal indices share a rank)."""
    table = indices(spark, folder).select("series_id", *[F.round(c, 9).alias(c) for c in COLUMNS])
    return tr.index_ranks(table, COLUMNS)


@query("pearson_matrix", "index:s index2:s pearson:f6 n:i t:f4 p_value:f6",
       sql.with_(*INDEX_CTES, _LONG, """cr AS (SELECT a.index, b.index AS index2, corr(a.value, b.value) AS pearson, count(*) AS n
  FROM lg a JOIN lg b ON a.series_id = b.series_id
  WHERE a.series_id NOT IN (SELECT series_id FROM lg WHERE value IS NULL) GROUP BY 1, 2),
tt AS (SELECT *, CASE WHEN index <> index2 THEN pearson * sqrt((n - 2) / (1 - pearson * pearson)) END AS t FROM cr)""")
       + f"""SELECT index, index2, pearson, n, t, CASE WHEN index = index2 THEN 0.0 ELSE {sql.t_pvalue('t', '(n - 2)')} END AS p_value FROM tt""")
def pearson_matrix(spark, folder):
    """Correlation matrix of the indices with its significance."""
    tested = tr.correlation_test(tr.pearson_matrix(indices(spark, folder), COLUMNS))
    same = F.col("index") == F.col("index2")
    return tested.withColumns({"t": F.when(~same, F.col("t")),
                               "p_value": F.when(same, 0.0).otherwise(F.col("p_value"))})


RANKED = list(COLUMNS)


@query("spearman_matrix", "index:s index2:s spearman:f6 n:i",
       sql.with_(*INDEX_CTES, "ok AS (SELECT * FROM ind WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in RANKED) + ")",
                 "rk AS (" + " UNION ALL ".join(
                     f"""SELECT series_id, '{c}' AS index, rank() OVER (ORDER BY round("{c}", 9)) + (count(*) OVER (PARTITION BY round("{c}", 9)) - 1) / 2 AS value FROM ok"""
                     for c in RANKED) + ")")
       + """SELECT a.index, b.index AS index2, corr(a.value, b.value) AS spearman, count(*) AS n
FROM rk a JOIN rk b USING (series_id) GROUP BY 1, 2""")
def spearman_matrix(spark, folder):
    """Rank correlation matrix of the indices (rounded, so that equal indices are equal in ranks)."""
    table = indices(spark, folder).select(*[F.round(c, 9).alias(c) for c in RANKED])
    return tr.spearman_matrix(table, RANKED)


@query("lineitem_rank_correlation", "index:s index2:s spearman:f6 n:i",
       """WITH rk AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS c FROM lineitem),
m AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc, count(*) AS n FROM rk)
SELECT 'l_quantity' AS index, 'l_quantity' AS index2, 1.0 AS spearman, n FROM m
UNION ALL SELECT 'l_discount', 'l_discount', 1.0, n FROM m UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0, n FROM m
UNION ALL SELECT 'l_quantity', 'l_discount', ab, n FROM m UNION ALL SELECT 'l_discount', 'l_quantity', ab, n FROM m
UNION ALL SELECT 'l_quantity', 'l_extendedprice', ac, n FROM m UNION ALL SELECT 'l_extendedprice', 'l_quantity', ac, n FROM m
UNION ALL SELECT 'l_discount', 'l_extendedprice', bc, n FROM m UNION ALL SELECT 'l_extendedprice', 'l_discount', bc, n FROM m""")
def lineitem_rank_correlation(spark, folder):
    """Rank correlation over one group holding every row."""
    return tr.spearman_matrix(series.table(spark, folder, "lineitem"),
                              ["l_quantity", "l_discount", "l_extendedprice"])


@query("index_zscores", "series_id:s " + " ".join(f"{c}:f6" for c in COLUMNS),
       sql.with_(*INDEX_CTES) + "SELECT series_id, " + ", ".join(f'("{c}" - avg("{c}") OVER ()) / stddev_samp("{c}") OVER () AS "{c}"' for c in COLUMNS) + " FROM ind")
def index_zscores(spark, folder):
    """All indices standardised."""
    return tr.zscores(settle(indices(spark, folder).select("series_id", *COLUMNS)), COLUMNS)


@query("pca_two_indices", "component:i variable:s loading:f6 sdev:f6 eigenvalue:f6 proportion:f6 cumulative:f6",
       sql.with_(*INDEX_CTES, 'r_ AS (SELECT corr(mean_flow, "MAM30") AS r FROM ind)',
                 """pc AS (SELECT 1 AS component, 1 + abs(r) AS e, sign(r) AS s FROM r_ UNION ALL SELECT 2, 1 - abs(r), -sign(r) FROM r_)""")
       + """SELECT component, variable, CASE WHEN variable = 'mean_flow' THEN sqrt(0.5) ELSE s * sqrt(0.5) END AS loading, sqrt(e) AS sdev,
  e AS eigenvalue, e / 2 AS proportion, CASE component WHEN 1 THEN e / 2 ELSE 1.0 END AS cumulative
FROM pc, (SELECT unnest(['mean_flow', 'MAM30']) AS variable)""")
def pca_two_indices(spark, folder):
    """Principal components of two indices, where the answer is known."""
    return tr.pca_loadings(indices(spark, folder), ["mean_flow", "MAM30"])


_P = len(COLUMNS)
_TURNS = [[p, q] for p in range(1, _P) for q in range(p + 1, _P + 1)]

# Eigenvectors by plane rotations: ten rounds over all pairs, with the unit matrix below the correlations.
JACOBI = f"""lo AS (SELECT series_id, unnest(range(1, {_P + 1})) AS i, unnest([{', '.join(f'"{c}"' for c in COLUMNS)}]) AS v FROM ind
  WHERE {' AND '.join(f'"{c}" IS NOT NULL' for c in COLUMNS)}),
rr AS (SELECT a.i, list(r ORDER BY a.j) AS r FROM (SELECT a.i, b.i AS j, corr(a.v, b.v) AS r FROM lo a JOIN lo b USING (series_id) GROUP BY 1, 2) a GROUP BY a.i
  UNION ALL SELECT {_P} + k, list_transform(range(1, {_P + 1}), lambda x: CASE WHEN x = k THEN 1.0 ELSE 0.0 END) FROM (SELECT unnest(range(1, {_P + 1})) AS k)),
ro AS (SELECT CAST(0 AS BIGINT) AS s, list(r ORDER BY i) AS m FROM rr UNION ALL
  SELECT s + 1, list_transform(m2, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda x, j: c * x - sn * m2[q][j]) WHEN i = q THEN list_transform(r, lambda x, j: sn * m2[p][j] + c * x) ELSE r END)
  FROM (SELECT s, p, q, c, sn, list_transform(m, lambda r: list_transform(r, lambda x, j: CASE WHEN j = p THEN c * r[p] - sn * r[q] WHEN j = q THEN sn * r[p] + c * r[q] ELSE x END)) AS m2
    FROM (SELECT s, m, p, q, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS sn FROM (SELECT s, m, p, q,
        CASE WHEN abs(m[p][q]) < 1e-300 THEN 0.0 ELSE (CASE WHEN m[q][q] >= m[p][p] THEN 1.0 ELSE -1.0 END) * sign(m[p][q])
          / (abs((m[q][q] - m[p][p]) / (2 * m[p][q])) + sqrt(1 + pow((m[q][q] - m[p][p]) / (2 * m[p][q]), 2))) END AS t
      FROM (SELECT s, m, {_TURNS}[s % {len(_TURNS)} + 1][1] AS p, {_TURNS}[s % {len(_TURNS)} + 1][2] AS q FROM ro WHERE s < {10 * len(_TURNS)}))))),
ev AS (SELECT k, greatest(m[k][k], 0) AS e, m, row_number() OVER (ORDER BY m[k][k] DESC) AS component FROM (SELECT m, unnest(range(1, {_P + 1})) AS k FROM ro WHERE s = {10 * len(_TURNS)})),
ld AS (SELECT component, e, i, m[{_P} + i][k] AS v FROM ev, (SELECT unnest(range(1, {_P + 1})) AS i)),
sg AS (SELECT component, CASE WHEN arg_max(v, (round(abs(v), 10), -i)) < 0 THEN -1 ELSE 1 END AS g FROM ld GROUP BY 1)"""


@query("pca_loadings", "component:i variable:s loading:f6 sdev:f6 proportion:f6 cumulative:f6",
       sql.with_(*INDEX_CTES, JACOBI).replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT component, {COLUMNS}[i] AS variable, CASE WHEN sqrt(e) > 1e-6 THEN g * v END AS loading, sqrt(e) AS sdev, e / t AS proportion,
  (SELECT sum(e) FROM ev x WHERE x.component <= ld.component) / t AS cumulative FROM ld JOIN sg USING (component), (SELECT sum(e) AS t FROM ev)""")
def pca_loadings(spark, folder):
    """Principal components of all indices; one without variance, as with fewer stations than indices, has no direction."""
    found = tr.pca_loadings(indices(spark, folder), COLUMNS)
    return found.withColumn("loading", F.when(F.col("sdev") > 1e-6, F.col("loading")))


@query("pca_scores", "series_id:s PC1:f6 PC2:f6",
       sql.with_(*INDEX_CTES, """z AS (SELECT series_id, (mean_flow - avg(mean_flow) OVER ()) / stddev_samp(mean_flow) OVER () AS a,
  ("MAM30" - avg("MAM30") OVER ()) / stddev_samp("MAM30") OVER () AS b FROM ind),
s_ AS (SELECT sign(corr(a, b)) AS s FROM z)""")
       + """SELECT series_id, sqrt(0.5) * (a + s * b) AS "PC1", sqrt(0.5) * (a - s * b) AS "PC2" FROM z, s_""")
def pca_scores(spark, folder):
    """Scores of the stations on two components."""
    table = settle(indices(spark, folder).select("series_id", "mean_flow", "MAM30"))
    return tr.pca_scores(table, ["mean_flow", "MAM30"], tr.pca_loadings(table, ["mean_flow", "MAM30"]))
