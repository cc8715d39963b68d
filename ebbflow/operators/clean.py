"""Cleaning, gap filling and completeness of daily series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ebbflow.columns import KEY, TIME, VALUE, by_key, finite, in_time, so_far
from ebbflow.functions.calendar import days_in_year, water_year
from ebbflow.operators.windows import fill_gaps, with_run_id
from ebbflow.session import settle

# Fixed value: square root of the double precision epsilon; smaller magnitudes count as zero.
ZERO_TOLERANCE = 1.4901161193847656e-08


@dataclass(frozen=True)
class Sanitized:
    """Cleaned series and the log of what was found on the way."""

    series: DataFrame
    log: DataFrame


def add_missing_days(df: DataFrame, key: str = KEY, time: str = TIME, value: str = VALUE,
                     whole_span: bool = False, fill: float | None = None,
                     only_added: bool = False) -> DataFrame:
    """Make implicit gaps explicit: one row per day between the first and last day.

    Each row emits itself and the days up to its successor, so no calendar is joined.  With
    ``whole_span`` every series covers the period of the whole table; ``only_added`` returns the new
    rows alone.  The input has at most one row per series and day.
    """
    w = in_time(key, time)
    until = F.coalesce(F.date_sub(F.lead(time).over(w), 1), F.col(time))
    since = F.col(time)
    if whole_span:
        span = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        df = df.withColumn("_span", span.select(F.struct("lo", "hi")).scalar())  # one subquery for both ends
        df = df.withColumns({"_first": F.row_number().over(w) == 1, "_lo": F.col("_span.lo"), "_hi": F.col("_span.hi")})
        until = F.coalesce(F.date_sub(F.lead(time).over(w), 1), F.col("_hi"))
        since = F.when(F.col("_first"), F.col("_lo")).otherwise(F.col(time))
    df = df.withColumns({"_since": since, "_until": until})
    days = F.explode(F.sequence("_since", "_until")).alias("_day")
    filler = F.lit(fill).cast("double")
    rows = df.select(key, F.col(time).alias("_at"), F.col(value).alias("_v"), days)
    if only_added:
        rows = rows.where(F.col("_day") != F.col("_at"))
    return (rows.select(key, F.col("_day").alias(time),
                    F.when(F.col("_day") == F.col("_at"), F.col("_v")).otherwise(filler).alias(value)))


def sanitize_ts(df: DataFrame, ordinal: str, key: str = KEY, time: str = TIME, value: str = VALUE,
                force_positive: bool = False, remove_duplicates: bool = True,
                add_implicit_na: bool = True, approx_missing: int = 0) -> Sanitized:
    """Clean raw observations and log every finding per series.

    ``ordinal`` gives the input order (files have none once read in parallel).  Raw rows are reduced
    by ``(series, day, value)`` and then ``(series, day)`` with map-side partial aggregation, so a
    series with a large share of the rows spreads over all tasks; only daily rows reach the windows.
    """
    if approx_missing and not remove_duplicates:
        raise ValueError("interpolation needs one value per day: remove duplicates first")
    raw = df.select(F.col(key).alias(KEY), F.col(time).cast("date").alias(TIME),
                    F.col(value).cast("double").alias(VALUE), F.col(ordinal).alias("_ord"))
    v = F.col(VALUE)
    raw = raw.withColumn("_bad", v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clean = finite(VALUE)
    if force_positive:
        clean = F.when(finite(VALUE) >= 0, finite(VALUE))

    # distinct records, with everything the log needs about the raw rows behind them
    records = (raw.withColumn("_clean", clean)
               .groupBy(KEY, TIME, "_clean")
               .agg(F.min("_ord").alias("_ord"), F.count(F.lit(1)).alias("_n"),
                    F.count_if("_bad").alias("_missing"),
                    F.count_if(~F.col("_bad") & (v < 0)).alias("_negative"),
                    F.count_if(~F.col("_bad") & (F.abs(v) < ZERO_TOLERANCE)
                               & F.col("_clean").isNotNull()).alias("_zero")))
    records = records.withColumn("_no_time", F.col(TIME).isNull())
    days = (records.groupBy(KEY, TIME)
            .agg(F.min(F.struct("_ord", "_clean"))["_clean"].alias(VALUE),
                 F.min("_ord").alias("_ord"),
                 F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_records"),
                 F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_identical"),
                 F.sum("_missing").alias("_missing"), F.sum("_negative").alias("_negative"),
                 F.sum("_zero").alias("_zero")))
    dated = days.where(F.col(TIME).isNotNull())
    kept = dated if remove_duplicates else \
        records.where(~F.col("_no_time")).select(KEY, TIME, F.col("_clean").alias(VALUE), "_ord")

    series = kept.select(KEY, TIME, VALUE)
    if add_implicit_na and remove_duplicates:
        series = add_missing_days(series)
    elif add_implicit_na:
        # the gaps follow from the days; repeated records never meet in one window group
        series = series.unionByName(add_missing_days(dated.select(KEY, TIME, VALUE), only_added=True))
    if approx_missing:
        series = fill_gaps(series, approx_missing, flag="filled")
    written = series.groupBy(KEY).agg(
        (F.count_if("filled") if approx_missing else F.lit(0).cast("bigint")).alias("n_filled"),
        F.count(F.lit(1)).alias("n_out"))

    # everything else about a series in one pass over its days (an undated row, if any, is one more)
    w = in_time()
    gap = F.datediff(F.lead(TIME).over(w), F.col(TIME)) - 1
    has_day, many = F.col(TIME).isNotNull(), F.col("_records") > 1

    def total(column: str, condition: Column = F.lit(True)) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    wide = days.withColumns({"_gap": F.greatest(gap, F.lit(0)),
                             "_past": F.col(TIME) < F.max(TIME).over(_previous_day())}).groupBy(KEY).agg(
        total("_n").alias("n_in"), total("_missing").alias("n_missing"),
        total("_negative").alias("n_negative"), total("_zero").alias("n_zero"),
        total("_n", ~has_day).alias("n_no_time"), total("_identical", has_day).alias("n_identical"),
        total("_records", has_day & many).alias("n_duplicate"),
        (F.count_if(has_day) if remove_duplicates else total("_records", has_day)).alias("n_kept"),
        F.coalesce(F.sum("_gap"), F.lit(0)).alias("n_gap_days"), F.count_if("_past").alias("n_past"))
    if not remove_duplicates:
        wide = wide.drop("n_past").join(_jumps(kept), KEY)
    wide = wide.join(written, KEY)
    dated_rows = F.col("n_in") - F.col("n_no_time")
    findings = [
        ("no value", "n_missing", "", F.col("n_in")),
        ("negative", "n_negative", "nullified" if force_positive else "", F.col("n_in")),
        ("zero", "n_zero", "", F.col("n_in")),
        ("undated", "n_no_time", "removed", dated_rows),
        ("identical rows", "n_identical", "removed", dated_rows),
        ("day repeated", "n_duplicate",
         "first kept" if remove_duplicates else "", F.col("n_kept")),
        ("out of order", "n_past", "sorted", F.col("n_kept")),
        ("days absent", "n_gap_days",
         "days added" if add_implicit_na else "", F.col("n_out")),
        ("gap filled", "n_filled", "interpolated", F.col("n_out")),
    ]
    entries = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(what).alias("what"), F.col(n).cast("bigint").alias("n"),
                 F.lit(action).alias("action"), total.cast("bigint").alias("n_total"))
        for i, (what, n, action, total) in enumerate(findings, 1)])
    log = (wide.select(KEY, "n_in", "n_out", F.explode(entries).alias("e"))
           .where(F.col("e.n") > 0)
           .select(KEY, "e.step", "e.what", "e.n", "e.action", "e.n_total",
                   (F.col("e.n") / F.col("n_out") * 100).alias("percent_of_output"),
                   "n_in", "n_out"))
    series = series.select(F.col(KEY).alias(key), F.col(TIME).alias(time), F.col(VALUE).alias(value),
                           *(["filled"] if approx_missing else []))
    return Sanitized(series, log)


def sanitize_findings(df: DataFrame, ordinal: str, key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """The rows and gaps behind the entries of the log: ``series_id, step, what, gap, first_day, last_day, value, n``.

    Steps and names are those of :func:`sanitize_ts`.  A finding about rows has their day (twice), their value as it came and
    how many of them are alike; one about absent days has the number of the gap within its series, its first and last day
    and its length.  A row can be behind several findings.  Equal rows are counted before any shuffle, and the rows of a day meet
    their day in a join, so neither a series nor a day is gathered; only days, bounded by the calendar, are put in order.
    """
    raw = df.select(F.col(key).alias(KEY), F.col(time).cast("date").alias(TIME), F.col(value).cast("double").alias(VALUE), F.col(ordinal).alias("_ord"))
    rows = settle(raw.groupBy(KEY, TIME, VALUE).agg(F.min("_ord").alias("_ord"), F.count(F.lit(1)).alias("n")))
    v, day = F.col(VALUE), F.col(TIME)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    days = rows.where(day.isNotNull()).groupBy(KEY, TIME).agg(F.min(F.struct("_ord", VALUE)).alias("_first"), F.count(F.lit(1)).alias("_records"))
    w = in_time()
    input_order = Window.partitionBy(KEY).orderBy("_first._ord")
    days = days.withColumns({"_past": day < F.lag(TIME).over(input_order), "_next": F.lead(TIME).over(w)})
    days = days.withColumn("_gap", F.datediff("_next", TIME) - 1).withColumn("gap", F.sum(F.when(F.col("_gap") > 0, 1).otherwise(0)).over(so_far(w)))

    def found(of: DataFrame, cases: list[tuple[int, str, Column]], **columns: Column) -> DataFrame:
        hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(step).alias("step"), F.lit(what).alias("what"))) for step, what, c in cases]), lambda x: x.isNotNull())
        return of.withColumn("_hit", F.explode(hits)).select(KEY, "_hit.step", "_hit.what", *[c.alias(n) for n, c in columns.items()])

    many = days.where(F.col("_records") > 1).select(KEY, TIME, F.lit(True).alias("_many"))
    one = {"gap": F.lit(None).cast("long"), "first_day": day, "last_day": day, "value": v, "n": F.col("n")}
    by_row = found(rows.join(many, [KEY, TIME], "left"), [
        (1, "no value", bad), (2, "negative", ~bad & (v < 0)), (3, "zero", ~bad & (F.abs(v) < ZERO_TOLERANCE)), (4, "undated", day.isNull()),
        (5, "identical rows", day.isNotNull() & (F.col("n") > 1)), (6, "day repeated", F.col("_many").isNotNull())], **one)
    by_day = found(days, [(7, "out of order", F.col("_past"))], **one | {"value": F.col(f"_first.{VALUE}"), "n": F.lit(1).cast("long")})
    gaps = found(days, [(8, "days absent", F.col("_gap") > 0)], gap=F.col("gap"), first_day=F.date_add(TIME, 1), last_day=F.date_sub("_next", 1),
                 value=F.lit(None).cast("double"), n=F.col("_gap").cast("long"))
    return by_row.unionByName(by_day).unionByName(gaps)


def _previous_day() -> WindowSpec:
    """The dated row just before the current one in input order (days of one series only)."""
    return Window.partitionBy(KEY, F.col(TIME).isNull()).orderBy("_ord").rowsBetween(-1, -1)


def _jumps(records: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Records dated before their predecessor in input order.

    The ordinal is cut into chunks: neighbours inside a chunk are compared in one task per chunk, and
    only the chunk edges are compared in order.
    """
    part = Window.partitionBy(KEY, "_chunk").orderBy("_ord")
    records = records.withColumn("_chunk", F.floor(F.col("_ord") / chunk))
    inner = records.withColumn("_past", F.col(TIME) < F.lag(TIME).over(part))
    chunks = inner.groupBy(KEY, "_chunk").agg(
        F.count_if("_past").alias("_n"), F.min_by(TIME, "_ord").alias("_first"),
        F.max_by(TIME, "_ord").alias("_last"))
    edge = F.col("_first") < F.lag("_last").over(Window.partitionBy(KEY).orderBy("_chunk"))
    return chunks.withColumn("_edge", edge).groupBy(KEY).agg(
        (F.sum("_n") + F.count_if("_edge")).alias("n_past"))


def guess_step(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Regular time step per series: smallest of day, month, year that is constant; NULL if none."""
    w = in_time(key, time)
    steps = df.withColumns({
        "_days": F.datediff(F.col(time), F.lag(time).over(w)),
        "_months": F.months_between(F.col(time), F.lag(time).over(w), roundOff=False)})
    one = steps.groupBy(key).agg(F.min("_days").alias("d0"), F.max("_days").alias("d1"),
                                 F.min("_months").alias("m0"), F.max("_months").alias("m1"))
    whole = (F.col("m0") == F.col("m1")) & (F.col("m0") == F.floor("m0"))
    unit = (F.when(F.col("d0") == F.col("d1"), "day")
            .when(whole & (F.col("m0") % 12 == 0), "year").when(whole, "month"))
    size = (F.when(F.col("d0") == F.col("d1"), F.col("d0"))
            .when(whole & (F.col("m0") % 12 == 0), F.col("m0") / 12).when(whole, F.col("m0")))
    return one.select(key, unit.alias("unit"), size.cast("int").alias("step"))


def coverage_yearly(df: DataFrame, origin: str = "-01-01", key: str = KEY, time: str = TIME,
                    value: str = VALUE) -> DataFrame:
    """Days with a value per hydrological year."""
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(key, water_year(F.col(time), origin).alias("year"))
               .agg(F.count(F.lit(1)).alias("days_with_data")))
    total = days_in_year(F.col("year"), origin)
    return counted.select(
        key, "year", total.alias("days_in_year"), F.col("days_with_data").cast("int"),
        (total - F.col("days_with_data")).cast("int").alias("days_missing"),
        (F.col("days_with_data") / total).alias("coverage"))


def remove_incomplete_first_last(df: DataFrame, percent: float = 0.99, origin: str = "-01-01",
                                 key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """Drop the first and last year of a series if less than ``percent`` of their days have a value."""
    columns = df.columns
    df = df.withColumn("_year", water_year(F.col(time), origin))
    per_year = Window.partitionBy(key, "_year")
    df = df.withColumns({"_have": F.count(value).over(per_year),
                         "_first": F.min("_year").over(by_key(key)),
                         "_last": F.max("_year").over(by_key(key))})
    inner = (F.col("_first") < F.col("_year")) & (F.col("_year") < F.col("_last"))
    enough = F.col("_have") / days_in_year(F.col("_year"), origin) >= percent
    return df.where(inner | enough).select(*columns)


def drop_incomplete_years(df: DataFrame, origin: str = "-01-01", key: str = KEY, time: str = TIME,
                          value: str = VALUE) -> DataFrame:
    """Keep only hydrological years in which every day has a value; adds ``year``.

    The count is taken over the same partitioning later windows use, instead of joining a coverage
    table back.
    """
    columns = [c for c in df.columns if c != "year"]
    df = df.withColumn("year", water_year(F.col(time), origin))
    df = df.withColumn("_have", F.count(value).over(Window.partitionBy(key, "year")))
    return df.where(F.col("_have") >= days_in_year(F.col("year"), origin)).select(*columns, "year")


def treat_missing_values(df: DataFrame, na: str = "none", key: str = KEY, time: str = TIME,
                         value: str = VALUE, levels: tuple[str, ...] = ("year", "minor", "group")
                         ) -> DataFrame:
    """Missing-value policy ahead of the spell statistics.

    ``none`` keeps NULL days, ``fill`` carries the last value forward, ``drop_year``, ``drop_minor``
    and ``drop_group`` remove every day of a level that contains a NULL.
    """
    if na == "none":
        return df
    if na == "fill":
        return df.withColumn(value, F.last(value, True).over(
            in_time(key, time).rowsBetween(Window.unboundedPreceding, 0)))
    level = na.removeprefix("drop_")
    if level not in levels:
        raise ValueError(f"unknown missing-value policy {na!r}")
    missing = F.count_if(F.col(value).isNull()).over(Window.partitionBy(key, level))
    columns = df.columns
    return df.withColumn("_missing", missing).where("_missing = 0").select(*columns)


def gap_table(df: DataFrame, key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """One row per run of NULL days: start, end, days and running number."""
    runs = with_run_id(df, F.col(value).isNull(), "_run", key, time).where(F.col(value).isNull())
    table = runs.groupBy(key, "_run").agg(
        F.min(time).alias("gap_start"), F.max(time).alias("gap_end"),
        F.count(F.lit(1)).cast("int").alias("days"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_run"))
    return table.withColumn("gap_no", number).drop("_run")


def coverage_grid(df: DataFrame, origin: str = "-01-01", key: str = KEY, time: str = TIME,
                  value: str = VALUE) -> DataFrame:
    """Day-by-year availability of a series."""
    from ebbflow.functions.calendar import md_key

    return df.select(key, water_year(F.col(time), origin).alias("year"), md_key(F.col(time)).alias("md"),
                     F.when(F.col(value).isNull(), "data missing").otherwise("data available")
                     .alias("coverage"))


def complete_years(df: DataFrame, year: str = "year", key: str = KEY) -> DataFrame:
    """Add NULL rows for years missing between the first and last year of each series."""
    w = Window.partitionBy(key).orderBy(year)
    others = [c for c in df.columns if c not in (key, year)]
    upto = F.coalesce(F.lead(year).over(w) - 1, F.col(year))
    df = df.withColumn("_upto", upto)
    df = df.select("*", F.explode(F.sequence(F.col(year), F.col("_upto"))).alias("_y"))
    return df.select(key, F.col("_y").alias(year), *[
        F.when(F.col("_y") == F.col(year), F.col(c)).alias(c) for c in others])


def series_metadata(df: DataFrame, key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """Computed station attributes: first and last year, length in years, extreme and mean flow."""
    return df.groupBy(key).agg(
        F.year(F.min(time)).alias("start"), F.year(F.max(time)).alias("end"),
        (F.datediff(F.max(time), F.min(time)) / 365).alias("years"),
        F.min(value).alias("qmin"), F.avg(value).alias("qmean"), F.max(value).alias("qmax"))


def reconcile(computed: DataFrame, provided: DataFrame, metrics: list[str], key: str = KEY
              ) -> DataFrame:
    """Compare provided with computed attributes: one row per series and metric."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
            key, metrics, "metric", name)

    both = long(computed, "computed").join(long(provided, "provided"), [key, "metric"], "full")
    return both.withColumn("difference", F.col("computed") - F.col("provided"))


def season_filter(df: DataFrame, first: str, last: str, time: str = TIME) -> DataFrame:
    from ebbflow.functions.calendar import in_season

    return df.where(in_season(F.col(time), first, last))


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Select and rename in one step: ``pick(df, time="date", value="flow")``."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
