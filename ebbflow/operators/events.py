"""Drought events, pooling, sequent peak, recession and base flow.

All sequential steps of one operator share the window ``(series, time)``: one shuffle by series.  A
daily series has at most one row per calendar day, which bounds the size of a window group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.columns import KEY, TIME, VALUE, back_in_time, by_key, in_time, so_far, with_columns
from ebbflow.operators.thresholds import Threshold
from ebbflow.operators.windows import moving_average, with_neighbours, with_run_id

SECONDS_PER_DAY = 86400.0


def _attach(df: DataFrame, threshold: float | str | Column | Threshold, key: str, time: str
            ) -> DataFrame:
    if isinstance(threshold, Threshold):
        return threshold.attach(df.drop("threshold"), key, time)
    if isinstance(threshold, (int, float)):
        return df.withColumn("threshold", F.lit(float(threshold)))
    return df.withColumn("threshold", F.col(threshold) if isinstance(threshold, str) else threshold)


def with_storage(df: DataFrame, name: str = "storage", key: str = KEY, time: str = TIME,
                 value: str = VALUE) -> DataFrame:
    """Sequent peak storage ``S[t] = max(0, S[t-1] + threshold - flow)``, reset by a NULL flow.

    The recurrence equals the running sum of the deficit minus its running minimum (at most zero),
    so two running aggregates on the same sort replace the loop.
    """
    w = in_time(key, time)
    deficit = F.col("threshold") - F.col(value)
    span = Window.partitionBy(key, "_span").orderBy(time)
    df = with_columns(df, [
        {"_deficit": deficit},
        {"_span": F.sum(F.col("_deficit").isNull().cast("int")).over(so_far(w))},
        {"_sum": F.sum("_deficit").over(so_far(span))},
        {"_low": F.least(F.lit(0.0), F.min("_sum").over(so_far(span)))},
        {name: F.when(F.col("_deficit").isNull(), 0.0).otherwise(F.col("_sum") - F.col("_low"))},
    ])
    return df.drop("_deficit", "_span", "_sum", "_low")


def drought_days(df: DataFrame, threshold: float | str | Column | Threshold, pooling: str = "none",
                 n: int = 10, sides: str = "center", key: str = KEY, time: str = TIME,
                 value: str = VALUE) -> DataFrame:
    """Daily drought state: threshold, deficit volume (m3), ``under_drought`` and event run id.

    Runs change whenever the state (drought, wet, missing) changes, so a NULL always ends an event.
    A day lasts until the next one; the last day of a series lasts as long as all others did or, if they
    differ, one day.
    """
    w = in_time(key, time)
    if pooling == "moving-average":
        df = df.withColumn(value, moving_average(F.col(value), n, sides, w))
    # sorted by day first: a threshold taken over the whole series then needs no sort of its own
    df = df.withColumns({"_step": F.datediff(F.col(time), F.lag(time).over(w)),
                         "_following": F.lead(time).over(w)})
    df = _attach(df, threshold, key, time)
    q, t = F.col(value), F.col("threshold")
    df = with_columns(df, [
        {"_low": F.min("_step").over(by_key(key)), "_high": F.max("_step").over(by_key(key))},
        {"end": F.coalesce("_following", F.when(F.col("_low") == F.col("_high"),
                                                F.date_add(F.col(time), F.col("_low"))),
                           F.date_add(F.col(time), 1))},
        {"volume": (t - q) * F.lit(SECONDS_PER_DAY) * F.datediff("end", time),
         "below_threshold": q < t},
    ])
    if pooling == "sequent-peak":
        df = with_storage(df, "storage", key, time, value)
        under = F.col("storage") > 0
    else:
        df = df.withColumn("storage", F.lit(0.0))
        under = F.col("below_threshold")
    df = df.withColumn("under_drought", under)
    state = F.when(q.isNull(), 2).otherwise(F.col("under_drought").cast("int"))
    return with_run_id(df.drop("_step", "_following", "_low", "_high"), state, "event", key, time)


def _relabel(events: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("first_day")
    return events.withColumn("event", F.row_number().over(order))


def drought_events(df: DataFrame, threshold: float | str | Column | Threshold, pooling: str = "none",
                   n: int = 10, sides: str = "center", min_duration: int = 5,
                   min_vol_ratio: float | None = None, full_table: bool = False, key: str = KEY,
                   time: str = TIME, value: str = VALUE) -> DataFrame:
    """Drought events below a threshold.

    ``pooling``: ``none``; ``moving-average`` smooths over ``n`` days first; ``inter-event`` merges
    droughts separated by fewer than ``min_duration`` days (and, if ``min_vol_ratio`` is given, by an
    excess volume smaller than that share of the preceding deficit); ``sequent-peak`` uses the
    storage of the sequent peak algorithm.
    """
    days = drought_days(df, threshold, pooling, n, sides, key, time, value)
    if pooling == "inter-event":
        # the excess volume and missing days since the previous drought, for the pooling decision
        w = so_far(in_time(key, time))
        wet = F.when(~F.col("under_drought"), -F.col("volume")).otherwise(0.0)
        days = days.withColumns({
            "_excess": F.sum(F.coalesce(wet, F.lit(0.0))).over(w),
            "_gaps": F.sum(F.col(value).isNull().cast("int")).over(w)})
    extra = ([F.min("_excess").alias("_excess"), F.min("_gaps").alias("_gaps")]
             if pooling == "inter-event" else [])
    events = (days.where("under_drought").where(F.col(value).isNotNull())
              .groupBy(key, "event")
              .agg(F.min(time).alias("first_day"), F.max("end").alias("_end"),
                   F.count(F.lit(1)).cast("int").alias("dbt"),
                   F.sum("volume").alias("volume"),
                   F.min(F.struct(F.col(value).alias("q"), F.col(time).alias("t"))).alias("_min"),
                   F.max(F.struct(F.col("storage").alias("s"), (-F.unix_date(F.col(time))).alias("t")))
                   .alias("_max"),
                   *extra))
    events = events.withColumns({
        "last_day": F.date_sub("_end", 1), "qmin": F.col("_min.q"), "tqmin": F.col("_min.t"),
        "v_smax": F.col("_max.s"),
        "d_smax": (-F.col("_max.t") - F.unix_date("first_day") + 1).cast("int")})
    events = events.withColumn("duration", F.datediff("last_day", "first_day") + 1)

    if pooling == "inter-event":
        pooled = _pool(events, min_duration, min_vol_ratio, key)
        return _relabel(pooled, key).select(
            key, "event", "first_day", "last_day", "duration", "dbt", "volume", "qmin", "tqmin",
            "pooled")
    events = _relabel(events, key)
    if full_table:
        return events.select(key, "event", "first_day", "last_day", "duration", "dbt", "volume", "qmin",
                             "tqmin", "v_smax", "d_smax")
    if pooling == "sequent-peak":
        return events.select(key, "event", "first_day", "last_day", F.col("d_smax").alias("duration"),
                             "dbt", F.col("v_smax").alias("volume"), "qmin", "tqmin")
    return events.select(key, "event", "first_day", "last_day", "duration", "volume", "qmin", "tqmin")


def _pool(events: DataFrame, min_duration: int, min_vol_ratio: float | None, key: str) -> DataFrame:
    """Merge neighbouring droughts: a running count of "starts a new pool" is the pool number."""
    w = Window.partitionBy(key).orderBy("first_day")
    events = events.withColumns({
        "_gap": F.datediff("first_day", F.lag("last_day").over(w)) - 1,
        "_void": F.col("_gaps") - F.lag("_gaps").over(w),
        "_wet": F.col("_excess") - F.lag("_excess").over(w)})
    joins = (F.col("_gap") < min_duration) & (F.col("_void") == 0)
    if min_vol_ratio is None:
        events = events.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
        events = events.withColumn("_pool", F.sum("_new").over(so_far(w)))
    else:
        events = _pool_by_volume(events.withColumn("_near", F.coalesce(joins, F.lit(False))),
                                 min_vol_ratio, key)
    return (events.groupBy(key, "_pool")
            .agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
                 F.sum("dbt").cast("int").alias("dbt"), F.sum("volume").alias("volume"),
                 F.min(F.struct("qmin", "tqmin")).alias("_min"),
                 (F.count(F.lit(1)) - 1).cast("int").alias("pooled"))
            .withColumns({"duration": F.datediff("last_day", "first_day") + 1,
                          "qmin": F.col("_min.qmin"), "tqmin": F.col("_min.tqmin")}))


def _pool_by_volume(events: DataFrame, ratio: float, key: str) -> DataFrame:
    """Pool number when the excess volume is compared with the deficit pooled *so far*.

    That total restarts with every pool, which no window expresses.  One scan a series, in order of time, holds the current
    pool's number and volume and nothing else; its work and memory follow the number of events.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("_pool", T.IntegerType())])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_day", kind="stable")
        near = pdf["_near"].to_numpy(bool)
        wet, volume = pdf["_wet"].to_numpy(float), pdf["volume"].to_numpy(float)
        pools, pool, held = np.empty(len(pdf), np.int32), 0, 0.0
        for i in range(len(pdf)):
            if pool and near[i] and wet[i] < ratio * held:  # false where the excess is missing
                held += volume[i]
            else:
                pool, held = pool + 1, volume[i]
            pools[i] = pool
        return pdf.assign(_pool=pools)

    return events.groupBy(key).applyInPandas(scan, schema)


def na_warnings(df: DataFrame, threshold: float | str | Column | Threshold, key: str = KEY,
                time: str = TIME, value: str = VALUE) -> DataFrame:
    """Days at or below the threshold next to a NULL day: missing values end these events early."""
    w = in_time(key, time)
    q = F.col(value)
    df = _attach(df, threshold, key, time).withColumns({
        "_before": F.lag(q.isNull()).over(w), "_after": F.lead(q.isNull()).over(w)})
    beside = F.coalesce("_before", F.lit(False)) | F.coalesce("_after", F.lit(False))
    return df.where(beside & q.isNotNull() & (q <= F.col("threshold"))).select(
        key, time, value, "threshold")


def deficit_band(days: DataFrame, key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """Lower and upper edge of the shaded deficit area."""
    return days.select(key, time, value, "threshold",
                       F.when(F.col("under_drought"), F.col(value)).otherwise(F.col("threshold"))
                       .alias("lwr"), F.col("threshold").alias("upr"))


def around_event(days: DataFrame, event: int | Column, margin: int = 1, key: str = KEY,
                 time: str = TIME) -> DataFrame:
    """Days of the chosen event run of each series and ``margin`` days either side."""
    hit = F.when(F.col("event") == event, F.col(time))
    columns = days.columns
    days = days.withColumns({"_from": F.min(hit).over(by_key(key)), "_to": F.max(hit).over(by_key(key))})
    return days.where(F.col(time).between(F.date_sub("_from", margin), F.date_add("_to", margin))
                      ).select(*columns)


def flag_minor(events: DataFrame, min_days: int = 5, min_share: float = 0.005, key: str = KEY
               ) -> DataFrame:
    """Mark events shorter than ``min_days`` or smaller than a share of the largest volume."""
    largest = F.max("volume").over(Window.partitionBy(key))
    return events.withColumn("_largest", largest).withColumn(
        "is_minor", (F.col("duration") < min_days) | (F.col("volume") < F.col("_largest") * min_share)
    ).drop("_largest")


# ---- base flow -----------------------------------------------------------------------------

def baseflow(df: DataFrame, tp_factor: float = 0.9, block_len: int = 5, key: str = KEY,
             time: str = TIME, value: str = VALUE) -> DataFrame:
    """Base flow by interpolation between turning points of block minima; adds ``baseflow``.

    Everything stays partitioned by series: one shuffle.  NULL before the first and after the last
    turning point.
    """
    w, back = in_time(key, time), back_in_time(key, time)
    block = Window.partitionBy(key, "_block")
    q, t = F.col(value), F.col(time)
    low = F.min(F.when(q.isNotNull(), F.struct(q.alias("q"), t.alias("t"))))
    df = with_columns(df, [
        {"_block": F.floor((F.row_number().over(w) - 1) / block_len)},
        {"_low": low.over(block), "_from": F.min(time).over(block), "_to": F.max(time).over(block)},
        # neighbours of a block: the last block end before it, the next block start after it
        {"_before": F.last(F.when(t == F.col("_to"), F.struct(F.col("_low.q").alias("q"))), True)
         .over(w.rowsBetween(Window.unboundedPreceding, -1))},
        {"_after": F.last(F.when(t == F.col("_from"), F.struct(F.col("_low.q").alias("q"))), True)
         .over(back.rowsBetween(Window.unboundedPreceding, -1))},
    ])
    reduced = F.lit(tp_factor) * q
    turning = ((t == F.col("_low.t")) & (reduced <= F.col("_before.q")) & (reduced <= F.col("_after.q")))
    df = df.withColumn("turning_point", F.coalesce(turning, F.lit(False)))
    day = F.unix_date(t)
    df = with_neighbours(df, day, F.when(F.col("turning_point"), q), key, time)
    span = F.col("_next.at") - F.col("_prev.at")
    line = F.when(span == 0, F.col("_prev.v")).otherwise(
        F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * (day - F.col("_prev.at")) / span)
    bounded = F.when(line.isNotNull() & q.isNotNull(), F.least(line, q))
    return df.withColumn("baseflow", bounded).drop(
        "_block", "_low", "_from", "_to", "_before", "_after", "_prev", "_next")


def baseflow_index(flows: DataFrame, by: list[Column | str], value: str = VALUE) -> DataFrame:
    """Volume of base flow and total flow (m3) and their ratio, over days with both."""
    both = flows.where(F.col("baseflow").isNotNull() & F.col(value).isNotNull())
    sums = both.groupBy(*by).agg((F.sum(value) * SECONDS_PER_DAY).alias("total"),
                                 (F.sum("baseflow") * SECONDS_PER_DAY).alias("baseflow"))
    return sums.withColumn("bfi", F.when(F.col("total") != 0, F.col("baseflow") / F.col("total")))


# ---- recession -----------------------------------------------------------------------------

def recession_days(df: DataFrame, smooth: int = 0, zeroslope: float = 0.0, minlen: int = 5,
                   qref: Column | None = None, key: str = KEY, time: str = TIME, value: str = VALUE
                   ) -> DataFrame:
    """Days in recession segments with their segment id and the following flow of the segment.

    A day belongs to a falling run if the flow does not rise towards the next day.  Rising runs of
    at most ``smooth`` days are bridged.  ``qref`` optionally restricts the days to flows at or below
    a reference.
    """
    from ebbflow.operators.windows import with_run_length

    w = in_time(key, time)
    slope = (F.lead(value).over(w) - F.col(value)) / F.datediff(F.lead(time).over(w), F.col(time))
    df = df.select(key, time, value, slope.alias("slope"), *([qref.alias("_qref")] if qref is not None
                                                            else []))
    df = df.withColumn("falling", F.col("slope") <= zeroslope)
    df = with_run_id(df, F.col("falling"), "_run", key, time)
    if smooth:
        df = with_run_length(df, "_run", "_len", key)
        df = df.withColumn("falling", F.when((~F.col("falling")) & (F.col("_len") <= smooth), True)
                           .otherwise(F.col("falling")))
        df = with_run_id(df, F.col("falling"), "_run", key, time)
    df = df.where("falling")
    if qref is not None:
        df = df.where(F.col(value) <= F.col("_qref"))
    segment = Window.partitionBy(key, "_run").orderBy(time)
    df = df.withColumns({"_size": F.count(F.lit(1)).over(Window.partitionBy(key, "_run")),
                         "day": F.row_number().over(segment),
                         "next_value": F.lead(value).over(segment)})
    return df.where(F.col("_size") >= minlen).select(
        key, F.col("_run").alias("event"), "day", time, value, "next_value")


def recession(df: DataFrame, smooth: int = 0, zeroslope: float = 0.0, minlen: int = 5,
              qref: Column | None = None, key: str = KEY, time: str = TIME, value: str = VALUE
              ) -> DataFrame:
    """Recession constant per series: slope ``k`` of flow on previous flow, and ``alpha = -ln k``."""
    pairs = recession_days(df, smooth, zeroslope, minlen, qref, key, time, value).where(
        F.col("next_value").isNotNull())
    q, q1 = F.col(value), F.col("next_value")
    fit = pairs.groupBy(key).agg(F.sum(q * q1).alias("_xy"), F.sum(q * q).alias("_xx"),
                                 F.max(q).alias("q0"), F.count(F.lit(1)).alias("pairs"))
    k = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx"))
    return fit.select(key, "pairs", "q0", k.alias("k"), F.when(k > 0, -F.log(k)).alias("alpha"))


def master_recession(df: DataFrame, smooth: int = 0, zeroslope: float = 0.0, minlen: int = 5,
                     key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """Points of the master recession curve: every segment shifted onto the common curve."""
    pairs = recession_days(df, smooth, zeroslope, minlen, None, key, time, value).where(
        F.col("next_value").isNotNull())
    whole, segment = Window.partitionBy(key), Window.partitionBy(key, "event")
    q, q1 = F.col(value), F.col("next_value")
    pairs = pairs.withColumns({
        "_k": F.try_divide(F.sum(q * q1).over(whole), F.sum(q * q).over(whole)), "_q0": F.max(q).over(whole),
        "_start": F.min_by(q, "day").over(segment)})
    shift = F.try_divide(F.log("_start") - F.log("_q0"), F.log("_k"))
    return pairs.withColumn("shift", shift).select(
        key, "event", "day", time, value, "shift", (F.col("day") + F.col("shift") - 1).alias("day_shifted"))
