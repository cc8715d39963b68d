"""Window building blocks: moving averages, run ids, interpolation, peaks, exact ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ebbflow.columns import KEY, TIME, VALUE, back_in_time, by_key, in_time, so_far


def moving_average(value: Column, n: int, sides: str = "past",
                   window: WindowSpec | None = None) -> Column:
    """Mean of ``n`` values; NULL unless the window is complete and free of NULL.

    ``past`` ends at the current row, ``future`` starts there, ``center`` surrounds it (an even
    ``n`` leans one row to the future).
    """
    window = window or in_time()
    ahead = {"past": 0, "center": n // 2, "future": n - 1}[sides]
    frame = window.rowsBetween(ahead - (n - 1), ahead)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def changed(value: Column, window: WindowSpec) -> Column:
    """1 where the value differs from the previous row (NULL equals NULL); 0 on the first row."""
    first_row = F.row_number().over(window) == 1
    return F.when(first_row, 0).otherwise((~value.eqNullSafe(F.lag(value).over(window))).cast("int"))


def with_run_id(df: DataFrame, value: Column, name: str = "run", key: str = KEY,
                time: str = TIME) -> DataFrame:
    """Add a 0-based run id: constant while ``value`` stays constant, NULL being a value of its own."""
    w = in_time(key, time)
    return (df.withColumn("_change", changed(value, w))
            .withColumn(name, F.sum("_change").over(so_far(w)).cast("int"))
            .drop("_change"))


def with_step_id(df: DataFrame, x: Column, name: str = "run", step: float | None = None,
                 key: str = KEY, time: str = TIME) -> DataFrame:
    """Add a 1-based id, constant while ``x`` moves by a constant step (default: median step)."""
    w = in_time(key, time)
    df = df.withColumn("_step", x - F.lag(x).over(w))
    usual = F.lit(step) if step is not None else F.percentile("_step", F.lit(0.5)).over(by_key(key))
    df = df.withColumn("_usual", usual)
    jump = F.coalesce((F.col("_step") != F.col("_usual")).cast("int"), F.lit(0))
    return (df.withColumn("_jump", jump)
            .withColumn(name, (F.sum("_jump").over(so_far(w)) + 1).cast("int"))
            .drop("_step", "_usual", "_jump"))


def with_run_length(df: DataFrame, run: str = "run", name: str = "run_length",
                    key: str = KEY) -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key, run)).cast("int"))


def with_block(df: DataFrame, n: int, name: str = "block", key: str = KEY,
               time: str = TIME) -> DataFrame:
    """Consecutive blocks of ``n`` rows, numbered from 1."""
    pos = F.row_number().over(in_time(key, time))
    return df.withColumn(name, (F.floor((pos - 1) / n) + 1).cast("int"))


def with_neighbours(df: DataFrame, position: Column, value: Column, key: str = KEY,
                    time: str = TIME) -> DataFrame:
    """Add ``_prev`` and ``_next``: structs ``(at, v)`` of the nearest known value either side.

    One shuffle and two sorts; linear in the series length (see :func:`back_in_time`).
    """
    df = df.withColumn("_known", F.when(value.isNotNull(),
                                        F.struct(position.alias("at"), value.alias("v"))))
    return (df.withColumn("_prev", F.last("_known", True).over(so_far(in_time(key, time))))
            .withColumn("_next", F.last("_known", True).over(so_far(back_in_time(key, time))))
            .drop("_known"))


def _line(position: Column) -> Column:
    span = F.col("_next.at") - F.col("_prev.at")
    rise = F.col("_next.v") - F.col("_prev.v")
    return F.when(span == 0, F.col("_prev.v")).otherwise(
        F.col("_prev.v") + rise * (position - F.col("_prev.at")) / span)


def fill_gaps(df: DataFrame, max_len: int | None = None, key: str = KEY, time: str = TIME,
              value: str = VALUE, flag: str | None = None) -> DataFrame:
    """Linear interpolation inside runs of NULL no longer than ``max_len`` rows.

    Short runs at either end of a series are filled with the nearest known value.
    """
    order = [c for c in df.columns]
    df = df.withColumn("_pos", F.row_number().over(in_time(key, time)))
    df = df.withColumn("_n", F.count(F.lit(1)).over(by_key(key)))
    df = with_neighbours(df, F.col("_pos"), F.col(value), key, time)
    length = (F.coalesce(F.col("_next.at"), F.col("_n") + 1)
              - F.coalesce(F.col("_prev.at"), F.lit(0)) - 1)
    short = F.lit(True) if max_len is None else length <= max_len
    filled = F.coalesce(_line(F.col("_pos")), F.col("_prev.v"), F.col("_next.v"))
    todo = F.col(value).isNull() & short & filled.isNotNull()
    if flag:
        df = df.withColumn(flag, todo)
        order.append(flag)
    return df.withColumn(value, F.when(todo, filled).otherwise(F.col(value))).select(*order)


def approx_at(df: DataFrame, targets: DataFrame, key: str = KEY, time: str = TIME,
              value: str = VALUE) -> DataFrame:
    """Linear interpolation of each series at the target dates; NULL outside its range.

    ``targets`` holds ``key, time``.  Observations and targets are stacked and bracketed by window
    functions, so there is no range join.
    """
    known = df.where(F.col(value).isNotNull()).select(
        F.col(key), F.col(time), F.col(value), F.lit(False).alias("_target"))
    wanted = targets.select(F.col(key), F.col(time), F.lit(None).cast("double").alias(value),
                            F.lit(True).alias("_target"))
    day = F.unix_date(F.col(time))
    w = Window.partitionBy(key).orderBy(time, "_target")
    back = Window.partitionBy(key).orderBy(F.col(time).desc(), "_target")
    both = known.unionByName(wanted).withColumn(
        "_known", F.when(F.col(value).isNotNull(), F.struct(day.alias("at"), F.col(value).alias("v"))))
    return (both.withColumn("_prev", F.last("_known", True).over(so_far(w)))
            .withColumn("_next", F.last("_known", True).over(so_far(back)))
            .where("_target")
            .select(key, time, _line(day).alias(value)))


def is_peak(value: Column, half: int, window: WindowSpec | None = None) -> Column:
    """TRUE where the row is the maximum of ``2 * half + 1`` rows, ties going to the later row.

    The outermost ``half`` rows of a series are never peaks.
    """
    window = window or in_time()
    before, after = window.rowsBetween(-half, -1), window.rowsBetween(1, half)
    full = (F.count(value).over(before) == half) & (F.count(value).over(after) == half)
    return F.coalesce(full & (value >= F.max(value).over(before)) & (value > F.max(value).over(after)),
                      F.lit(False))


# ---- ranks and quantiles of groups of any size ----------------------------------------------

# Number of value buckets: a power of two, one more than the number of bucket bounds.
BUCKETS = 256


def _with_bucket(df: DataFrame, value: str, bounds: Column) -> DataFrame:
    """Number of sorted bounds below the value, by bisection in generated code."""
    df = df.withColumns({"_bounds": bounds, "_bucket": F.lit(0)})
    step = BUCKETS // 2
    while step:
        at = F.get("_bounds", F.col("_bucket") + (step - 1))
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(at < F.col(value), step).otherwise(0))
        step //= 2
    return df.drop("_bounds")


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with exact ranks: ``keys, value, n, rank_min, rank_avg, total``.

    Works for groups of any size, even one group holding most rows: equal values are counted before
    the shuffle, the distinct values are spread over (group, value bucket), and only bucket totals (at
    most ``BUCKETS`` rows per group) are summed in order.  The bucket bounds are quantiles of a sketch
    of all values.  A group with a third of all values has a third of the sketch, so its buckets stay
    small too; the bounds only steer the balance and do not affect the ranks.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("n")))
    bounds = counts.agg(F.percentile_approx(
        value, [i / BUCKETS for i in range(1, BUCKETS)], 4 * BUCKETS).alias("_bounds"))
    placed = _with_bucket(counts, value, bounds.scalar())
    bucket = Window.partitionBy(*keys, "_bucket")
    placed = placed.withColumn("_below", F.sum("n").over(so_far(bucket.orderBy(value))) - F.col("n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    sums = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_size"))
    sums = sums.select(*keys, "_bucket", F.sum("_size").over(whole).alias("total"),
                       (F.sum("_size").over(so_far(whole.orderBy("_bucket"))) - F.col("_size")).alias("_offset"))
    low = F.col("_offset") + F.col("_below") + 1
    return (placed.join(sums, [*keys, "_bucket"])
            .select(*keys, value, "n", low.alias("rank_min"),
                    (low + (F.col("n") - 1) / 2).alias("rank_avg"), "total"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Exact interpolated (type 7) quantiles of groups of any size, from :func:`ranked_values`."""
    ranked = ranked_values(df, keys, value)
    last = F.col("rank_min") + F.col("n") - 1

    def at(position: Column) -> Column:
        return F.max(F.when(position.between(F.col("rank_min"), last), F.col(value)))

    aggs = []
    for p, name in zip(probs, names, strict=True):
        h = (F.col("total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h) + 1).alias(f"_lo_{name}"), at(F.ceil(h) + 1).alias(f"_hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"_w_{name}")]
    wide = ranked.groupBy(*keys).agg(*aggs, F.max("total").alias("n"))
    return wide.select(*keys, "n", *[
        (F.col(f"_lo_{s}") + (F.col(f"_hi_{s}") - F.col(f"_lo_{s}")) * F.col(f"_w_{s}")).alias(s)
        for s in names])
