"""Default column names of the long observation table and small column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "series_id"
TIME = "time"
VALUE = "value"


def by_key(key: str = KEY) -> WindowSpec:
    """The whole series (unordered)."""
    return Window.partitionBy(key)


def in_time(key: str = KEY, time: str = TIME) -> WindowSpec:
    """One series in time order; every sequential operator shares this window, hence one sort."""
    return Window.partitionBy(key).orderBy(time)


def back_in_time(key: str = KEY, time: str = TIME) -> WindowSpec:
    """One series in reverse time order.

    "Next known value" is a running ``last`` over this window.  A forward window that looks at
    *all following* rows re-reads the rest of the partition for every row, so it is never used.
    """
    return Window.partitionBy(key).orderBy(F.col(time).desc())


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing-value marker used by the operators."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def with_columns(df: DataFrame, steps: Iterable[dict[str, Column]]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df
