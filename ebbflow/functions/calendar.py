"""Hydrological calendar as plain column expressions (all inside whole-stage code generation).

A month-day literal is written ``"-MM-DD"``.  Period origins must exist in every year, so
``"-02-29"`` is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days before each month in a leap year.
_DAYS_BEFORE_MONTH = (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)


def parse_origin(origin: str) -> tuple[int, int]:
    """``"-09-01"`` (or ``"1990-09-01"``) -> ``(9, 1)``; raises if it is not a date in normal years."""
    match = re.search(r"-(\d{2})-(\d{2})$", origin)
    if not match:
        raise ValueError(f"{origin!r} is not a month-day literal like '-09-01'")
    month, day = int(match[1]), int(match[2])
    normal_year = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    if not 1 <= month <= 12 or not 1 <= day <= normal_year[month - 1]:
        raise ValueError(f"{origin!r} does not exist in every year")
    return month, day


def md_key(time: Column) -> Column:
    """Month and day as the sortable integer ``MMDD``."""
    return F.month(time) * 100 + F.dayofmonth(time)


def month_day(time: Column) -> Column:
    """Month-day label ``-MM-DD``."""
    return F.concat(F.lit("-"), F.lpad(F.month(time).cast("string"), 2, "0"),
                    F.lit("-"), F.lpad(F.dayofmonth(time).cast("string"), 2, "0"))


def month_day_label(md: Column) -> Column:
    """``MMDD`` integer to ``-MM-DD``."""
    s = F.lpad(md.cast("string"), 4, "0")
    return F.concat(F.lit("-"), F.substring(s, 1, 2), F.lit("-"), F.substring(s, 3, 2))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _day_of_leap_year(time: Column) -> Column:
    after_gap = (~is_leap_year(F.year(time))) & (F.month(time) >= 3)
    return F.dayofyear(time) + after_gap.cast("int")


def month_day_number(time: Column, origin: str = "-01-01") -> Column:
    """Position 1..366 of a date in a 366-slot year starting at ``origin`` (Feb 29 has its own slot)."""
    month, day = parse_origin(origin)
    first = _DAYS_BEFORE_MONTH[month - 1] + day
    return F.pmod(_day_of_leap_year(time) - F.lit(first), F.lit(366)) + 1


def water_year(time: Column, origin: str | Sequence[str] = "-01-01") -> Column:
    """Calendar year in which the current hydrological year (or period) started."""
    starts = [origin] if isinstance(origin, str) else list(origin)
    first = min(m * 100 + d for m, d in map(parse_origin, starts))
    return F.year(time) - (md_key(time) < first).cast("int")


def period_start(time: Column, starts: Sequence[str] | Mapping[str, str]) -> Column:
    """Date of the latest period start not after ``time`` (possibly in the previous year)."""
    ordered = sorted(parse_origin(s) for s in _start_literals(starts))
    md = md_key(time)
    last_month, last_day = ordered[-1]
    result = F.make_date(F.year(time) - 1, F.lit(last_month), F.lit(last_day))
    for month, day in ordered:
        begin = F.make_date(F.year(time), F.lit(month), F.lit(day))
        result = F.when(md >= month * 100 + day, begin).otherwise(result)
    return result


def season(time: Column, starts: Sequence[str] | Mapping[str, str]) -> Column:
    """Season label: the mapping's name, or the ``-MM-DD`` literal of the season start."""
    return _by_season(time, starts, lambda name, position: F.lit(name))


def season_number(time: Column, starts: Sequence[str] | Mapping[str, str]) -> Column:
    """1-based position of the season in the order the starts were given."""
    return _by_season(time, starts, lambda name, position: F.lit(position))


def _start_literals(starts: Sequence[str] | Mapping[str, str]) -> list[str]:
    if isinstance(starts, str):
        return [starts]
    return list(starts.values()) if isinstance(starts, Mapping) else list(starts)


def _by_season(time: Column, starts, label) -> Column:
    literals = _start_literals(starts)
    names = list(starts) if isinstance(starts, Mapping) else literals
    table = sorted((parse_origin(literal), i) for i, literal in enumerate(literals))
    labels = [label(name, i + 1) for i, name in enumerate(names)]
    md = md_key(time)
    result = labels[table[-1][1]]
    for (month, day), i in table:
        result = F.when(md >= month * 100 + day, labels[i]).otherwise(result)
    return result


def week(time: Column) -> Column:
    """Complete seven-day periods since January 1st, plus one (not the ISO week)."""
    return (F.floor((F.dayofyear(time) - 1) / 7) + 1).cast("int")


def group_ts(time: Column, by: str = "day",
             origin: str | Sequence[str] | Mapping[str, str] = "-01-01") -> Column:
    """Period key of a date.

    ``day`` -> ``MMDD`` integer, ``week``/``month`` -> number in the calendar year (both ignore the
    origin), ``season`` -> label, ``year`` -> hydrological year.
    """
    if by == "day":
        return md_key(time)
    if by == "week":
        return week(time)
    if by == "month":
        return F.month(time)
    if by == "season":
        return season(time, origin)
    if by == "year":
        return water_year(time, _start_literals(origin))
    raise ValueError(f"unknown period {by!r}")


def in_season(time: Column, first: str, last: str) -> Column:
    """TRUE between two month-days (both inclusive), wrapping over the end of the year."""
    lo, hi = (m * 100 + d for m, d in (parse_origin(first), parse_origin(last)))
    md = md_key(time)
    return md.between(lo, hi) if lo < hi else (md >= lo) | (md <= hi)


def days_in_year(year: Column, origin: str = "-01-01") -> Column:
    month, day = parse_origin(origin)
    return F.datediff(F.make_date(year + 1, F.lit(month), F.lit(day)),
                      F.make_date(year, F.lit(month), F.lit(day)))


def day_of_normal_year(time: Column) -> Column:
    """Day of year 1..365; in leap years Feb 29 and later move back by one day."""
    day = F.dayofyear(time)
    return day - (is_leap_year(F.year(time)) & (day >= 60)).cast("int")


def month_name(time: Column) -> Column:
    return F.date_format(time, "MMMM")
