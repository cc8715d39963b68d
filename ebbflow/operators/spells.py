"""No-flow spells: the hierarchical spell statistic and the named intermittency indices."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.columns import KEY, TIME, VALUE
from ebbflow.functions.calendar import day_of_normal_year, month_day, water_year
from ebbflow.operators.clean import treat_missing_values
from ebbflow.operators.windows import with_run_id

STATES = ("no-flow", "flow", "no data")
LEVELS = ("spell", "group", "minor", "year", "state")


@dataclass(frozen=True)
class AggFun:
    """An aggregate over the rows of a level.

    ``fun`` returns an aggregate column; it may use ``value`` (the result of the level below),
    ``ord`` (first day of the row) and, on the first level, ``time`` and ``flow``.  ``default`` fills
    combinations of levels without any row.
    """

    fun: Callable[[], Column]
    default: object = None


def duration() -> dict[str, AggFun]:
    """Number of days."""
    return {"duration": AggFun(lambda: F.count("time"), 0)}


def over_value(name: str, fun: Callable[[Column], Column]) -> dict[str, AggFun]:
    return {name: AggFun(lambda: fun(F.col("value")))}


def first_value() -> dict[str, AggFun]:
    """The value of the earliest row."""
    return {"first": AggFun(lambda: F.min_by("value", "ord"))}


def classify(df: DataFrame, threshold: float = 0.001, year: Column | None = None,
             minor: Column | None = None, na: str = "none", key: str = KEY, time: str = TIME,
             value: str = VALUE) -> DataFrame:
    """Daily states with spell, group, minor period and year.

    ``spell`` numbers runs of equal state from 1; ``group`` numbers runs of (year, minor).
    """
    t = F.col(time)
    df = df.select(key, t.alias("time"), F.col(value).alias("flow"),
                   (year if year is not None else water_year(t)).alias("year"),
                   (minor if minor is not None else F.month(t)).alias("minor"))
    df = with_run_id(df, F.struct("year", "minor"), "group", key, "time")
    df = df.withColumn("group", F.col("group") + 1)
    df = treat_missing_values(df, na, key, "time", "flow")
    state = (F.when(F.col("flow").isNull(), STATES[2])
             .when(F.col("flow") <= threshold, STATES[0]).otherwise(STATES[1]))
    df = with_run_id(df.withColumn("state", state), F.col("state"), "spell", key, "time")
    return df.withColumn("spell", F.col("spell") + 1)


def allocate_spell(days: DataFrame, rule: str | Mapping[str, str] = "cut", key: str = KEY) -> DataFrame:
    """Assign spells that span several years, minor periods or groups.

    ``cut`` splits them at the boundary, ``onset`` / ``termination`` give the whole spell to its
    first / last period, ``majority`` to the period holding most of its days (the earlier one on a
    tie), and ``duplicate`` repeats the whole spell in each of its periods.
    """
    rules = {level: rule for level in ("year", "minor", "group")} if isinstance(rule, str) else rule
    for level in ("year", "minor", "group"):
        days = _allocate(days, rules.get(level, "cut"), level, key)
    return days


def _allocate(days: DataFrame, rule: str, level: str, key: str) -> DataFrame:
    spell = Window.partitionBy(key, "spell")
    if rule == "cut":
        return days
    if rule == "onset":
        return days.withColumn(level, F.min_by(level, "time").over(spell))
    if rule == "termination":
        return days.withColumn(level, F.max_by(level, "time").over(spell))
    part = Window.partitionBy(key, "spell", level)
    if rule == "majority":
        ranked = days.withColumns({"_n": F.count(F.lit(1)).over(part),
                                   "_first": F.min("time").over(part)})
        best = F.max_by(level, F.struct("_n", (-F.unix_date("_first")).alias("_first"))).over(spell)
        return ranked.withColumn(level, best).drop("_n", "_first")
    if rule == "duplicate":
        # the periods of a spell travel with the spell, so no self-join is needed
        levels = F.collect_set(level).over(spell)
        others = [c for c in days.columns if c != level]
        return (days.withColumn("_levels", levels)
                .select(*others, F.explode("_levels").alias(level)).select(*days.columns))
    raise ValueError(f"unknown rule {rule!r}")


def spell_metric(days: DataFrame, agg_spell: Mapping[str, AggFun] | None = None,
                 agg_group: Mapping[str, AggFun] | None = None,
                 agg_minor: Mapping[str, AggFun] | None = None,
                 agg_year: Mapping[str, AggFun] | None = None,
                 agg_total: Mapping[str, AggFun] | None = None, key: str = KEY) -> DataFrame:
    """Bottom-up aggregation spell -> group -> minor -> year -> state.

    Levels without functions are left out.  Output is tall: one row per remaining combination, with
    ``fun_<level>`` naming the function of each level and ``value`` holding the result.  On the first
    level, missing combinations get the default of the function.
    """
    wanted = dict(zip(LEVELS, (agg_spell, agg_group, agg_minor, agg_year, agg_total), strict=True))
    used = [level for level in LEVELS if wanted[level]]
    if not used:
        present = [c for c in days.columns if c in ("spell", "state")]
        return days.select(key, *present, "time", "flow")
    result = days.withColumn("ord", F.col("time"))
    fun_columns: list[str] = []
    for i, level in enumerate(used):
        above = [n for n in LEVELS[LEVELS.index(level):] if n in used]
        if "state" not in above:
            above.append("state")
        if i == 0 and level != "spell" and "spell" in above:
            above.remove("spell")
        funs = wanted[level]
        wide = result.groupBy(key, *above, *fun_columns).agg(
            *[f.fun().alias(f"_f{j}") for j, f in enumerate(funs.values())],
            F.min("ord").alias("ord"))
        pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_f{j}").alias("v"))
                          for j, name in enumerate(funs)])
        result = wide.select(key, *above, *fun_columns, "ord", F.explode(pairs).alias("_p"))
        result = result.select(key, *above, *fun_columns, "ord",
                               F.col("_p.name").alias(f"fun_{level}"), F.col("_p.v").alias("value"))
        fun_columns.append(f"fun_{level}")
        if i == 0:
            result = _complete(result, funs, level, above, used, key)
    keep = [c for c in ("spell", "group", "minor", "year", "state") if c in result.columns]
    return result.select(key, *keep, *fun_columns, "value")


def _complete(result: DataFrame, funs: Mapping[str, AggFun], level: str, above: list[str],
              used: list[str], key: str) -> DataFrame:
    """Add the missing combinations of (function, level, ..., state) with the function's default.

    The results of a series become one list (at most one entry a spell or calendar period, hence bounded by its days);
    what its values of every level span is built in the row, and what is not there yet is added, so ``result`` is read once.
    """
    crossed = [n for n in above if n not in ("spell", "state")]
    kinds = {f.name: f.dataType for f in result.schema.fields if f.name != key}
    names = [*crossed, "state", f"fun_{level}"]
    gathered = result.groupBy(key).agg(F.collect_list(F.struct(*kinds)).alias("_rows"), *[F.collect_set(n).alias(f"_{n}") for n in crossed])
    cells = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(name).alias(f"fun_{level}")) for s in STATES for name in funs])

    def crossing(n: str, rest: Column) -> Column:
        later = names[names.index(n) + 1:]
        return F.flatten(F.transform(f"_{n}", lambda v: F.transform(
            rest, lambda c: F.struct(v.alias(n), *[c[m].alias(m) for m in later]))))

    for n in reversed(crossed):
        cells = crossing(n, cells)
    present = F.transform("_rows", lambda r: F.struct(*[r[n].alias(n) for n in names]))
    default = F.create_map(*[c for name, f in funs.items() for c in (F.lit(name), F.lit(f.default).cast(kinds["value"]))])

    def added(c: Column) -> Column:
        own = {n: c[n] for n in names} | {"value": F.element_at(default, c[f"fun_{level}"])}
        return F.struct(*[(own[n] if n in own else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    missing = F.transform(F.array_except(cells, present), added)
    return gathered.select(key, F.inline(F.concat("_rows", missing)))


def ires_metric(df: DataFrame, threshold: float = 0.001, na: str = "none",
                rule: str | Mapping[str, str] = "cut", year: Column | None = None,
                minor: Column | None = None, key: str = KEY, time: str = TIME, value: str = VALUE,
                **aggregates: Mapping[str, AggFun]) -> DataFrame:
    """Classify, allocate and aggregate in one call; see :func:`spell_metric` for the aggregates."""
    days = classify(df, threshold, year, minor, na, key, time, value)
    return spell_metric(allocate_spell(days, rule, key), key=key, **aggregates)


# ---- circular statistics of days -------------------------------------------------------------

def circular(day: Column, upper: float = 365.0) -> dict[str, Column]:
    """Circular mean, variance, standard deviation and resultant length of days on 0..upper.

    Every entry is an aggregate expression; NULL days are ignored.
    """
    angle = day / F.lit(upper) * F.lit(2.0 * math.pi)
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    phi = F.atan2(s, c)
    scale = F.lit(upper / (2.0 * math.pi))
    length = F.sqrt(s * s + c * c)
    return {"mean": F.when(phi < 0, phi + F.lit(2.0 * math.pi)).otherwise(phi) * scale,
            "var": scale * scale * F.lit(-2.0) * F.log(length),
            "sd": scale * F.sqrt(F.greatest(F.lit(-2.0) * F.log(length), F.lit(0.0))),
            "abs": length}


def day_label(day: Column) -> Column:
    """Rounded day number 0..366 to ``-MM-DD`` of a normal year (0 is the last day of the year)."""
    return month_day(F.date_add(F.lit("1969-12-31").cast("date"), day.cast("int")))


# ---- named indices ---------------------------------------------------------------------------

def annual_no_flow(df: DataFrame, threshold: float = 0.001, na: str = "drop_year", key: str = KEY,
                   time: str = TIME, value: str = VALUE) -> DataFrame:
    """Per year: no-flow days, longest no-flow spell, onset and end of the first spell.

    Spells are cut at the end of the year, so the year is part of the spell key.  One shuffle.
    """
    t = F.col(time)
    days = df.select(key, t.alias("time"), F.col(value).alias("flow"), water_year(t).alias("year"))
    days = treat_missing_values(days, na, key, "time", "flow", levels=("year",))
    dry = F.coalesce(F.col("flow") <= threshold, F.lit(False))
    days = with_run_id(days.withColumn("dry", dry), F.struct("dry", F.col("flow").isNull()), "spell",
                       key, "time")
    spells = days.groupBy(key, "year", "spell", "dry").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("onset"), F.max("time").alias("end"))
    is_dry = F.col("dry")
    return spells.groupBy(key, "year").agg(
        F.coalesce(F.sum(F.when(is_dry, F.col("n"))), F.lit(0)).alias("no_flow_days"),
        F.coalesce(F.max(F.when(is_dry, F.col("n"))), F.lit(0)).alias("longest_spell"),
        F.min(F.when(is_dry, F.col("onset"))).alias("onset"),
        F.min_by(F.when(is_dry, F.col("end")), F.when(is_dry, F.col("onset"))).alias("end"))


def FAN(df: DataFrame, threshold: float = 0.001, **columns: str) -> DataFrame:
    """No-flow days of every year without missing days."""
    key = columns.get("key", KEY)
    return annual_no_flow(df, threshold, **columns).select(key, "year", F.col("no_flow_days").alias("FAN"))


def no_flow_indices(df: DataFrame, threshold: float = 0.001, key: str = KEY, time: str = TIME,
                    value: str = VALUE) -> DataFrame:
    """MAN, CVAN, MAMD, onset and termination of no-flow per series, from one pass over the years."""
    years = annual_no_flow(df, threshold, "drop_year", key, time, value)
    onset = circular(day_of_normal_year(F.col("onset")))
    end = circular(day_of_normal_year(F.col("end")))
    d = F.col("no_flow_days")
    out = years.groupBy(key).agg(
        F.avg(d).alias("MAN"), F.stddev_samp(d).alias("_sd"), F.avg("longest_spell").alias("MAMD"),
        F.rint(onset["mean"]).alias("tau0_day"), onset["sd"].alias("tau0_sd"),
        onset["abs"].alias("tau0_r"), F.rint(end["mean"]).alias("tauE_day"))
    return out.select(key, "MAN", F.when(F.col("MAN") != 0, F.col("_sd") / F.col("MAN")).alias("CVAN"),
                      "MAMD", day_label(F.col("tau0_day")).alias("tau0"), "tau0_sd", "tau0_r",
                      day_label(F.col("tauE_day")).alias("tauE"))


def no_flow_years(df: DataFrame, threshold: float = 0.001, key: str = KEY, time: str = TIME,
                  value: str = VALUE) -> DataFrame:
    """Share of years with at least one no-flow day (no year is dropped)."""
    dry = F.coalesce(F.col(value) <= threshold, F.lit(False))
    years = df.groupBy(key, water_year(F.col(time)).alias("year")).agg(F.bool_or(dry).alias("_dry"))
    return years.groupBy(key).agg((F.count_if("_dry") / F.count(F.lit(1))).alias("no_flow_years"))


def is_intermittent(df: DataFrame, threshold: float = 0.001, ndays: int = 5, consecutive: bool = True,
                    key: str = KEY, time: str = TIME, value: str = VALUE) -> DataFrame:
    """TRUE if any year has a no-flow spell (or, not ``consecutive``, a total) of ``ndays`` days."""
    years = annual_no_flow(df, threshold, "none", key, time, value)
    days = F.col("longest_spell") if consecutive else F.col("no_flow_days")
    return years.groupBy(key).agg(F.bool_or(days >= ndays).alias("is_intermittent"))
