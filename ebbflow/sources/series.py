"""Daily series out of fact tables.

The facts are aggregated by (series, day) with map-side partial sums first, so a key holding a third
of all facts shrinks to one row per day and task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.columns import KEY, TIME, VALUE
from ebbflow.operators.clean import add_missing_days


#: Facts behind one task of a table of many series; each fact may become some days once gaps are filled.
FACTS_PER_TASK = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily_series(facts: DataFrame, key: Column, day: Column, value: Column,
                 fun: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Long daily table ``series_id, time, value``."""
    return facts.groupBy(key.cast("string").alias(KEY), day.cast("date").alias(TIME)).agg(
        fun(value).alias(VALUE))


def ship_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped quantity per return flag and day."""
    return daily_series(table(spark, folder, "lineitem"), F.col("l_returnflag"), F.col("l_shipdate"),
                        F.col("l_quantity"))


def ship_daily_by_status(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped quantity per return flag, line status and day; days without shipments are missing."""
    key = F.concat("l_returnflag", "l_linestatus")
    return daily_series(table(spark, folder, "lineitem"), key, F.col("l_shipdate"), F.col("l_quantity"))


def supplier_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped quantity per supplier and day: many sparse series, whose number grows with the facts.

    A task would hold ever more series if their number of tasks stayed, so it follows the number of facts (from the
    files' footers) where the session's shuffle partitions do not suffice.  Series and day place the facts, as
    a series may hold most of them; sums are then placed by series for all that follows.
    """
    facts = table(spark, folder, "lineitem")
    parts = tasks_for(facts)
    if parts is None:
        return daily_series(facts, F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_quantity"))
    placed = facts.select(F.col("l_suppkey").cast("string").alias(KEY), F.col("l_shipdate").cast("date").alias(TIME),
                          F.col("l_quantity").alias(VALUE)).repartition(parts, KEY, TIME)
    return daily_series(placed, F.col(KEY), F.col(TIME), F.col(VALUE)).repartition(parts, KEY)


def tasks_for(facts: DataFrame) -> int | None:
    """Number of tasks that keeps each at ``FACTS_PER_TASK`` rows; None where the session's number does."""
    parts = -(-facts.count() // FACTS_PER_TASK)
    return parts if parts > int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def order_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per priority and day."""
    return daily_series(table(spark, folder, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"),
                        F.col("o_totalprice"))


def nation_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per nation and day on the full calendar, 0 on days without orders.

    Orders are reduced to (customer, day) ahead of the join, so a customer with very many orders is
    not a hot join key.
    """
    orders = table(spark, folder, "orders")
    per_customer = orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(
        F.sum("o_totalprice").alias("total"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    series = daily_series(joined, F.col("c_nationkey"), F.col("day"), F.col("total"))
    return add_missing_days(series, whole_span=True, fill=0.0)


def event_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Raw observations with duplicates: one series per event type, input order ``event_id``.

    The value is the deviation from 20, so zeros and negative values occur.
    """
    return table(spark, folder, "events").select(
        F.col("event_type").alias(KEY), F.col("ts").cast("date").alias(TIME),
        F.round(F.col("value") - 20.0, 2).alias(VALUE), "event_id")


def by_series(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Place each series in one partition ahead of several operators on the same days.

    The operators then share this shuffle.  Tables bucketed by series need no such step.  ``parts`` is the number of
    partitions, the session's by default (see :func:`tasks_for`).
    """
    known = df.where(F.col(KEY).isNotNull())
    return known.repartition(parts, KEY) if parts else known.repartition(KEY)
