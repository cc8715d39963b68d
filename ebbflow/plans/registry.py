"""Registry of queries.

A query declares its output columns once, as ``"series_id:s event:i first_day:d volume:f2"``.  The
declaration fixes name, type and rounding of the Spark result and wraps the checking SQL in the same
way: ``s`` string, ``i`` integer, ``d`` date as ISO text, ``b`` flag as 0/1, ``fN`` double rounded to
N digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(spark, folder).select(*[_shape(n, k) for n, k in self.columns])

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        body = ", ".join(_sql_shape(n, k) for n, k in self.columns)
        return f"SELECT {body} FROM ({self.sql}) AS answer"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query function ``(spark, folder) -> DataFrame``."""
    spec = tuple((c.rpartition(":")[0], c.rpartition(":")[2]) for c in columns.split())

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = Query(name, build, spec, sql)
        return build

    return register


def _shape(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "s":
        out = c.cast("string")
    elif kind in ("i", "b"):
        out = c.cast("bigint") if kind == "i" else c.cast("boolean").cast("bigint")
    elif kind == "d":
        out = c.cast("date").cast("string")
    else:
        r = F.round(c.cast("double"), int(kind[1:]))
        out = F.when(r == 0, 0.0).otherwise(r)
    return out.alias(name)


def _sql_shape(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "s":
        out = f"CAST({c} AS VARCHAR)"
    elif kind == "i":
        out = f"CAST({c} AS BIGINT)"
    elif kind == "b":
        out = f"CAST(CAST({c} AS BOOLEAN) AS BIGINT)"
    elif kind == "d":
        out = f"CAST(CAST({c} AS DATE) AS VARCHAR)"
    else:
        r = f"round(CAST({c} AS DOUBLE), {kind[1:]})"
        out = f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END"
    return f"{out} AS {c}"
