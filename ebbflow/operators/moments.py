"""Centred cross products of columns: the one aggregation behind regression, correlation and components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``n, m, g``: count, means and flattened centred cross products of ``columns`` over complete rows.

    Every task centres as it goes (running means and co-moments, which merge exactly), so large means cost no
    digits; only such partial sums are shuffled, whatever the number of rows.  Without rows means and products are 0.
    """
    names = list(columns)
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    size, n = len(names), F.count(F.lit(1))
    zero = F.lit(0.0)
    cell = {(i, j): F.coalesce(F.covar_pop(names[i], names[j]) * n, zero) for i in range(size) for j in range(i, size)}
    g = F.array(*[cell[min(i, j), max(i, j)] for i in range(size) for j in range(size)])
    return complete.agg(n.alias("n"), F.array(*[F.coalesce(F.avg(c), zero) for c in names]).alias("m"), g.alias("g"))
