"""Forecast skill of ensembles and comparison of drought scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble_long(df: DataFrame, members: Sequence[str], year: str = "year") -> DataFrame:
    """One row per year and ensemble member."""
    return df.unpivot(year, list(members), "member", "value")


def event_probability(members: DataFrame, threshold: Column, year: str | Sequence[str] = "year",
                      value: str = "value") -> DataFrame:
    """Share of members below the threshold."""
    by = [year] if isinstance(year, str) else list(year)
    return members.groupBy(*by).agg(F.avg((F.col(value) < threshold).cast("double")).alias("probability"))


def brier_skill(pairs: DataFrame, by: Sequence[str] = (), benchmark: float = 0.1) -> DataFrame:
    """Brier score of ``probability`` against ``event`` (0/1), of a constant benchmark, and the skill."""
    o, p = F.col("event").cast("double"), F.col("probability")
    scores = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                    F.avg((p - o) * (p - o)).alias("brier"),
                                    F.avg((benchmark - o) * (benchmark - o)).alias("brier_benchmark"))
    return scores.withColumn("skill", F.when(F.col("brier_benchmark") != 0, (
        F.col("brier") - F.col("brier_benchmark")) / (0 - F.col("brier_benchmark"))))


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group of any size, exact."""
    from ebbflow.operators.windows import exact_quantiles

    return exact_quantiles(df, list(by), value, (0.0, 0.25, 0.5, 0.75, 1.0),
                           ("min", "q25", "median", "q75", "max"))


def scenario_change(events: DataFrame, scenario: str, benchmark: str, influenced: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """Mean duration and deficit of both scenarios and the change in percent; one aggregation."""
    def mean(column: str, name: str) -> Column:
        return F.avg(F.when(F.col(scenario) == name, F.col(column).cast("double")))

    wide = events.groupBy(*by).agg(
        mean("duration", benchmark).alias("_db"), mean("duration", influenced).alias("_di"),
        mean("volume", benchmark).alias("_vb"), mean("volume", influenced).alias("_vi"))
    rows = F.array(
        F.struct(F.lit("mean_duration").alias("characteristic"), F.col("_db").alias("benchmark"),
                 F.col("_di").alias("influenced")),
        F.struct(F.lit("mean_deficit").alias("characteristic"), F.col("_vb").alias("benchmark"),
                 F.col("_vi").alias("influenced")))
    long = wide.select(*by, F.explode(rows).alias("e")).select(*by, "e.*")
    return long.withColumn("change_percent", F.when(F.col("benchmark") != 0, (
        F.col("influenced") - F.col("benchmark")) / F.col("benchmark") * 100))


def cv_summary(df: DataFrame, pred: str, obs: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, bias and R2 (one minus mean squared error over the sample variance)."""
    e = F.col(pred) - F.col(obs)
    out = df.where(F.col(pred).isNotNull() & F.col(obs).isNotNull()).groupBy(*by).agg(
        F.avg(e * e).alias("_mse"), F.avg(e).alias("bias"), F.var_samp(obs).alias("_var"))
    return out.select(*by, F.sqrt("_mse").alias("rmse"), "bias",
                      F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).alias("r2"))
