"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The classifier is trained from a small labelled table by accelerated gradient steps.  Every step is one
Spark aggregation over the labelled rows; what reaches the driver is one number a bucket, a fixed number
of buckets.  Gradients are summed as integers, so runs agree whatever the order of the sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import LOWER, UPPER
from ebbflow.session import settle

#: Host, path and verdict of the registered query's rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

BUCKETS, GRAM, STEPS, RIDGE, SAMPLE, SCALE = 4096, 3, 40, 1e-4, 20_000, 1_000_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> Column:
    """Struct ``length, rule, verdict`` of the longest rule that fits (its host or a subdomain, and the start of the path), or null.

    Of rules equally long the one with the longer host counts, then the first in order of text.  The rules are
    a list in the query, of 1000 at most.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(
        F.lit(len(h) + len(p)).alias("length"), F.lit(len(h)).alias("host_length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    if not fits:
        return F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def grams(host: Column, path: Column, buckets: int = BUCKETS, size: int = GRAM) -> Column:
    """The distinct buckets of the character n-grams of host and path, marked at both ends."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(size))), F.lit(buckets)).cast("int")))


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    bias: float
    size: int = GRAM

    def probability(self, host: Column, path: Column) -> Column:
        """Probability that a url is allowed."""
        return logistic(margin(grams(host, path, len(self.weights), self.size), self.weights, self.bias))


def margin(buckets: Column, weights, bias: float) -> Column:
    # One string that is folded to an array once; buckets count from 0, element_at from 1.
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i + 1))
    return total / F.sqrt(F.size(buckets)) + F.lit(bias)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def train(labelled: DataFrame, *, buckets: int = BUCKETS, size: int = GRAM, steps: int = STEPS, ridge: float = RIDGE, sample: int = SAMPLE) -> UrlModel:
    """Fit on ``labelled(host, path, allowed)``; of more than ``sample`` distinct rows, about that many, chosen by hash.

    Repeated rows count once; rows with a null are left out; without rows the model answers 0.5.
    """
    rows = labelled.dropna().groupBy("host", "path").agg(F.avg(F.col("allowed").cast("double")).alias("y"))
    rows = settle(rows)
    count = rows.count()
    if count > sample:
        rows = rows.where(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) < int(sample / count * (1 << 30)))
    rows = settle(rows.select("y", grams(F.col("host"), F.col("path"), buckets, size).alias("b")))
    n = max(1, rows.count())
    # Rows have length 1 besides the bias: the curvature of the mean loss is at most 1/2.
    weights, bias, rate, t = [0.0] * buckets, 0.0, 1 / (0.5 + ridge), 1.0
    ahead, ahead_bias = list(weights), bias
    for _ in range(steps if count else 0):
        error = logistic(margin(F.col("b"), ahead, ahead_bias)) - F.col("y")
        units = rows.select("b", F.round(error * SCALE).cast("long").alias("e"), F.round(error * SCALE / F.sqrt(F.size("b"))).cast("long").alias("g"))
        sums = units.select(F.explode(F.concat(F.transform("b", lambda i: F.struct(i.alias("i"), F.col("g").alias("v"))), F.array(F.struct(F.lit(-1).alias("i"), F.col("e").alias("v"))))).alias("u"))
        slope = {r.i: r.v / SCALE / n for r in sums.groupBy("u.i").agg(F.sum("u.v").alias("v")).collect()}
        new = [w - rate * (slope.get(i, 0.0) + ridge * w) for i, w in enumerate(ahead)]
        new_bias = ahead_bias - rate * slope.get(-1, 0.0)
        t, s = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = [a + (s - 1) / t * (a - b) for a, b in zip(new, weights, strict=True)]
        ahead_bias = new_bias + (s - 1) / t * (new_bias - bias)
        weights, bias = new, new_bias
    return UrlModel(tuple(weights), bias, size)


def judge(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, probability`` for every row of ``pages(page_id, url)``.

    The longest fitting rule decides; else the url is allowed from ``threshold`` on.  A null url, or one without
    ``://``, has an empty host and path and is judged like any other; ties, repeated rows and empty tables need
    no care, since every row is judged by itself; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    rows = rows.withColumns({"r": matching_rule(h, p, rules), "probability": model.probability(h, p)})
    method = F.when(F.col("probability") >= threshold, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "probability")


def labelled_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """A labelled url table, ``host, path, allowed``: the urls that a rule decides."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules)).where("r IS NOT NULL")
    return rows.select("host", "path", (F.col("r.verdict") == "allow").alias("allowed"))


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All page urls; the classifier learns from those that a rule decides."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled_by_rules(pages)))
