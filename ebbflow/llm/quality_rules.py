"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

Words and signs of a text, alone and in pairs, are hashed into a fixed number of buckets.  The counts of trusted
documents and those of the whole corpus are two multinomials; a document's score is the mean logarithm of their ratio over
its n-grams, so length does not matter, and it is kept from a threshold on.  Everything is an SQL expression
over one row, apart from one aggregation of bucket counts, which each task adds up first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import words

BUCKETS, TRUSTED, THRESHOLD, SMOOTHING = 1 << 16, 20_000, -0.3, 1.0
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def neighbours(array: str, combine) -> Column:
    """``combine`` of each element and the next one."""
    short = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, 1, short), F.slice(array, 2, short), combine)


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, all of the whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"__lines": lines, "__hash": F.transform(words(F.col("text")), lambda w: F.xxhash64(w))})
    n = F.size("__hash")
    pairs = neighbours("__hash", lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("__pairs", pairs)
    triples = F.zip_with(F.slice("__pairs", 1, F.greatest(n - 2, F.lit(0))), F.slice("__hash", 3, F.greatest(n - 2, F.lit(0))), lambda p, c: F.xxhash64(p, c))
    out = out.withColumn("__triples", triples)
    # Few texts repeat a triple; only theirs are sorted together with their places.
    placed = F.sort_array(F.transform("__triples", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    some = F.size(F.array_distinct("__triples")) < F.size("__triples")
    out = out.withColumn("__placed", F.when(some, placed).otherwise(F.array().cast("array<struct<t:bigint,i:int>>")))
    twins = neighbours("__placed", lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
    long = lambda c: c.cast("long")
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                          lambda a, i: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    return out.withColumns({
        "n_words": long(n), "word_chars": long(F.length(F.translate(text, BLANKS, ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))), "n_repeat_words": long(covered)}).drop("__lines", "__hash", "__pairs", "__triples", "__placed")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def with_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with ``__grams``: the buckets of the text's words and signs and of their pairs."""
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    out = docs.withColumn("__hash", F.transform(tokens, lambda t: F.xxhash64(t)))
    single = F.transform("__hash", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = neighbours("__hash", lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return out.withColumn("__grams", F.concat(single, pairs)).drop("__hash")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """For each bucket the logarithm of its share among ``trusted(doc_id)`` over its share among all ``docs``.

    ``trusted`` is small: it is sent to all tasks, which count the corpus and its trusted part in one go.
    """
    flagged = docs.join(F.broadcast(trusted.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__trusted"))), F.col("doc_id") == F.col("__id"), "left")
    grams = with_tokens(flagged.select("text", "__trusted"), buckets).select("__trusted", F.explode_outer("__grams").alias("bucket")).where("bucket IS NOT NULL")
    counts = {r.bucket: (r.target, r.corpus) for r in grams.groupBy("bucket").agg(F.count("__trusted").alias("target"), F.count("*").alias("corpus")).collect()}
    target, corpus = (sum(c[k] for c in counts.values()) + smoothing * buckets for k in (0, 1))
    pairs = (counts.get(b, (0, 0)) for b in range(buckets))
    return [round(math.log((t + smoothing) / target * corpus / (c + smoothing)), 9) for t, c in pairs]


def judge(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the base counts, ``base_failed, score, kept``.

    Texts that are null, empty or blank have no words and fail the base rules; their score is null.  Without
    trusted documents all scores are near 0 and the base rules decide.  Repeated rows are judged each (a trusted
    id counts every row that has it); a null id is not trusted; an empty table gives no rows; columns that are
    called like a result are replaced.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    weights = log_ratios(docs.select("doc_id", "text"), trusted, buckets)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate("__grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    scored = with_tokens(base_counts(docs), buckets).withColumn("score", F.when(F.size("__grams") > 0, total / F.size("__grams"))).drop("__grams")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(float("-inf"))) >= threshold))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """About ``limit`` ids (all, if there are fewer) that ``labels.quality`` marks 1, chosen by a hash of the id."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    count = good.count()
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1 << 30, (limit << 30) // max(1, count)))


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents; trusted are those that the labels call good."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, trusted_ids(spark.read.parquet(f"{folder}/labels.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
