"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document becomes some twenty statistics of its whole text.  Standardised, they are mapped to random
Fourier features, whose inner products approximate a Gaussian kernel, so a linear fit on them is a kernel
fit.  Tasks sum the normal equations of their labelled rows; the sums of rows of the matrix are added up
in Spark, and the driver solves a system of fixed size.  Scores of labelled rows that took no part in the
fit are counted on a fixed grid, and an isotonic fit on these counts turns scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm.common import give_back, held_out
from ebbflow.session import settle

FEATURES, RIDGE, GRID, SEED = 256, 1e-3, 1000, 7
SYMBOLS = b"#*$%&|<>"
#: Statistics that ``describe`` gives, in order.
STATISTICS = ("log_bytes", "log_words", "word_length", "log_longest_word", "upper", "digits", "spaces", "punctuation", "symbols", "shouts",
              "other_scripts", "repeated_lines", "distinct_words", "repeated_triples", "capital_words", "marked_words", "single_letters",
              "entropy", "log_words_a_line", "commonest_word", "bars", "log_lines", "controls")


def describe(text: str | None) -> list[float]:
    """The statistics of one whole text; a null text counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words, lines = max(1, len(data)), data.split(), [x for x in data.split(b"\n") if x.strip()]
    w = max(1, len(words))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    share = count[count > 0] / n
    common = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    symbols = int(count[list(SYMBOLS)].sum())
    tail = sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:?" for x in words)
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / w, math.log1p(max(map(len, words), default=0)),
        upper / max(1, upper + lower), int(count[48:58].sum()) / n, int(count[[9, 10, 13, 32]].sum()) / n,
        int(count[list(b".,;:?'\"-()")].sum()) / n, symbols / n, int(count[33]) / n, int(count[128:].sum()) / n,
        1 - len(set(lines)) / max(1, len(lines)), len(common) / w, sum(c for c in triples.values() if c > 1) / max(1, len(words) - 2),
        sum(x.isupper() and len(x) > 1 for x in words) / w, tail / w, sum(len(x) == 1 for x in words) / w,
        float(-(share * np.log2(share)).sum()), math.log1p(len(words) / max(1, len(lines))),
        max(common.values(), default=0) / w, int(count[124]) / w, math.log1p(len(lines)), int(count[:9].sum() + count[14:32].sum()) / n]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``stats``: the statistics as an array."""
    schema = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            rest = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != "text"}
            rest["stats"] = pa.array([describe(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(rest.values()), names=list(rest))
        give_back()

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]  # raw scores and what they are worth

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.directions + self.phases) * math.sqrt(2 / self.directions.shape[1])
        return np.hstack([np.ones((len(z), 1)), z])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def _stack(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """``Z'Z`` and ``Z'y`` over ``rows(stats, y)``: sums by task, then of each matrix row over the tasks."""
    size = len(model.phases) + 1

    def partial(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = model.features(_stack(batch.column(0)))
                total += z.T @ np.hstack([z, np.array(batch.column(1).to_pylist(), float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def add(part: pa.Table) -> pa.Table:
        total = _stack(part.column("v")).sum(axis=0)
        return pa.table({"i": part.column("i").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.select("stats", "y").mapInArrow(partial, "i int, v array<double>")
    total = np.zeros((size, size + 1))
    for r in parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect():
        total[r.i] = r.v
    return total[:, :-1], total[:, -1]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted nondecreasing fit by pooling neighbours; returns one point for each block."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, every: DataFrame, *, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> QualityModel:
    """Fit on ``rows(stats, y, calibrate)``; ``every(stats)`` gives means and deviations.

    Rows with ``calibrate`` are left out of the regression and calibrate its scores.  Without rows to fit,
    or of one class alone, the score is the mean label (0.5 without any label).
    """
    width = len(STATISTICS)
    moments = every.agg(F.count("*").alias("n"), *[f(F.col("stats")[k]).alias(f"{p}{k}") for k in range(width) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(width)])
    scale = np.array([moments[f"s{k}"] or 0.0 for k in range(width)])
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((width, features)) / math.sqrt(width)
    model = QualityModel(mean, np.where(scale > 1e-12, scale, 1.0), directions, rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), (np.zeros(1), np.zeros(1)))
    gram, cross = normal_equations(rows.where("NOT calibrate"), model)
    n = gram[0, 0]
    weights = np.linalg.solve(gram + ridge * max(1.0, n) * np.diag([1e-9] + [1.0] * features), cross)

    def grid(batches):
        raw = QualityModel(**{**model.__dict__, "weights": weights})
        for batch in batches:
            if len(batch):
                at = np.round(np.clip(raw.raw(_stack(batch.column(0))), -1, 2) * GRID).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["at", "y"])

    counted = rows.where("calibrate").select("stats", "y").mapInArrow(grid, "at long, y double")
    cells = sorted((r.at, r.y, r.n) for r in counted.groupBy("at").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    if cells:
        at, y, count = map(np.array, zip(*cells, strict=True))
        steps = isotonic(at / GRID, y.astype(float), count.astype(float))
    else:
        steps = (np.zeros(1), np.array([cross[0] / n if n else 0.5]))
    return QualityModel(**{**model.__dict__, "weights": weights, "steps": steps})


def train(described: DataFrame, labels: DataFrame, **options) -> QualityModel:
    """Fit on the labelled rows of ``described(doc_id, stats, ...)`` that are not held out.

    Labels of one id are averaged, null labels and null ids teach nothing.  The last of the four folds of
    crc32 calibrates.
    """
    y = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).where("y IS NOT NULL")
    rows = described.join(y, "doc_id").where(~held_out(F.col("doc_id")))
    rows = settle(rows.select("stats", "y", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3).alias("calibrate")))
    return fit(rows, described.select("stats"), **options)


def apply(described: DataFrame, model: QualityModel) -> DataFrame:
    """``described`` with ``score`` in place of ``stats``."""
    schema = T.StructType([f for f in described.schema if f.name != "stats"] + [T.StructField("score", T.DoubleType())])
    sent = described.sparkSession.sparkContext.broadcast(model)  # some hundred kilobytes, fixed by the number of features

    def run(batches):
        for batch in batches:
            rest = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != "stats"}
            rest["score"] = pa.array(sent.value.score(_stack(batch.column("stats"))) if len(batch) else [], pa.float64())
            yield pa.RecordBatch.from_arrays(list(rest.values()), names=list(rest))

    return described.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Statistics are of whole texts; null counts as an empty text, and empty texts are scored by their
    (vanishing) statistics like any other.  Rows with equal texts score alike; rows that repeat a doc_id, or
    have none, are scored each; an empty table gives no rows; other columns are not read.  ``labels``, ids and
    other columns are never inputs of a score.
    """
    described = settle(statistics(docs.select("doc_id", "text")))
    scored = apply(described, train(described, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns of ``docs``."""
    model = train(settle(statistics(docs.select("doc_id", "text"))), labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            stats = np.array([describe(t.as_py()) for t in batch.column("text")], float).reshape(len(batch), -1)
            if len(batch):
                yield batch.filter(pa.array(sent.value.score(stats) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, scored by what ``labels.quality`` says of the folds that may be learnt from."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, labels)
