"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidate vectors are placed along a Hilbert curve through all their dimensions and written as Parquet rows of one
block each, together with the least and greatest value of every dimension.  For an anchor these bound the inner
product with any vector of the block by interval arithmetic, so an anchor reads a block only if the bounds meet one
of its windows of wanted scores.  A first search finds each anchor's positives (a window open above, whose floor is
taken from the anchor's own block), a second one the negatives whose scores lie in the windows that the positives set.

Anchors are dealt to batches and blocks to pages; one task scores one batch against the blocks of one page that it
needs, raises its floors as it goes, and sends only the best of each window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm.centroid_clustering import whole_numbers
from ebbflow.session import settle

SIZE, SCALE, EVERY = 64, 256, 100
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Vectors of a block, blocks of a page, anchors of a batch, bits of a dimension on the curve.
BLOCK, PAGE, BATCH, BITS = 256, 16, 2048, 2
#: Components from here on have inner products whose hundredfold may not fit a long.
LIMIT = 1 << 24
NONE = np.iinfo(np.int64).min
VECTOR = "array<int>"


def along_curve(cell: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve (Skilling, 2004) of every row of ``cell``, whose columns hold numbers of ``bits`` bits; as rows of bytes."""
    x = cell.astype(np.uint8).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint8(1 << level), np.uint8((1 << level) - 1)
        for row in x:
            turn = (row & bit) != 0
            swap = np.where(turn, 0, (x[0] ^ row) & low).astype(np.uint8)
            x[0] ^= np.where(turn, low, swap).astype(np.uint8)
            row ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.uint8)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0).astype(np.uint8)
    x ^= flip
    planes = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(-1, x.shape[1]).T, axis=1)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float64 if top < 1 << 52 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high``, for every pair of these."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def blocks(rows: DataFrame, size: int, block: int, page: int, bits: int) -> DataFrame:
    """``page, block, vec_id, label, v, low, high, least_label, greatest_label``: one row a block of ``rows(vec_id, label, v)``.

    ``v`` holds the vectors one after the other; pages are numbered from 0 on (some may be empty).
    """
    at = [F.get("v", F.lit(k)) for k in range(size)]
    found = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{k}") for k, c in enumerate(at) for f, name in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    middle = np.array([found[f"m{k}"] or 0.0 for k in range(size)])
    spread = np.array([found[f"s{k}"] or 1.0 for k in range(size)])
    # Cells of about equal numbers of normal values.
    cuts = {1: [0.0], 2: [-0.6745, 0.0, 0.6745], 3: [-1.1503, -0.6745, -0.3186, 0.0, 0.3186, 0.6745, 1.1503]}[bits]

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("v"), size)
            curve = along_curve(np.searchsorted(cuts, (x - middle) / spread), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in curve], pa.binary())], names=["vec_id", "label", "v", "curve"])

    def pack(batches):
        number, held = TaskContext.get().partitionId(), []
        done = 0

        def packed(table: pa.Table) -> pa.RecordBatch:
            x = matrix(table.column("v").combine_chunks(), size)
            label = table.column("label").to_numpy()
            return pa.RecordBatch.from_pydict({
                "page": [number], "block": [(number << 32) + done], "vec_id": [table.column("vec_id").to_numpy()], "label": [label], "v": [x.reshape(-1)],
                "low": [x.min(axis=0)], "high": [x.max(axis=0)], "least_label": [label.min()], "greatest_label": [label.max()]}, schema=shape)

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= block:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, block))
                done += 1
                held = table.slice(block).to_batches()
        if sum(map(len, held)):
            yield packed(pa.Table.from_batches(held))

    ints = pa.list_(pa.int32())
    shape = pa.schema([("page", pa.int32()), ("block", pa.int64()), ("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("v", ints), ("low", ints), ("high", ints),
                       ("least_label", pa.int64()), ("greatest_label", pa.int64())])
    placed = rows.select("vec_id", "label", "v").mapInArrow(place, f"vec_id long, label long, v {VECTOR}, curve binary")
    # The last key parts rows that are equal in all others; it is drawn once, since blocks are written once.
    placed = placed.withColumn("row", F.monotonically_increasing_id())
    order = placed.repartitionByRange(max(1, math.ceil(found["n"] / (block * page))), "curve", "vec_id", "row").sortWithinPartitions("curve", "vec_id")
    return settle(order.select("vec_id", "label", "v").mapInArrow(
        pack, f"page int, block long, vec_id array<long>, label array<long>, v {VECTOR}, low {VECTOR}, high {VECTOR}, least_label long, greatest_label long"))


def own_block(found: DataFrame, size: int, every: int, wanted: int) -> DataFrame:
    """``vec_id, label, v, floor``: the anchors, each with the score of the ``wanted``-th row of its label in its own block (null if there are fewer)."""
    def run(batches):
        for batch in batches:
            for number, labels, flat in zip(batch.column("vec_id"), batch.column("label"), batch.column("v")):
                ids, label = number.values.to_numpy(), labels.values.to_numpy()
                x = flat.values.to_numpy().reshape(-1, size)
                mine = np.flatnonzero(ids % every == 0)
                if not len(mine):
                    continue
                score = products(x[mine], x)
                score[(label != label[mine][:, None]) | (ids == ids[mine][:, None])] = NONE
                floor = -np.partition(-score.astype(float), wanted - 1, axis=1)[:, wanted - 1] if len(ids) >= wanted else np.full(len(mine), -np.inf)
                bare = floor <= NONE
                # Rounded down by a little: doubles may not hold a score exactly.
                whole = np.floor(np.where(bare, 0, floor) - np.abs(np.where(bare, 0, floor)) * 1e-12).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(label[mine]), pa.array(x[mine].tolist(), pa.list_(pa.int32())), pa.array(whole, mask=bare)],
                                                 names=["vec_id", "label", "v", "floor"])

    out = found.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label long, v {VECTOR}, floor long")
    return out.groupBy("vec_id", "label", "v").agg(F.max("floor").alias("floor"))


def best(row: np.ndarray, score: np.ndarray, number: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` of every row, by score from above and then by number."""
    order = np.lexsort((number, -score, row))
    row, score, number = row[order], score[order], number[order]
    new = np.append(True, row[1:] != row[:-1])[:len(row)]
    since = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(row) else np.arange(0)
    keep = since < most
    return row[keep], score[keep], number[keep]


class Windows:
    """Windows of scores of a batch: ``low`` and ``high`` of each, and the anchor that it belongs to."""

    def __init__(self, table: pa.Table, size: int):
        self.x = matrix(table.column("v").combine_chunks(), size)
        self.vec_id, self.label, self.anchor = (table.column(c).to_numpy() for c in ("vec_id", "label", "anchor"))
        lists = table.column("windows").combine_chunks()
        self.owner = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
        self.low, self.high = (lists.flatten().field(k).to_numpy() for k in (0, 1))


def search(windows: DataFrame, found: DataFrame, *, size: int, most: int, same: bool) -> DataFrame:
    """``anchor, vec_id, low, high, number, score``: for each window the first ``most`` rows whose score lies in it.

    ``windows(vec_id, label, v, anchor, batch, windows)`` has a row an anchor; ``same`` says whether rows must have the anchor's
    label (and another vec_id) or must not.
    """
    zones = found.select("page", "block", "low", "high", "least_label", "greatest_label")
    counts = found.agg(F.max("page").alias("pages")).first()["pages"], windows.agg(F.max("batch").alias("b")).first()["b"]
    pages, batches = (0 if c is None else c + 1 for c in counts)
    # Every page meets every batch: anchors are stated queries against all rows.
    by_page = windows.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(max(pages - 1, 0)))))
    by_batch = zones.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(max(batches - 1, 0)))))

    def choose(key, left: pa.Table, right: pa.Table) -> pa.Table:
        blank = {"batch": [], "block": []}
        if len(left) and len(right):
            w = Windows(left, size)
            least, greatest = bounds(w.x, matrix(right.column("low").combine_chunks(), size), matrix(right.column("high").combine_chunks(), size))
            first, last = right.column("least_label").to_numpy(), right.column("greatest_label").to_numpy()
            label = w.label[:, None]
            fit = (first <= label) & (label <= last) if same else (first < label) | (label < last)
            meets = fit[w.owner] & (least[w.owner] <= w.high[:, None]) & (greatest[w.owner] >= w.low[:, None])
            read = meets.any(axis=0)
            blank = {"batch": [key[0].as_py()] * int(read.sum()), "block": right.column("block").to_numpy()[read]}
        return pa.table(blank, schema=pa.schema([("batch", pa.int32()), ("block", pa.int64())]))

    chosen = by_page.groupBy("batch", "page").cogroup(by_batch.groupBy("batch", "page")).applyInArrow(choose, "batch int, block long")
    needed = found.select("page", "block", "vec_id", "label", "v", "low", "high").join(chosen, "block")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "vec_id", "low", "high", "number", "score"]
        none = np.empty(0, np.int64)
        row, value, number = none, none, none
        if len(left) and len(right):
            w = Windows(left, size)
            floor = w.low.copy()
            low, high = (matrix(right.column(c).combine_chunks(), size) for c in ("low", "high"))
            least, greatest = bounds(w.x, low, high)
            ids, labels, vectors = (right.column(c) for c in ("vec_id", "label", "v"))
            for k in np.argsort(-greatest.max(axis=0)):
                live = np.flatnonzero((least[w.owner, k] <= w.high) & (greatest[w.owner, k] >= floor))
                if not len(live):
                    continue
                number_k, label_k = ids[int(k)].values.to_numpy(), labels[int(k)].values.to_numpy()
                who = np.unique(w.owner[live])
                at = np.searchsorted(who, w.owner[live])
                points = products(w.x[who], vectors[int(k)].values.to_numpy().reshape(-1, size))
                fit = label_k == w.label[who][:, None]
                fit = fit & (number_k != w.vec_id[who][:, None]) if same else ~fit
                inside = fit[at] & (points[at] >= floor[live][:, None]) & (points[at] <= w.high[live][:, None])
                r, c = np.nonzero(inside)
                if not len(r):
                    continue
                row, value, number = best(np.append(row, live[r]), np.append(value, points[at[r], c]), np.append(number, number_k[c]), most)
                full = np.bincount(row, minlength=len(floor)) >= most
                last = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(last, row, value)
                floor[full] = np.maximum(floor[full], last[full])
            own = w.owner[row]
            return pa.table([w.anchor[own], w.vec_id[own], w.low[row], w.high[row], number, value], names=names)
        return pa.table([none] * 6, names=names)

    parts = by_page.groupBy("batch", "page").cogroup(needed.groupBy("batch", "page")).applyInArrow(score, "anchor long, vec_id long, low long, high long, number long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "vec_id", "low", "high").orderBy(F.desc("score"), "number"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= most)


def _floor_percent(x: Column) -> Column:
    """Greatest whole number of hundreds not above ``x``; exact for longs."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(vectors: DataFrame, *, size: int = SIZE, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         block: int = BLOCK, page: int = PAGE, batch: int = BATCH, bits: int = BITS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, embedding, label)``.

    Anchors are the rows whose vec_id ``every`` divides.  A score is the inner product of the components ``floor(scale * x)``;
    higher ones come first, ties by vec_id.  An anchor's positives are its first ``positives`` rows of its label and another
    vec_id; for each, the first ``negatives`` rows of another label whose score is from ``low`` to ``high`` percent of the
    positive's are returned (for a positive's score below zero there are none).

    Rows without a vec_id, a label or a vector take no part, nor do vectors of another number of components than ``size``, or with
    a component that is null, NaN, infinite or 2^24 / ``scale`` and more.  Repeated rows are rows of their own as positives
    and negatives; as anchors equal rows count once.  Without rows or anchors the result is empty.  Other columns are left out.
    """
    v = F.when(F.size("embedding") == size, whole_numbers(F.col("embedding"), scale, LIMIT))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).dropna()
    found = blocks(rows, size, block, page, bits)
    anchors = settle(own_block(found, size, every, positives).withColumn("anchor", F.xxhash64("label", "v")))
    parts = max(1, math.ceil(anchors.count() / batch))
    anchors = anchors.withColumn("batch", F.pmod(F.xxhash64("vec_id", "anchor"), F.lit(parts)).cast("int"))

    def window(a: Column, b: Column) -> Column:
        return F.struct(a.alias("low"), b.alias("high"))

    above = F.array(window(F.coalesce("floor", F.lit(-(1 << 62))), F.lit(1 << 62)))
    near = settle(search(anchors.withColumn("windows", above).drop("floor"), found, size=size, most=positives, same=True)
                  .select("anchor", "vec_id", F.col("number").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    near = near.withColumns({"low": -_floor_percent(-low * p), "high": _floor_percent(high * p)})
    spans = near.where("low <= high").groupBy("anchor", "vec_id").agg(F.collect_set(window(F.col("low"), F.col("high"))).alias("windows"))
    hard = search(anchors.drop("floor").join(spans, ["anchor", "vec_id"]), found, size=size, most=negatives, same=False)
    out = near.join(hard, ["anchor", "vec_id", "low", "high"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("number").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors; those whose number seven divides have the next label."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")))


SQL = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
