"""Mixing sources to target weights by entropy balancing.

Every word of the corpus is given a rate.  Of all rates whose words meet the target of each source, the
ones closest to 1 (least relative entropy) are exponential tilts ``exp(lambda)`` of the source's
constraint; the multipliers solve a convex dual by Newton's method.  The corpus enters the dual through
its words per source alone, so documents are summed once (with partial sums in each task, however large
a source is) and the iterations run on the table of sources, in Spark.

Rates become whole copies: every document gets the whole part, and documents in the order of a hash of
their id get one more until the source's remaining words are used up.  Where that order ends is found by
narrowing the hash from bucket to bucket, so the documents of a source never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbflow.llm.common import words
from ebbflow.session import settle

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 60


def unit_key() -> Column:
    """Hash that orders a source's documents: of the id or, without one, of the text."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, key, size`` of every document; the size is the number of words."""
    return docs.select("doc_id", "source", unit_key().alias("key"), F.size(words(F.col("text"))).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target``: one row a source.

    Sources in order of code points, null last, take the weights in turn and share all words by weight; a
    target above ``cap`` times its source stops there and the rest is shared again.  The end of that
    repetition is the level at which the sources still below their cap share what the others leave.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # These windows are ordered over the table of sources, one row each.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1).cast("double"))
    per = per.withColumn("full", (cap * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("full") / F.col("weight"), "turn")
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({"left": F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(past), F.lit(0.0)), "open": F.sum("weight").over(rest)})
    per = per.withColumn("free", F.col("weight") * F.col("left") / F.col("open") <= F.col("full"))
    per = per.withColumn("turn_order", F.row_number().over(order))
    per = per.withColumn("at", F.min(F.when(F.col("free"), F.struct("turn_order", "left", "open"))).over(everything))
    shared = F.col("weight") * F.col("at.left") / F.col("at.open")
    return per.select("source", "source_size", F.when(F.col("turn_order") >= F.col("at.turn_order"), shared).otherwise(F.col("full")).alias("target"))


def rates(targets: DataFrame) -> DataFrame:
    """``targets`` with ``rate``: the exponential tilt that meets the target, 0 for a source without words.

    The dual's gradient for a source is ``size * exp(lambda) - target`` and its curvature ``size * exp(lambda)``;
    a Newton step goes up by at most 2, which keeps it from overshooting.
    """
    wanted = F.col("target") / F.col("source_size")
    multiplier = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), lambda at, _: at + F.least(F.lit(2.0), wanted * F.exp(-at) - 1))
    return targets.withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.round(F.exp(multiplier), 9)).otherwise(F.lit(0.0)))


def copy_plan(sized: DataFrame, rated: DataFrame, levels: int = 2, digits: int = 3) -> DataFrame:
    """``source, source_size, target, whole, cut, closing``: how many copies the documents of a source get.

    Everyone gets ``whole``, keys up to ``cut`` one more, and so does the key ``closing``, whose size comes
    nearest to the words that are then still missing (if it brings the total nearer to the target).
    Documents with equal keys are treated alike.
    """
    plan = rated.withColumn("whole", F.floor("rate").cast("long"))
    plan = settle(plan.withColumn("want", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    units = settle(sized.groupBy("source", "key").agg(F.sum("size").alias("size")))
    wanted = plan.select(F.col("source").alias("s"), "want", F.lit("").alias("prefix"))
    for level in range(levels + 1):
        mine = units.join(wanted, F.col("source").eqNullSafe(F.col("s")) & F.col("key").startswith(F.col("prefix")))
        step = F.substring("key", 1, (level + 1) * digits) if level < levels else F.col("key")
        sums = mine.groupBy("s", "want", "prefix", step.alias("step")).agg(F.sum("size").alias("size"))
        upto = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("s").orderBy("step")))
        inside = F.col("upto") <= F.col("want")
        if level < levels:
            # The bucket in which the wanted words run out; without one all keys fit.
            cut = upto.groupBy("s").agg(F.min(F.when(~inside, F.struct("step", (F.col("want") - F.col("upto") + F.col("size")).alias("want")))).alias("c"))
            wanted = settle(cut.select("s", F.coalesce("c.want", F.lit(0.0)).alias("want"), F.coalesce("c.step", F.lit("g")).alias("prefix")))
        else:
            last = upto.groupBy("s").agg(F.max(F.when(inside, F.struct("step", "upto"))).alias("c"))
            ends = wanted.alias("w").join(last.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
            ends = ends.select("s", F.coalesce("c.step", "prefix").alias("cut"), (F.col("want") - F.coalesce("c.upto", F.lit(0))).alias("gap"))
    ends = settle(ends)
    open_ = units.join(ends, F.col("source").eqNullSafe(F.col("s"))).where((F.col("key") > F.col("cut")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    closing = open_.groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key")).alias("c")).select(F.col("s").alias("t"), F.col("c.key").alias("closing"))
    ends = ends.join(closing, F.col("s").eqNullSafe(F.col("t")), "left").select("s", "cut", "closing")
    return settle(plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut", "closing"))


def copies(key: Column) -> Column:
    """Copies of a document with the given key, by the columns of a ``copy_plan`` row."""
    return F.col("whole") + F.coalesce(((key <= F.col("cut")) | (key == F.coalesce("closing", F.lit("")))).cast("long"), F.lit(0))


def allocate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs(doc_id, text, source)``.

    Null, empty and blank texts have size 0 and take nothing; null is a source of its own; rows that repeat a
    doc_id are treated alike; documents without an id are told apart by their text; an empty table gives no
    rows; other columns are not read.  No document gets more than ``cap`` copies, and runs agree.
    """
    sized = settle(sizes(docs))
    plan = copy_plan(sized, rates(source_targets(sized, weights, cap))).withColumnRenamed("source", "s")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    out = joined.withColumn("copies", copies(F.col("key")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    plan = copy_plan(sized := settle(sizes(docs)), rates(source_targets(sized, weights, cap)))
    plan = plan.select(*[F.col(c).alias(f"__mix_{c}") for c in plan.columns])
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("__mix_source")))
    key = unit_key()
    extra = F.coalesce(((key <= F.col("__mix_cut")) | (key == F.coalesce("__mix_closing", F.lit("")))).cast("long"), F.lit(0))
    times = (F.col("__mix_whole") + extra).cast("int")
    return joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*[f"`{c}`" for c in docs.columns])


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, mixed by weights 5, 2, 1 with at most three copies."""
    return allocate(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), chr(10) || coalesce(text, ''))) AS key,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
weighed AS (SELECT *, CAST(([5, 2, 1])[turn % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS full_ FROM per),
ordered AS (SELECT *, row_number() OVER o AS n, CAST(sum(source_size) OVER () AS DOUBLE)
        - coalesce(sum(full_) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
    FROM weighed WINDOW o AS (ORDER BY full_ / weight, turn)),
level AS (SELECT arg_min(left_, n) AS left_, arg_min(open_, n) AS open_, min(n) AS n FROM ordered WHERE weight * left_ / open_ <= full_),
target AS (SELECT source, source_size, CASE WHEN o.n >= l.n THEN weight * l.left_ / l.open_ ELSE full_ END AS target FROM ordered o, level l),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target / source_size, 9)) AS BIGINT) ELSE 0 END AS whole FROM target),
want AS (SELECT *, greatest(0.0, target - whole * source_size) AS want FROM rated),
unit AS (SELECT source, key, sum(size) AS size FROM d GROUP BY ALL),
placed AS (SELECT u.*, w.want, sum(u.size) OVER (PARTITION BY u.source ORDER BY u.key) AS upto
    FROM unit u JOIN want w ON u.source IS NOT DISTINCT FROM w.source),
flagged AS (SELECT *, upto <= want AS extra, want - coalesce(max(CASE WHEN upto <= want THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM placed),
closing AS (SELECT source, arg_min(key, (abs(size - gap), key)) AS key FROM flagged WHERE NOT extra AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, d.size, source_size, target, CAST(d.size * (whole + CAST(f.extra OR c.key IS NOT NULL AS BIGINT)) AS BIGINT) AS taken
FROM d JOIN want w ON d.source IS NOT DISTINCT FROM w.source
    JOIN flagged f ON d.source IS NOT DISTINCT FROM f.source AND d.key = f.key
    LEFT JOIN closing c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key
"""
