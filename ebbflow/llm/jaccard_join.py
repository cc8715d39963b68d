"""Exact n-gram Jaccard join with set-relation skipping.

1.  Every text becomes its set of hashed shingles.  Texts with equal sets are one *set* from here on.
2.  A fixed order puts shingles from crowded buckets last.  Two sets above the threshold share one of the
    first few shingles of each (the prefix); an index list holds, for one shingle, the sets with it in their
    prefix, with its position, the set's size and a small parity sketch.  Pairs from the lists meet a wider
    sketch, which grows with the set, before any full set is sent.
3.  Lists are ordered by size and cut into blocks.  For a probing set, a whole block is skipped if its sizes are out
    of range or its positions leave too little overlap; single entries are skipped by their position, and
    by the sketch, whose differing bits bound the symmetric difference from below.
4.  Sets that are nearly equal have nearly the same answers: an entry that one member of a cluster has
    reached is not compared with the cluster's other members again, but takes over from there.  Each set
    is tied to one partner, the tie is verified on the full sets, and verified ties make components.
5.  Components take part as one from then on: of all pairs that lists still hold between two components only
    the nearest is verified, and links found so merge components, until a round finds few.  A list without
    a pair of different components is done, as components only grow.
6.  A last pass over the lists that are left skips pairs whose answer follows (one component) and
    verifies every other pair that the filters leave, so no link between different components is lost.

Lists longer than ``block`` are dealt by pairs of blocks, so no task holds a list whole.  Filters only drop pairs that
cannot reach the threshold; there is no cap on partners or candidates.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import give_back
from ebbflow.llm.components import components
from ebbflow.llm.shingles import Shingler
from ebbflow.session import settle

COUNTERS, SKETCH, BLOCK, SHORT = 1 << 18, 64, 20_000, 16
SEGMENT = 4096


def crowding(docs: DataFrame, size: int, counters: int = COUNTERS) -> np.ndarray:
    """Order class of each bucket of shingles: 0 up to the mean count, one more for each doubling.

    All documents are counted; what is sent out has a fixed size, however many shingles there are.
    """
    def count(batches):
        shingles, total = Shingler(size), np.zeros(counters, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, (shingles(text) >> np.uint64(40)).astype(np.int64) % counters, 1)
        rows = total.reshape(-1, SEGMENT)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.int64()))], names=["i", "v"])

    def add(part: pa.Table) -> pa.Table:
        flat = part.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({"i": part.column("i").slice(0, 1), "v": pa.array([flat.reshape(-1, SEGMENT).sum(axis=0)], pa.list_(pa.int64()))})

    parts = docs.select("text").mapInArrow(count, "i int, v array<long>")
    total = np.zeros((counters // SEGMENT, SEGMENT), np.int64)
    for r in parts.groupBy("i").applyInArrow(add, "i int, v array<long>").toLocalIterator():
        total[r.i] = r.v
    total = total.reshape(-1)
    return np.floor(np.log2(np.maximum(1.0, total / max(1.0, total.mean())))).astype(np.uint8)


def least_overlap(a, b, percent: int):
    """Shingles that sets of sizes ``a`` and ``b`` must share: 100 * both >= percent * either."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of the sketch's bits."""
    bits = np.bincount((shingles & np.uint64(8 * SKETCH - 1)).astype(np.int64), minlength=8 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def wide_sketch(shingles: np.ndarray) -> bytes:
    """The same with about one bit a shingle: a power of two, so that sketches of unequal length can be compared."""
    width = max(512, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 512
    bits = np.bincount(((shingles >> np.uint64(12)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Differing bits of two wide sketches; the longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def describe(docs: DataFrame, size: int, percent: int, order: np.ndarray) -> DataFrame:
    """``doc_id, key, n, prefix, sketch, wide`` for each document; the key is null without shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        shingles = Shingler(size)
        for batch in batches:
            key, n, prefix, sketches, wide = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                key.append(set_key(s) if len(s) else None)
                # A partner shares at least percent of this set: one of the others' complement plus one.
                first = len(s) - -(-percent * len(s) // 100) + 1
                ranked = (sent.value[(s >> np.uint64(40)).astype(np.int64) % len(sent.value)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                ranked.sort()
                prefix.append(ranked[:first].view(np.int64) if len(s) else [])
                sketches.append(sketch(s))
                wide.append(wide_sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(wide, pa.binary())],
                                             names=["doc_id", "key", "n", "prefix", "sketch", "wide"])
        del shingles
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, n long, prefix array<long>, sketch binary, wide binary")


class Lists:
    """Rows of several whole index lists, ordered by list and size."""

    def __init__(self, table: pa.Table, percent: int):
        take = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        self.percent, self.group = percent, take("group")
        self.node, self.n, self.pos, self.root, self.half = (take(c) for c in ("node", "n", "pos", "root", "half"))
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(self.node), -1)
        new = np.ones(len(self.node), bool)
        new[1:] = self.group[1:] != self.group[:-1]
        self.starts = np.append(np.flatnonzero(new), len(self.node))

    def passing(self, a, b, strict: float) -> np.ndarray:
        """Which of the pairs (rows ``a``, ``b``) may be links, by position, size and sketch."""
        need = least_overlap(self.n[a], self.n[b], self.percent)
        ok = np.minimum(self.n[a] - self.pos[a], self.n[b] - self.pos[b]) >= need
        ok &= (np.minimum(self.n[a], self.n[b]) * 100 >= self.percent * np.maximum(self.n[a], self.n[b])) & (self.root[a] != self.root[b]) & (self.node[a] != self.node[b])
        ok &= (self.half[a] < 0) | (self.half[a] != self.half[b])
        at = np.flatnonzero(ok)
        if at.size:
            x, y = (np.broadcast_to(i, ok.shape)[at] for i in (a, b))
            apart = np.bitwise_count(self.sketch[x] ^ self.sketch[y]).sum(axis=1, dtype=np.int64)
            allowed = self.n[x] + self.n[y] - 2 * need[at]
            ok[at] = apart <= (strict * allowed if strict < 1 else allowed)
        return ok

    def short(self, strict: float):
        """Pairs of all lists of up to ``SHORT`` rows at once, by the distance of their rows."""
        length = np.repeat(np.diff(self.starts), np.diff(self.starts))
        for d in range(1, SHORT):
            a = np.flatnonzero((length[:-d] <= SHORT) & (self.group[:-d] == self.group[d:])) if len(length) > d else np.empty(0, np.int64)
            if not a.size:
                break
            ok = self.passing(a, a + d, strict)
            yield a[ok], a[ok] + d

    def long(self, strict: float, forest: bool):
        """Pairs of the longer lists; with ``forest``, each row is tied once, to the row that reached it."""
        for lo, hi in zip(self.starts, self.starts[1:]):
            if hi - lo <= SHORT:
                continue
            rows = np.arange(lo, hi)
            sizes = self.n[lo:hi]
            open_ = np.ones(hi - lo, bool)
            for seed in range(hi - lo):
                if forest and not open_[seed]:
                    continue
                frontier = [seed]
                open_[seed] = False
                while frontier:
                    x = frontier.pop()
                    # Rows are ordered by size: the block of sizes within reach, the rest of the list is skipped.
                    first = np.searchsorted(sizes, -(-self.percent * sizes[x] // 100), "left") if forest else x + 1
                    last = np.searchsorted(sizes, 100 * sizes[x] // self.percent, "right")
                    block = rows[first:last][open_[first:last]] if forest else rows[first:last]
                    # Positions too far back leave too little overlap.
                    block = block[self.n[block] - self.pos[block] >= least_overlap(sizes[x], self.n[block], self.percent)]
                    if not block.size:
                        continue
                    hit = block[self.passing(np.full(len(block), lo + x), block, strict)]
                    if hit.size:
                        yield np.full(len(hit), lo + x), hit
                    if forest:
                        open_[hit - lo] = False
                        frontier.extend((hit - lo).tolist())


def whole_groups(batches):
    """Tables that end where a run of equal ``group`` values ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        group = batch.column("group").to_numpy(zero_copy_only=False)
        change = np.flatnonzero(group[1:] != group[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0
        if held and held[-1].column("group")[-1].as_py() != group[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def candidates(lists: DataFrame, percent: int, forest: bool, strict: float = 1.0) -> DataFrame:
    """Pairs of sets of one list that the filters leave: ``u`` < ``v``, their components ``x`` < ``y``, the ``group``.

    With ``forest``, a list of n rows gives fewer than n pairs (one of up to ``SHORT`` rows all of its pairs), and
    none only if it holds none.
    """
    names = ["group", "u", "v", "x", "y"]

    def run(batches):
        for table in whole_groups(batches):
            rows = Lists(table, percent)
            for a, b in itertools.chain(rows.short(strict), rows.long(strict, forest)):
                u, v, x, y = rows.node[a], rows.node[b], rows.root[a], rows.root[b]
                columns = (rows.group[a], np.minimum(u, v), np.maximum(u, v), np.minimum(x, y), np.maximum(x, y))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    dealt = lists.repartition("group").sortWithinPartitions("group", "n", "node")
    return dealt.select("group", "node", "n", "pos", "root", "half", "sketch").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows(node, ...)`` with ``root``: the node's component, itself without links."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Components with further links: the old ones take part as stars, so few steps are left."""
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))


def sifted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v, ...)`` whose wide sketches allow a link, with ``spare`` counted on these."""
    kept = [f for f in pairs.schema if f.name != "spare"]

    def run(batches):
        for batch in batches:
            a, b, n, m = (batch.column(k).to_pylist() for k in ("a", "b", "n", "m"))
            spare = np.array([p + q - 2 * least_overlap(p, q, percent) - apart(x, y) for x, y, p, q in zip(a, b, n, m)], np.int64)
            yield batch.select([f.name for f in kept]).append_column("spare", pa.array(spare)).filter(pa.array(spare >= 0))

    one = pairs.drop("spare").join(nodes.select(F.col("node").alias("u"), F.col("wide").alias("a"), "n"), "u")
    two = one.join(nodes.select(F.col("node").alias("v"), F.col("wide").alias("b"), F.col("n").alias("m")), "v")
    return two.select(*[f.name for f in kept], "a", "b", "n", "m").mapInArrow(run, ", ".join(f"{f.name} long" for f in kept) + ", spare long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` that reach the threshold on the full ``sets(node, shingles)``."""
    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (a, b))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return two.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the ``wanted(node)`` sets, from one text each."""
    def run(batches):
        shingles = Shingler(size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["node", "shingles"])
        del shingles
        give_back()

    of = nodes.join(wanted, "node").select("place", "node")
    return docs.select("place", "text").join(of, "place").select("node", "text").mapInArrow(run, "node long, shingles binary")


def join(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``place, doc_id, n_shingles, component_id`` for every row of ``docs(place, doc_id, text)``.

    ``place`` is a unique number of the row.  Two rows link when ``100 * |A and B| >= percent * |A or B|``;
    ``component_id`` is the least doc_id of the rows that links reach.

    Null, empty and blank texts have no shingles, link with nothing and are their own component; a text of
    fewer than ``size`` words is one shingle, the whole sequence; rows with equal texts (repeated or not) share
    a component; a null doc_id is passed over when the least is taken; an empty table gives no rows.
    """
    order = crowding(docs, size)
    described = settle(describe(docs.select(F.struct("place", "doc_id").alias("doc_id"), "text"), size, percent, order))
    described = described.select("doc_id.place", "doc_id.doc_id", "key", "n", "prefix", "sketch", "wide")
    firsts = described.where("key IS NOT NULL").groupBy("key").agg(F.min("place").alias("place"))
    # The first row of each set stands for it and lends it its number.
    nodes = settle(described.drop("key", "doc_id").join(firsts.select("place"), "place").withColumn("node", F.col("place")))
    posted = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "group"))
    posted = posted.select("group", "node", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"))

    def shared(batches):
        # Rows whose list has another row; only the last row waits for the next batch.
        held, before = None, None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            group = table.column("group").combine_chunks().to_numpy()
            same = group[1:] == group[:-1]
            keep = np.zeros(len(group), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= before == group[0]
            before = group[-2] if len(group) > 1 else before
            held = table.slice(len(group) - 1).combine_chunks().to_batches()[0]
            yield from table.slice(0, len(group) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
        if held is not None and before == held.column("group")[0].as_py():
            yield held

    lists = settle(posted.repartition("group").sortWithinPartitions("group").mapInArrow(shared, "group long, node long, n int, pos int"))
    large = settle(lists.groupBy("group").count().where(F.col("count") > BLOCK).select("group", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    full = lists.join(nodes.select("node", "sketch"), "node").select("group", "node", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "sketch")
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    blocks = F.when(F.col("blocks").isNull(), F.array(F.struct(F.col("group"), F.lit(-1).alias("half")))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
            F.xxhash64("group", F.least(j, F.col("part")), F.greatest(j, F.col("part"))).alias("group"), F.when(j == F.col("part"), -1).otherwise(F.col("part")).alias("half"))))
    full = full.join(large, "group", "left").withColumn("part", part.cast("int"))
    full = settle(full.select(F.explode(blocks).alias("b"), "node", "n", "pos", "sketch").select("b.group", F.col("b.half").cast("int").alias("half"), "node", "n", "pos", "sketch"))

    # First pass: one tie for each set, to the first partner that reached it.
    tied = candidates(full.withColumn("root", F.col("node")), percent, True, 0.85).select("u", "v").distinct()
    ties = settle(sifted(tied, nodes, percent).groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    sets = settle(full_sets(docs, nodes, ends(ties), size))
    roots = components(settle(verified(ties, sets, percent)))

    def checked(pairs: DataFrame) -> DataFrame:
        nonlocal sets
        sets = sets.unionByName(settle(full_sets(docs, nodes, ends(pairs).join(sets.select("node"), "node", "left_anti"), size)))
        return settle(verified(pairs, sets, percent))

    # Rounds over components: the nearest pair of any two, until most of those tried are no links.
    while not (left := settle(candidates(rooted(full, roots), percent, True))).isEmpty():
        near = sifted(left.select("u", "v", "x", "y").distinct(), nodes, percent)
        near = settle(near.groupBy("x", "y").agg(F.max(F.struct("spare", "u", "v")).alias("p")).select("p.u", "p.v"))
        found = checked(near)
        roots = merged(roots, found)
        full = settle(full.join(left.select("group").distinct(), "group", "left_semi"))
        if 4 * found.count() <= near.count():
            # Last pass: every pair of different components that may be a link.
            rest = candidates(rooted(full, roots), percent, False).select("u", "v").distinct()
            roots = merged(roots, checked(settle(sifted(rest, nodes, percent))))
            break
    last = settle(roots)

    keyed = described.select("place", "doc_id", "n", "key")
    least = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("place").alias("node"), F.min("doc_id").alias("doc_id"))
    of = settle(rooted(least, last).select("key", "doc_id", "root"))
    named = of.join(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("key", "root", "component_id")
    out = keyed.join(named, "key", "left")
    return out.select("place", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce("root", "place").alias("root"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def placed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``place``: the row's number by its place in the stored table."""
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, the one with the least doc_id (then the first), with the columns of ``docs``.

    ``docs`` is read from files, so that rows keep their places while they are read again; a null doc_id comes last.
    """
    joined = settle(join(placed(docs), size=size, percent=percent))
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "place")).alias("f")).select(F.col("f.place").alias("__place"))
    return docs.withColumn("__place", F.monotonically_increasing_id()).join(first, "__place", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: three-word shingles, similarity 0.9."""
    docs = placed(spark.read.parquet(f"{folder}/documents.parquet"))
    return join(docs, size=3, percent=90).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g
    FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
