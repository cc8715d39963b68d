"""Removal of long repeated byte strings by suffix arrays of content-dealt shards.

Every string of ``length`` bytes holds one marked place: the k-gram with the least hash (the last of equals).
Equal strings have equal marks, so all strings with one mark can be dealt to one shard by the mark's hash, and
each start of a string is dealt exactly once.  Marks whose hash occurs once cannot repeat and are dropped
before any text moves.  What remains travels as fragments (the text around a mark from whose starts the mark is
the least), equal fragments of a shard are counted once, and the suffixes of a shard's fragments whose mark has
several are sorted by induction with their common-prefix values (``induced``).  A start whose suffix shares ``length`` bytes with another start is
a repeat.  Shards are closed at about ``shard`` bytes of distinct text and sorted in memory.

The strings of a mark with more text than that are dealt anew by a second mark, the least among their k-grams under
a hash salted by the first, and so on while that parts them: equal strings still meet, and each start still goes out
once.  There equal fragments are counted before they are dealt, so copies of a passage do not meet in one task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import give_back
from ebbflow.llm.induced import suffix_order
from ebbflow.llm.shingles import mix
from ebbflow.session import settle

LENGTH, GRAM, SHARD = 400, 50, 4_000_000
SEGMENT = 1 << 20
SENT_MARKS, SENT_BYTES = 20_000, 1 << 20  # a batch that a task sends on is closed at so many
BASE = 0x9E3779B97F4A7C15
SPANS = "array<struct<begin:long,stop:long>>"


class Marks:
    """The marked places of a text: hash of the mark, first and last start of a string whose mark it is."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(SEGMENT + length, BASE, np.uint64))
            self.inverse = np.cumprod(np.full(SEGMENT + length, pow(BASE, -1, 1 << 64), np.uint64))

    def __call__(self, data: bytes, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self._segment(np.frombuffer(data, np.uint8, min(len(data) - at, SEGMENT), at), at, salt)
                 for at in range(0, max(0, len(data) - self.length + 1), SEGMENT - self.length + 1)]
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(map(np.concatenate, zip(*parts)))

    def _segment(self, data: np.ndarray, offset: int, salt: int):
        n, w = len(data), self.width
        with np.errstate(over="ignore"):
            sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n])
            hashes = sums[self.gram - 1:].copy()
            hashes[1:] -= sums[:-self.gram]
            hashes = mix(hashes * self.inverse[:len(hashes)] + np.uint64(salt))
        # Hash above, place below and counted down: the least key is the last of the least hashes.
        keys = (hashes & np.uint64((1 << 64) - SEGMENT)) | np.arange(SEGMENT - 1, SEGMENT - 1 - len(hashes), -1, dtype=np.int64).astype(np.uint64)
        padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(keys)] = keys
        grid = padded.reshape(-1, w)
        upto = np.minimum.accumulate(grid, axis=1).reshape(-1)
        since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        starts = len(keys) - w + 1
        least = np.minimum(since[:starts], upto[w - 1:w - 1 + starts])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        place = (np.uint64(SEGMENT - 1) - (least[first] & np.uint64(SEGMENT - 1))).astype(np.int64)
        return hashes[place], first + offset, np.append(first[1:], starts) - 1 + offset


def to_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def marks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``mark, place, firsts, lasts``: one row for each different mark of a text of ``docs(place, text)``.

    A text that repeats a few letters has the same mark over and over; it still sends few rows.
    """
    def rows(places, parts):
        mark, first, last = map(np.concatenate, zip(*parts))
        text = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        by = np.lexsort((mark, text))
        mark, text = mark[by], text[by]
        head = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])))
        ends = pa.array(np.append(head, len(mark)).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            pa.array(mark[head].view(np.int64)), pa.array(np.array(places, np.int64)[text[head]]), pa.ListArray.from_arrays(ends, pa.array(first[by])),
            pa.ListArray.from_arrays(ends, pa.array(last[by]))], names=["mark", "place", "firsts", "lasts"])

    def run(batches):
        find = Marks(length, gram)
        for batch in batches:
            places, parts, size = [], [], 0
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = find(to_bytes(text))
                if len(part[0]):
                    places.append(place)
                    parts.append(part)
                    size += len(part[0])
                if size >= SENT_MARKS:
                    yield rows(places, parts)
                    places, parts, size = [], [], 0
            if size:
                yield rows(places, parts)

    return docs.select("place", "text").mapInArrow(run, "mark long, place long, firsts array<long>, lasts array<long>")


def repeated_marks(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose mark has another row, or another place in its own."""
    def several(rows) -> np.ndarray:
        return np.array([len(f) > 1 for f in rows.column("firsts").to_pylist()], bool)

    def run(batches):
        held, before = None, None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            mark = table.column("mark").combine_chunks().to_numpy()
            same = mark[1:] == mark[:-1]
            keep = several(table).copy()
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= before == mark[0]
            before = mark[-2] if len(mark) > 1 else before
            held = table.slice(len(mark) - 1).combine_chunks().to_batches()[0]
            yield from table.slice(0, len(mark) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
        if held is not None and (before == held.column("mark")[0].as_py() or several(held)[0]):
            yield held

    return found.repartition("mark").sortWithinPartitions("mark").mapInArrow(run, found.schema)


def fragment_rows(rows: list[tuple[int, int, list[int], bytes]]) -> pa.RecordBatch:
    mark, place, firsts, fragment = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(mark, pa.int64()), pa.array(place, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(fragment, pa.binary())],
                                      names=["mark", "place", "firsts", "fragment"])


def fragments(candidates: DataFrame, length: int) -> DataFrame:
    """``mark, place, firsts, fragment``: the text of all strings whose mark it is, equal texts of a row once."""
    def ends(lists):
        return (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            found = batch.column("found")
            mark, firsts, lasts = found.flatten().flatten()
            of_text, of_mark = ends(found), ends(firsts)
            mark, first, last = mark.to_pylist(), firsts.flatten().to_pylist(), lasts.flatten().to_pylist()
            rows, size = [], 0
            for nth, (place, text) in enumerate(zip(batch.column("place").to_pylist(), batch.column("text").to_pylist())):
                data = to_bytes(text)
                for k in range(of_text[nth], of_text[nth + 1]):
                    at = {}
                    for j in range(of_mark[k], of_mark[k + 1]):
                        at.setdefault(data[first[j]:last[j] + length], []).append(first[j])
                    for part, begin in at.items():
                        rows.append((mark[k], place, begin, part))
                        size += len(part)
                    if size >= SENT_BYTES:
                        yield fragment_rows(rows)
                        rows, size = [], 0
            if rows:
                yield fragment_rows(rows)

    return candidates.mapInArrow(run, "mark long, place long, firsts array<long>, fragment binary")


def repeats(fragment: list[bytes], mark: list[int], count: list[int], length: int, in_memory: int = 1 << 28) -> list[np.ndarray]:
    """For each distinct fragment, which of its starts begin a string of ``length`` bytes that another start begins too.

    ``count`` is how often the fragment occurs; all of its starts repeat if that is more than once.  Strings with other
    marks differ, and so do the strings around one marked place: the only fragment of its ``mark`` is not sorted.
    """
    out = [np.full(len(f) - length + 1, c > 1) for f, c in zip(fragment, count)]
    _, which, several = np.unique(np.array(mark, np.int64), return_inverse=True, return_counts=True)
    compared = np.flatnonzero(several[which] > 1)
    if not len(compared):
        return out
    fragment = [fragment[k] for k in compared]
    size = np.array([len(f) for f in fragment], np.int64)
    begin = np.cumsum(np.append(0, size + 1))
    text = np.frombuffer(b"\0".join(fragment) + b"\0", np.uint8)
    order, shared = suffix_order(text, length, in_memory)
    start = np.zeros(len(text), bool)
    for b, s in zip(begin, size):
        start[b:b + s - length + 1] = True
    at = np.flatnonzero(start[order])
    hit = np.zeros(len(text), bool)
    if len(at) > 1:
        # Two starts share the least of the values between them.
        least = np.minimum.reduceat(shared, at[:-1] + 1) if at[-1] + 1 >= len(shared) else np.minimum.reduceat(shared[:at[-1] + 1], at[:-1] + 1)
        equal = least >= length
        hit[order[at[1:][equal]]] = True
        hit[order[at[:-1][equal]]] = True
    for k, b, s in zip(compared, begin, size):
        out[k] |= hit[b:b + s - length + 1]
    return out


def spans_of(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered bytes of a run of starts, as half-open intervals."""
    at = np.flatnonzero(hit)
    if not at.size:
        return []
    cut = np.flatnonzero(at[1:] - at[:-1] > length)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist()))


def shards(batches, shard: int):
    """Rows of ``mark, id, firsts, fragment`` in the order of their marks, as ``(distinct fragments, their marks, [(id, firsts, number of the fragment)])``."""
    known: dict[tuple[int, bytes], int] = {}
    rows: list[tuple[int, list[int], int]] = []
    size, starts, mark = 0, 0, None
    for batch in batches:
        for m, p, firsts, fragment in zip(*(c.to_pylist() for c in batch.columns)):
            if m != mark and (size >= shard or starts >= shard // 16):
                yield [f for _, f in known], [k for k, _ in known], rows
                known, rows, size, starts = {}, [], 0, 0
            mark = m
            starts += len(firsts)
            if (m, fragment) not in known:
                known[m, fragment] = len(known)
                size += len(fragment)
            rows.append((p, firsts, known[m, fragment]))
    if rows:
        yield [f for _, f in known], [k for k, _ in known], rows


def by_mark(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("mark").sortWithinPartitions("mark")


def shard_spans(dealt: DataFrame, length: int, shard: int) -> DataFrame:
    """``place, begin, stop``: what the repeats of each shard cover."""
    def run(batches):
        for texts, of, rows in shards(batches, shard):
            hits = repeats(texts, of, np.bincount([r[2] for r in rows], [len(r[1]) for r in rows], minlength=len(texts)), length)
            spans = [spans_of(hit, length) for hit in hits]
            place, begin, stop = [], [], []
            for p, firsts, which in rows:
                for a, b in spans[which]:
                    place.extend([p] * len(firsts))
                    begin.extend([a + first for first in firsts])
                    stop.extend([b + first for first in firsts])
            del hits, spans
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], names=["place", "begin", "stop"])
        give_back()

    return by_mark(dealt.select("mark", "place", "firsts", "fragment")).mapInArrow(run, "place long, begin long, stop long")


def text_spans(texts: DataFrame, length: int, shard: int) -> DataFrame:
    """``mark, fragment, spans`` of the rows of ``texts(mark, fragment, n)``, each there once, that hold repeats."""
    def run(batches):
        for names, of, rows in shards(batches, shard):
            hits = repeats(names, of, np.bincount([r[2] for r in rows], [len(r[1]) for r in rows], minlength=len(names)), length)
            spans = [[{"begin": a, "stop": b} for a, b in spans_of(hits[which], length)] for _, _, which in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([names[r[2]] for r in rows], pa.binary()),
                                              pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])))], names=["mark", "fragment", "spans"])
        give_back()

    zero = F.lit(0).cast("long")
    copies = F.when(F.col("n") > 1, F.array(zero, zero)).otherwise(F.array(zero))
    rows = by_mark(texts.select("mark", F.col("mark").alias("id"), copies.alias("firsts"), "fragment"))
    return rows.mapInArrow(run, f"mark long, fragment binary, spans {SPANS}").where(F.size("spans") > 0)


def dealt_anew(dealt: DataFrame, length: int, gram: int, level: int) -> DataFrame:
    """The fragments in ``dealt`` cut by a second mark of their strings; the mark so far and ``level`` salt its hash."""
    def run(batches):
        find = Marks(length, gram)
        for batch in batches:
            for m, place, firsts, fragment in zip(*(c.to_pylist() for c in batch.columns)):
                at: dict[tuple[int, bytes], list[int]] = {}
                salt = mix(np.array([(m + level) % (1 << 64)], np.uint64))
                for second, first, last in zip(*(c.tolist() for c in find(fragment, int(salt[0])))):
                    at.setdefault((second, fragment[first:last + length]), []).extend(f + first for f in firsts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(mix(np.array([k for k, _ in at], np.uint64) ^ salt).view(np.int64)), pa.array([place] * len(at), pa.int64()),
                    pa.array(list(at.values()), pa.list_(pa.int64())), pa.array([text for _, text in at], pa.binary())], names=["mark", "place", "firsts", "fragment"])

    return dealt.select("mark", "place", "firsts", "fragment").mapInArrow(run, "mark long, place long, firsts array<long>, fragment binary")


def distinct_texts(dealt: DataFrame) -> DataFrame:
    """``mark, fragment, n``: the different fragments of each mark, and how often they occur."""
    return dealt.groupBy("mark", "fragment").agg(F.sum(F.size("firsts")).alias("n"))


def hot_spans(hot: DataFrame, length: int, gram: int, shard: int) -> DataFrame:
    """``place, begin, stop`` as of ``shard_spans``, for marks that may have more text than a shard."""
    done, level, before = [], 0, None
    while True:
        hot = settle(hot)
        over = distinct_texts(hot).groupBy("mark").agg(F.sum(F.octet_length("fragment")).alias("size")).where(F.col("size") > shard)
        over = settle(over)
        most = over.agg(F.max("size")).first()[0]
        if most is None or gram == length:
            done.append(hot)
            break
        done.append(hot.join(over, "mark", "left_anti"))
        if before is not None and 2 * most > before:
            gram = length  # texts that differ in few places share most k-grams: each string is its own mark
        before, level = most, level + 1
        hot = dealt_anew(hot.join(over, "mark", "left_semi"), length, gram, level)

    def spans(rows):
        found = rows.join(text_spans(distinct_texts(rows), length, shard), ["mark", "fragment"])
        found = found.select("place", F.explode("firsts").alias("first"), "spans").select("place", "first", F.explode("spans").alias("s"))
        return found.select("place", (F.col("first") + F.col("s.begin")).alias("begin"), (F.col("first") + F.col("s.stop")).alias("stop"))

    return functools.reduce(DataFrame.unionByName, map(spans, done))


def union_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal covered runs of overlapping or touching intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["begin"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)]))


def deduplicate(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``place, spans, kept`` of the rows of ``docs(place, text)`` that lose bytes; ``place`` is unique.

    ``spans`` are the maximal runs of removed UTF-8 bytes, ``kept`` the bytes that are left.  A byte goes if some string
    of ``length`` bytes covers it that also starts anywhere else, in the same text or another; strings may overlap and
    are judged on the input.  Rows that are not returned keep all their bytes: null, empty and shorter texts
    always.  Repeated rows repeat each other; an empty table gives no rows.
    """
    found = settle(repeated_marks(marks(docs, length, gram)))
    # A mark whose strings, copies included, fill no shard needs no second one.
    size = F.aggregate(F.zip_with("firsts", "lasts", lambda a, b: b - a + F.lit(length)), F.lit(0).cast("long"), lambda n, k: n + k)
    hot = settle(found.groupBy("mark").agg(F.sum(size).alias("size")).where(F.col("size") > shard).select("mark"))
    one = F.struct("mark", "firsts", "lasts")
    if hot.isEmpty():
        by_place = found.groupBy("place").agg(F.collect_list(one).alias("found"))
    else:
        parted = found.join(hot.withColumn("hot", F.lit(True)), "mark", "left")
        by_place = parted.groupBy("place").agg(F.collect_list(F.when(F.col("hot").isNull(), one)).alias("found"), F.collect_list(F.when(F.col("hot"), one)).alias("hot"))
    candidates = settle(docs.select("place", "text").join(by_place, "place"))
    spans = shard_spans(fragments(candidates.where(F.size("found") > 0), length), length, shard)
    if "hot" in candidates.columns:
        of_hot = fragments(candidates.where(F.size("hot") > 0).select("place", "text", F.col("hot").alias("found")), length)
        spans = spans.unionByName(hot_spans(of_hot, length, gram, shard))
    spans = settle(spans.groupBy("place").agg(F.collect_list(F.struct("begin", "stop")).alias("spans")))

    def run(batches):
        for batch in batches:
            runs = [union_spans(s) for s in batch.column("spans").to_pylist()]
            kept = [cut(to_bytes(t), r) for t, r in zip(batch.column("text").to_pylist(), runs)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([[{"begin": a, "stop": b} for a, b in r] for r in runs], pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))),
                                              pa.array(kept, pa.binary())], names=["place", "spans", "kept"])

    return candidates.select("place", "text").join(spans, "place").mapInArrow(run, f"place long, spans {SPANS}, kept binary")


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: strings of 400 bytes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    changed = deduplicate(docs).select("place", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("rest"))
    whole = F.coalesce("text", F.lit(""))
    every = docs.select("place", "doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("whole"))
    none = F.lit(0).cast("long")
    return every.join(changed, "place", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
                                                       F.coalesce("rest", "whole").alias("kept_sha256"))
