"""Benchmark decontamination with sharded suffix arrays of the training text.

The benchmark's words are numbered, and its suffixes (one for every window start) are sorted.  Tasks read
training documents in shards, number their words alike (words that no item has part the text), build the
suffix array of the shard and binary-search every test suffix in it.  An interval of the array holds all
occurrences of a window; from there the match runs on as long as both texts agree, which gives the
longest verbatim match and its place.  Nothing is shuffled and no shard depends on another, so a lost
task is run again by itself.

The suffix array of a shard covers the places from which a window could fit into known words; it is sorted
as deep as the longest window by doubling the compared length.  A test suffix is searched by its window, so
documents that repeat a passage cost one interval, not one search each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm.common import give_back
from ebbflow.session import settle

WINDOW = 10

SPANS = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()),
                                  T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.IntegerType())]))
ARROW_SPANS = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int64()), ("n_words", pa.int32())]))

#: A-Z become lower case; digits, letters and every byte of other scripts are kept; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class TestSet:
    """Numbered words and the sorted windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        items = [(k, w) for k, w in items if w]
        self.words = {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.ids = [k for k, _ in items]
        self.window = window
        self.shortest = min([window, *(len(w) for _, w in items)])
        self.text = np.array([n for _, ws in items for n in (*(self.words[w] for w in ws), 0)] + [0] * window, np.int64)
        self.item = np.array([k for k, (_, ws) in enumerate(items) for _ in range(len(ws) + 1)] + [len(items)] * window, np.int64)
        starts = np.cumsum([0, *(len(ws) + 1 for _, ws in items)])
        self.first = starts[:-1]
        at, size = [], []
        for s, (_, ws) in zip(starts, items):
            n = max(1, len(ws) - window + 1)
            at.append(np.arange(s, s + n))
            size.append(np.full(n, min(window, len(ws))))
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)
        self.size = np.concatenate(size) if size else np.empty(0, np.int64)


def suffix_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` of ``text`` in the order of the ``depth`` words that start there (0 past the end)."""
    rank, length = text.astype(np.int64), 1
    padded = np.zeros(len(text) + depth + 1, np.int64)
    bits = max(1, int(rank.max(initial=0)).bit_length())
    # Pack as many words into one number as it holds, then double.
    while length * 2 <= depth * 2 and bits * 2 <= 62 and length < depth:
        padded[:len(text)] = rank
        rank = (rank << bits) | padded[length:length + len(text)]
        length, bits = 2 * length, 2 * bits
    while length < depth:
        _, rank = np.unique(rank, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        bits = max(1, int(rank.max(initial=0)).bit_length())
        padded[:len(text)] = rank
        padded[len(text):] = 0
        rank = (rank << bits) | padded[length:length + len(text)]
        length *= 2
    return at[np.argsort(rank[at], kind="stable")]


def search(text: np.ndarray, order: np.ndarray, tests: TestSet, upper: bool) -> np.ndarray:
    """For every window the first place in ``order`` whose words are not below it (or are above it)."""
    low, high = np.zeros(len(tests.at), np.int64), np.full(len(tests.at), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        here, there = order[mid], tests.at[open_]
        sign, alive = np.zeros(len(open_), np.int64), np.arange(len(open_))
        for k in range(tests.window):
            alive = alive[(sign[alive] == 0) & (tests.size[open_[alive]] > k)]
            if not alive.size:
                break
            sign[alive] = np.sign(text[here[alive] + k] - tests.text[there[alive] + k])
        right = sign <= 0 if upper else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


def matches(text: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal verbatim matches of at least a window: place in ``text``, place in the tests, words."""
    none = np.empty(0, np.int64)
    if not len(tests.at) or not len(text):
        return none, none, none
    known = text > 0
    ends = np.where(known, len(text), np.arange(len(text)))
    run = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(text))
    at = np.flatnonzero(run >= tests.shortest)
    padded = np.concatenate([text, np.zeros(tests.window + 1, text.dtype)])
    order = suffix_order(text, at, tests.window)
    low, high = search(padded, order, tests, False), search(padded, order, tests, True)
    count = high - low
    if not count.sum():
        return none, none, none
    which = np.repeat(np.arange(len(count)), count)
    place = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    test, size = tests.at[which], tests.size[which]
    # Windows that follow each other along both texts make one longer match.
    diagonal = place - test
    by = np.lexsort((place, diagonal))
    place, test, size, diagonal = place[by], test[by], size[by], diagonal[by]
    new = np.ones(len(by), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(by)) - 1
    return place[head], test[head], place[tail] + size[tail] - place[head]


def _scan(tests: TestSet, shard_words: int):
    def scan(batches):
        for batch in batches:
            names = batch.schema.names
            texts, before = batch.column(names.index("text")), batch.column(names.index("spans")).to_pylist()
            hits, n_words, rows, shard, size = [None] * len(texts), [0] * len(texts), [], [], 0

            def flush():
                text = np.concatenate(shard) if shard else np.empty(0, np.int64)
                starts = np.cumsum([0, *map(len, shard)])
                for lo in range(0, max(1, len(text)), shard_words):
                    # A document longer than a shard is cut; neighbours overlap by all but one word of a window.
                    piece = text[lo:lo + shard_words + tests.window - 1]
                    for p, q, n in zip(*matches(piece, tests)):
                        k = int(np.searchsorted(starts, p + lo, "right")) - 1
                        item = int(tests.item[q])
                        hits[rows[k]].append({"item_id": tests.ids[item], "item_word": int(q - tests.first[item]),
                                              "doc_word": int(p + lo - starts[k]), "n_words": int(n)})

            for k, text in enumerate(texts):
                found = split_words(text.as_py())
                n_words[k], hits[k] = len(found), list(before[k] or [])
                if found:
                    shard.append(np.fromiter((tests.words.get(w, 0) for w in found), np.int64, len(found)))
                    shard[-1] = np.append(shard[-1], 0)
                    rows.append(k)
                    size += len(found)
                if size >= shard_words:
                    flush()
                    rows, shard, size = [], [], 0
            flush()
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            columns |= {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(hits, ARROW_SPANS)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        give_back()

    return scan


def test_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, list[bytes]]]]:
    """The distinct items in blocks of at most ``block_bytes`` of text (or one longer item), read one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, split_words(r.text)) for r in part.collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = 32_000_000,
                 shard_words: int = 1_000_000) -> DataFrame:
    """``docs`` with ``n_words`` and ``spans``: maximal verbatim matches ``(item_id, item_word, doc_word, n_words)``.

    Words are runs of letters and digits, A-Z in lower case.  A match has ``window`` words or more, or is the
    whole of a shorter item; windows that follow each other in both texts are one match.  The benchmark is sent
    out in blocks of bounded size, each against all documents; with more than one block the documents found so
    far are written between them.

    Null and empty texts have no words and no spans; an item without words matches nothing; equal rows of the
    benchmark match once, other texts of an item_id on their own; an empty benchmark leaves every document clean; columns named like the results are replaced.
    """
    out = docs.drop("n_words", "spans").withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPANS)})
    schema = out.schema
    for k, block in enumerate(test_blocks(benchmark, block_bytes)):
        sent = docs.sparkSession.sparkContext.broadcast(TestSet(block, window))
        out = (settle(out) if k else out).mapInArrow(lambda batches, sent=sent: _scan(sent.value, shard_words)(batches), schema)
    return out


def digest(found: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    # Spans in order of their start cover, each, what lies past the farthest end so far.
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["doc_word"].alias("a"), (s["doc_word"] + s["n_words"]).alias("b"))))
    covered = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), items.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any match, with the columns of ``docs``; see ``find_matches``.

    Columns of ``docs`` that are called ``n_words`` or ``spans`` pass through unchanged.
    """
    held = {c: f"__kept_{c}" for c in docs.columns if c in ("n_words", "spans")}
    found = find_matches(docs.withColumnsRenamed(held), benchmark, **options)
    clean = found.where(F.coalesce(F.size("spans"), F.lit(0)) <= 0).drop("n_words", "spans")
    return clean.withColumnsRenamed({v: k for k, v in held.items()}).select(*[f"`{c}`" for c in docs.columns])


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, tests = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(find_matches(docs.select("doc_id", "text"), tests).select("doc_id", "n_words", "spans"))


SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
    FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (SELECT p.doc_id, p.i, p.n, item_id FROM (
        SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n) p JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
