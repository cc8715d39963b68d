"""Substring dedup by automata of repeated phrases.

A phrase is ``size`` words in a row.  Each phrase holds a mark, the least hash among its runs of ``gram`` words, so
equal phrases have equal marks.  A mark that two texts have makes the stretches of text around it candidates.
Equal stretches are counted, and the stretches of a mark are dealt to one shard of about ``shard`` bytes of different
text.  There every phrase that two documents hold is confirmed and compiled, word by word, into an Aho-Corasick
automaton that knows the least document of each phrase; then the stretches of all documents stream past it, and every
occurrence is reported.  A document that is streamed past the shards of its own marks meets every phrase that it
could hold, so the work follows the repeated text and not documents times shards.

A mark whose different stretches fill more than a shard is dealt anew, one stretch a phrase, by the phrase's own hash.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import give_back, settle_and_free
from ebbflow.llm.shingles import mix

SIZE, GRAM, SHARD = 13, 4, 500_000
#: Most phrases of a stretch: a text that repeats a few words has one mark all along.
STRETCH = 32
#: Bytes of text that are parsed at a time, and marks that travel together.
SLICE, CHUNK = 1 << 21, 1 << 19
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FIRST_OF_ALL = -(1 << 63)
#: First character that spells words; the letters above it suffice for more words than a shard has bytes.
BLANK_PAGE = 0x10000


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, end to end, and where each text begins (and the last one ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


class Marks:
    """Words of texts that lie end to end, and the marks of their phrases."""

    def __init__(self, size: int, gram: int):
        self.size, self.gram = size, min(gram, size)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(SLICE, BASE, np.uint64))
            self.inverse = np.cumprod(np.full(SLICE, pow(BASE, -1, 1 << 64), np.uint64))

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and end byte, text and hash of every word of the texts ``data[at[k]:at[k + 1]]``."""
        base = at[0]
        data, at = data[base:at[-1]], at - base
        if not len(data):
            none = np.empty(0, np.int64)
            return none, none, none, np.empty(0, np.uint64)
        ink = ~BLANK[data]
        begin, stop = ink.copy(), ink.copy()
        begin[1:] &= ~ink[:-1]
        stop[:-1] &= ~ink[1:]
        full = at[1:] > at[:-1]
        head, tail = at[:-1][full], at[1:][full] - 1
        begin[head], stop[tail] = ink[head], ink[tail]
        first, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        hashes, k = np.empty(len(first), np.uint64), 0
        with np.errstate(over="ignore"):
            while k < len(first):
                here = first[k]
                upto = max(k + 1, int(np.searchsorted(end, here + SLICE - 1, "right")))
                size = int(end[upto - 1] - here)
                if size >= SLICE:  # one word
                    hashes[k] = xxhash.xxh3_64_intdigest(data[here:end[k]].tobytes())
                else:
                    sums = np.zeros(size + 1, np.uint64)
                    np.cumsum((data[here:here + size].astype(np.uint64) + np.uint64(1)) * self.power[:size], out=sums[1:])
                    hashes[k:upto] = (sums[end[k:upto] - here] - sums[first[k:upto] - here]) * self.inverse[first[k:upto] - here]
                k = upto
            hashes = mix(hashes)
        return first + base, end + base, np.searchsorted(at, first, "right") - 1, hashes

    def __call__(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mark of the phrase that begins at each word, and whether the phrase ends in the same text."""
        n, size, gram = len(hashes) - self.size + 1, self.size, self.gram
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        m = len(hashes) - gram + 1
        with np.errstate(over="ignore"):
            least = np.zeros(m, np.uint64)
            for k in range(gram):
                least = mix(least + hashes[k:m + k])
        have, want = 1, size - gram + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return least, text[:n] == text[size - 1:]


def slices(at: np.ndarray) -> list[tuple[int, int]]:
    """Rows in runs of about a slice of bytes each (one row at least)."""
    out, k, n = [], 0, len(at) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(at, at[k] + SLICE, "right")) - 1)
        out.append((k, stop))
        k = stop
    return out


def marks(docs: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """``chunk, bucket, marks, owner``: the different marks of every text of ``docs(key, print, text)``, packed.

    A chunk is a run of texts of one task; it has a row for each bucket of marks, which holds the marks in order and the
    number of the text of each, and a row of bucket -1 with the keys and prints of its texts.
    """
    def run(batches):
        find, task, done = Marks(size, gram), TaskContext.get().partitionId(), 0
        held, keys, prints = [], [], []

        def chunk():
            mark, owner = (np.concatenate(c) for c in zip(*held))
            bucket = (mark % np.uint64(buckets)).astype(np.int32)
            by = np.lexsort((mark, bucket))
            mark, owner, bucket = mark[by].view(np.int64), owner[by], bucket[by]
            head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
            ends = [*head[1:].tolist(), len(mark)]
            name = (task << 32) + done
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * (len(head) + 1), pa.int64()), pa.array([-1, *bucket[head].tolist()], pa.int32()),
                pa.array([np.concatenate(keys).tobytes(), *(mark[a:b].tobytes() for a, b in zip(head.tolist(), ends))], pa.binary()),
                pa.array([np.concatenate(prints).tobytes(), *(owner[a:b].tobytes() for a, b in zip(head.tolist(), ends))], pa.binary())], names=["chunk", "bucket", "marks", "owner"])

        texts = 0
        for batch in batches:
            data, at = laid_out(batch.column("text"))
            key, name = batch.column("key").to_numpy(), batch.column("print").to_numpy()
            for a, b in slices(at):
                _, _, text, hashes = find.words(data, at[a:b + 1])
                mark, whole = find(hashes, text)
                mark, text = mark[whole], text[:len(mark)][whole]
                for _ in range(2):  # runs first, which leaves little to sort
                    new = np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))[:len(mark)]
                    mark, text = mark[new], text[new]
                    by = np.lexsort((mark, text))
                    mark, text = mark[by], text[by]
                held.append((mark, (text + texts).astype(np.int32)))
                keys.append(key[a:b])
                prints.append(name[a:b])
                texts += b - a
                if sum(len(m) for m, _ in held) > CHUNK:
                    yield from chunk()
                    held, keys, prints, texts, done = [], [], [], 0, done + 1
        if held:
            yield from chunk()
        give_back()

    return docs.select("key", "print", "text").mapInArrow(run, "chunk long, bucket int, marks binary, owner binary")


def wanted_marks(marked: DataFrame) -> DataFrame:
    """``key, print, marks`` of packed ``marked``: the marks of each text that another text has too, as far as there are any.

    A bucket meets with each mark of a chunk at most as often as texts of the chunk have it, and goes back as one bit a mark.
    """
    def shared(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(m, np.int64) for m in table.column("marks").to_pylist()]
        mark, count = np.unique(np.concatenate(parts), return_counts=True)
        mark = mark[count > 1]
        bits = [np.packbits(np.isin(p, mark)).tobytes() for p in parts]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def of_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = dict(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist()))
        key = name = np.empty(0, np.int64)
        mark, owner = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for bucket, m, o in zip(*(left.column(c).to_pylist() for c in ("bucket", "marks", "owner"))):
            if bucket < 0:
                key, name = np.frombuffer(m, np.int64), np.frombuffer(o, np.int64)
                continue
            keep = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(m) // 8).astype(bool)
            mark.append(np.frombuffer(m, np.int64)[keep])
            owner.append(np.frombuffer(o, np.int32)[keep])
        mark, owner = np.concatenate(mark), np.concatenate(owner)
        by = np.argsort(owner, kind="stable")
        mark, owner = mark[by], owner[by]
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[:len(owner)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(owner)).astype(np.int32)), pa.array(mark))
        return pa.table({"key": key[owner[head]], "print": name[owner[head]], "marks": lists})

    bits = marked.where("bucket >= 0").select("bucket", "chunk", "marks").groupBy("bucket").applyInArrow(shared, "chunk long, bucket int, bits binary")
    found = marked.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(of_chunk, "key long, print long, marks array<long>")
    return found.dropDuplicates(["key", "print"])


def stretches(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``mark, key, print, starts, stretch`` of ``docs(key, print, text, marks)``: the text of the phrases that have one of ``marks``.

    ``starts`` are the numbers of the first words of equal stretches; the words of a stretch are parted by one space.
    """
    def run(batches):
        find = Marks(size, gram)
        for batch in batches:
            data, at = laid_out(batch.column("text"))
            key, name = batch.column("key").to_numpy(), batch.column("print").to_numpy()
            wanted = batch.column("marks")
            for a, b in slices(at):
                first, end, text, hashes = find.words(data, at[a:b + 1])
                mark, whole = find(hashes, text)
                if not whole.any():
                    continue
                part = wanted.slice(a, b - a)
                owner = mix(np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy())).astype(np.uint64))
                with np.errstate(over="ignore"):
                    known = mix(part.flatten().to_numpy().view(np.uint64) + owner)
                    hit = whole & np.isin(mix(mark + mix(text[:len(mark)].astype(np.uint64))), known)
                place = np.flatnonzero(hit)
                if not len(place):
                    continue
                new = np.append(True, (place[1:] != place[:-1] + 1) | (mark[place[1:]] != mark[place[:-1]]) | (text[place[1:]] != text[place[:-1]]))
                run_of = np.cumsum(new) - 1
                since = np.arange(len(place)) - np.flatnonzero(new)[run_of]
                head = np.flatnonzero(since % STRETCH == 0)
                last = place[np.append(head[1:], len(place)) - 1]
                head = place[head]
                raw = data.tobytes() if len(data) < 2 * SLICE else None
                cut = zip(first[head].tolist(), end[last + size - 1].tolist())
                found = [b" ".join((raw[x:y] if raw is not None else data[x:y].tobytes()).split()) for x, y in cut]
                begins = np.searchsorted(text, text[head], "left")
                same: dict[tuple[int, int, bytes], list[int]] = {}
                for at_row, m, start, stretch in zip((text[head] + a).tolist(), mark[head].view(np.int64).tolist(), (head - begins).tolist(), found):
                    same.setdefault((at_row, m, stretch), []).append(start)
                row, m, stretch = zip(*same)
                row = np.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(key[row]), pa.array(name[row]), pa.array(list(same.values()), pa.list_(pa.int64())),
                                                  pa.array(stretch, pa.binary())], names=["mark", "key", "print", "starts", "stretch"])
        give_back()

    return docs.mapInArrow(run, "mark long, key long, print long, starts array<long>, stretch binary")


def single_phrases(found: DataFrame, size: int) -> DataFrame:
    """The same rows with every stretch cut into its phrases, whose own hash takes the place of the mark."""
    def run(batches):
        for batch in batches:
            out = []
            for key, name, starts, stretch in zip(*(batch.column(c).to_pylist() for c in ("key", "print", "starts", "stretch"))):
                words = stretch.split(b" ")
                for k in range(len(words) - size + 1):
                    phrase = b" ".join(words[k:k + size])
                    out.append((xxhash.xxh3_64_intdigest(phrase) - (1 << 63), key, name, [s + k for s in starts], phrase))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.binary())],
                                             names=["mark", "key", "print", "starts", "stretch"])

    return found.mapInArrow(run, found.schema)


def occurrences(stretch: list[bytes], least: list[int], greatest: list[int], size: int) -> list[tuple[list[int], list[int]]]:
    """For each stretch, where a phrase begins that documents of different keys hold, and the least key of that phrase.

    ``least`` and ``greatest`` are the keys of the documents that hold the stretch.
    """
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in text.split(b" ")] for text in stretch]
    # Two letters a word, from two alphabets: no node of the automaton has a child for each different word.
    base = math.isqrt(len(number)) + 1
    letters = [chr(BLANK_PAGE + k // base) + chr(BLANK_PAGE + base + k % base) for k in range(len(number))]
    spelled = ["".join([letters[k] for k in row]) for row in rows]
    del rows, number
    held: dict[str, tuple[int, int]] = {}
    for text, a, b in zip(spelled, least, greatest):
        for k in range(0, len(text) - 2 * size + 1, 2):
            phrase = text[k:k + 2 * size]
            old = held.get(phrase)
            held[phrase] = (a, b) if old is None else (min(old[0], a), max(old[1], b))
    automaton = ahocorasick.Automaton()
    for phrase, (a, b) in held.items():
        if a < b:
            automaton.add_word(phrase, a)
    if not len(automaton):
        return [([], [])] * len(stretch)
    held.clear()
    automaton.make_automaton()
    out = []
    for text in spelled:
        found = list(automaton.iter(text))
        out.append(([end // 2 - size + 1 for end, _ in found], [a for _, a in found]))
    return out


def locate(different: DataFrame, shards: int, size: int) -> DataFrame:
    """``mark, name, hits``: the confirmed phrases of each of ``different(mark, stretch, least, greatest)``.

    ``name`` is the hash of the stretch; a hit is a run of ``n`` phrases from word ``at`` on that have one ``least`` key.
    """
    def run(table: pa.Table) -> pa.Table:
        found = occurrences(*(table.column(c).to_pylist() for c in ("stretch", "least", "greatest")), size)
        of = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
        at, least = (np.array([x for pair in found for x in pair[k]], np.int64) for k in (0, 1))
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))[:len(at)])
        hits = pa.StructArray.from_arrays([pa.array(at[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(at))).astype(np.int32)), pa.array(least[new])], names=["at", "n", "least"])
        ends = np.searchsorted(of[new], np.arange(len(found) + 1)).astype(np.int32)
        out = pa.table({"mark": table.column("mark"), "name": table.column("name"), "hits": pa.ListArray.from_arrays(pa.array(ends), hits)})
        del found, of, at, least
        give_back()
        return out

    dealt = different.select(F.pmod("mark", F.lit(shards)).alias("shard"), "mark", F.xxhash64("stretch").alias("name"), "stretch", "least", "greatest")
    return dealt.groupBy("shard").applyInArrow(run, "mark long, name long, hits array<struct<at:int,n:int,least:long>>")


def grouped(found: DataFrame) -> DataFrame:
    """``mark, stretch, least, greatest``: the different stretches and the least and greatest key that each has."""
    return found.groupBy("mark", "stretch").agg(F.min("key").alias("least"), F.max("key").alias("greatest"))


def remove_repeats(docs: DataFrame, *, size: int = SIZE, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``doc_id, text, n_words, n_removed, spans`` for every row of ``docs``; needs ``doc_id`` (an integer) and ``text``.

    Words are parted by ASCII white space.  A word goes if it lies in ``size`` words in a row that also stand in a document
    with a smaller doc_id; all is judged on the input.  ``text`` holds the words that stay, parted by one space, ``spans``
    the runs of removed words (first, end).  A null text has no words and becomes empty, as does a blank one; a text of
    fewer than ``size`` words keeps all.  A null doc_id is smaller than any other.  Rows of one doc_id, repeated rows among
    them, remove nothing from each other.  Other columns are left out, whatever their names; an empty table gives no rows.

    A text is parsed in one task (some ten times its size in memory); no task gathers the documents of a mark or phrase.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_OF_ALL)).alias("key"), F.xxhash64("text").alias("print"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = settle_and_free(marks(docs, size, gram, buckets))
    wanted = settle_and_free(wanted_marks(marked), marked)
    found = settle_and_free(stretches(docs.join(wanted, ["key", "print"]).select("key", "print", "text", "marks"), size, gram), wanted)
    different = settle_and_free(grouped(found))
    full = settle_and_free(different.groupBy("mark").agg(F.sum(F.length("stretch")).alias("bytes")).where(F.col("bytes") > shard).select("mark"))
    tables = [found]
    if not full.isEmpty():
        hot = settle_and_free(single_phrases(found.join(full, "mark", "left_semi"), size))
        tables.append(hot)
        found = found.join(full, "mark", "left_anti").unionByName(hot)
        different = settle_and_free(different.join(full, "mark", "left_anti").unionByName(grouped(hot)), different)
    total = different.agg(F.sum(F.length("stretch"))).first()[0] or 0
    hits = settle_and_free(locate(different, max(1, math.ceil(total / shard)), size).where(F.size("hits") > 0), different)
    met = found.select("mark", F.xxhash64("stretch").alias("name"), "key", "print", "starts").join(hits, ["mark", "name"])
    own = F.filter("hits", lambda x: x["least"] < F.col("key"))
    met = met.select("key", "print", "starts", own.alias("own")).where(F.size("own") > 0)
    runs = F.flatten(F.transform("starts", lambda s: F.transform("own", lambda x: F.struct((x["at"] + s).alias("at"), x["n"].alias("n")))))
    gone = settle_and_free(met.select("key", "print", runs.alias("runs")).groupBy("key", "print").agg(F.flatten(F.collect_list("runs")).alias("runs")), *tables, hits)

    def cut(batches):
        for batch in batches:
            text, runs = batch.column("text").cast(pa.binary()), batch.column("runs")
            kept, count, removed, spans = [], [], [], []
            for t, phrases in zip(text, runs):
                words = (t.as_py() or b"").split()
                count.append(len(words))
                if not phrases.is_valid:
                    kept.append(b" ".join(words))
                    removed.append(0)
                    spans.append([])
                    continue
                step = np.zeros(len(words) + 1, np.int64)
                place, n = (phrases.values.field(k).to_numpy() for k in (0, 1))
                np.add.at(step, place, 1)
                np.add.at(step, place + n + size - 1, -1)
                drop = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                removed.append(int(drop.sum()))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                keep = np.concatenate([[0], edge, [len(words)]])
                kept.append(b" ".join([w for a, b in zip(keep[::2], keep[1::2]) for w in words[a:b]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string(), safe=False), pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "text", "n_words", "n_removed", "spans"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.join(gone, ["key", "print"], "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(cut, f"doc_id {kind}, text string, n_words long, n_removed long, spans array<struct<first:long,end:long>>")


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without phrases of 13 words that an earlier document holds."""
    found = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM t)),
later AS (SELECT doc_id, k FROM p QUALIFY min(doc_id) OVER (PARTITION BY phrase) < doc_id),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM later, unnest(range(0, 13)) AS u(j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
