"""Token ids in bit- or byte-plane shuffled chunks.

Documents are dealt by ranges of their id, encoded in order, and their ids cut into blocks of a fixed
number of ids.  A block is transposed into planes (all lowest bytes, then all second bytes, and so on;
or the same with bits), and each plane is compressed with zstandard by itself: the high planes hardly
vary.  A written folder holds

``chunks``  one row a block: range number, block number, number of ids, payload, and the documents
            (id, number in the range, ids of the document) whose ids lie in the block;
``index``   one row a block: range number, block number, position of its first id among all ids, number of ids.

Both are Parquet, so any store that Spark reaches will do, and a task that is run again writes the same.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ebbflow.llm.common import give_back

KEEP = 1_400_000
MAGIC = b"BPL1"
HEADER = "<4sBBBI"  # magic, 1 for bits or 8 for bytes, planes, 0, ids

def pack(ids: np.ndarray, width: int, plane: str = "byte", level: int = 3) -> bytes:
    """One block: ``width`` bytes of every id, as planes that are compressed one by one."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if width < 4 and len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"an id needs more than {width} bytes")
    planes = ids.view(np.uint8).reshape(-1, 4)[:, :width].T
    if plane == "bit":
        planes = np.packbits(np.unpackbits(np.ascontiguousarray(planes)[:, :, None], axis=2, bitorder="little")
                             .transpose(0, 2, 1).reshape(8 * width, -1), axis=1)
    elif plane != "byte":
        raise ValueError("plane must be 'byte' or 'bit'")
    press = zstandard.ZstdCompressor(level=level)
    parts = [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    head = struct.pack(HEADER, MAGIC, 1 if plane == "bit" else 8, len(parts), 0, len(ids))
    return head + struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of one block, as unsigned 32-bit numbers."""
    magic, bits, count, _, n = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    sizes = struct.unpack_from(f"<{count}I", payload, struct.calcsize(HEADER))
    at, out, width = struct.calcsize(HEADER) + 4 * count, np.zeros((n, 4), np.uint8), count * bits // 8
    loose, planes = zstandard.ZstdDecompressor(), []
    for size in sizes:
        planes.append(np.frombuffer(loose.decompress(payload[at:at + size]), np.uint8))
        at += size
    if bits == 8:
        for k, p in enumerate(planes):
            out[:, k] = p
    elif n:
        rows = np.unpackbits(np.stack(planes), axis=1, count=n).reshape(width, 8, n)
        out[:, :width] = np.packbits(rows, axis=1, bitorder="little").reshape(width, n).T
    return out.view("<u4").reshape(-1)


class Known(dict):
    """What parts of texts came to; ``make`` is asked for the others.

    Once half of ``keep`` parts are held, they become the old half and replace the old half before them; an old
    part that is asked for again is taken over.
    """

    def __init__(self, keep: int, make):
        self.half, self.make, self.old = max(1, keep // 2), make, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.make(part)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Encoder:
    """Encodes with a tokenizer file and keeps what up to ``keep`` parts of texts came to.

    Before its merges a byte-level vocabulary cuts a text into pieces, and a space or line feed after any other
    character always begins one, so texts are cut there and the library encodes each part once.  Texts for which
    that is not certain go to the library whole: with other white space or two such characters in a row, with one
    of its special strings, or of a tokenizer of another kind.

    The pieces of a part of Latin letters, digits and signs are its runs of one kind, the first with the space before
    it; these go straight to the vocabulary's merges.  Other parts, and those with an apostrophe, are cut by the library.
    """

    LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = max(1, (max(1, self.tokenizer.get_vocab_size() - 1).bit_length() + 7) // 8)
        before = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.by_part = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True) and self.tokenizer.normalizer is None
        odd = (c for c in map(chr, range(1 << 16)) if c not in " \n" and (c.isspace() or c == "\u180e"))
        self.odd = re.compile("[" + "".join(map(re.escape, odd)) + "]")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.simple = re.compile(f"([{self.LETTERS}]+)([{self.SIGNS}]*)")
        self.plain = re.compile(f"\n?[{self.LETTERS}{self.SIGNS}0-9]*")
        self.pieces = re.compile(f"\n|[{self.LETTERS}]+|[0-9]+|[{self.SIGNS}]+")
        # A byte-level vocabulary writes bytes that are printable in Latin-1 as themselves, the others from 256 on.
        shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(shown)))}
        self.space = chr(self.letters[0x20])
        self.known, self.inner = Known(keep, self._part), functools.lru_cache(1 << 14)(self._piece)

    def _by_part(self, text: str) -> bool:
        doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text.endswith((" ", "\n"))
        return self.by_part and not doubled and not self.odd.search(text) and not any(s in text for s in self.special)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str, before: str = "") -> bytes:
        """Ids of one run of characters of one kind."""
        if not piece.isascii() or piece == "\n":
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(before + piece)]).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part: with the space before it, unless it is empty or begins with a line feed."""
        if found := self.simple.fullmatch(part):
            first, sign = found.groups()
            return (self.known.get(first) or self._piece(first, self.space)) + self.inner(sign) if sign else self._piece(first, self.space)
        if not part or part[0] == "\n":
            return self._bare(part)
        if not self.plain.fullmatch(part):
            return self._whole(" " + part)
        first, *others = self.pieces.findall(part)
        return b"".join([self._piece(first, self.space), *map(self.inner, others)])

    def _bare(self, part: str) -> bytes:
        return b"".join(map(self.inner, self.pieces.findall(part))) if self.plain.fullmatch(part) else self._whole(part)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not self._by_part(text):
            return self._whole(text)
        # All parts but the first begin with a line feed or, unwritten, with a space.
        parts = text.replace("\n", " \n").split(" ")
        return self._bare(parts[0]) + b"".join(map(self.known.__getitem__, itertools.islice(parts, 1, None)))


def worker_encoder(path: str, keep: int) -> Encoder:
    """The Python worker's encoder for ``path``, which serves all its tasks."""
    held = sys.modules.setdefault("ebbflow_worker_encoders", types.ModuleType("ebbflow_worker_encoders"))
    if (path, keep) not in held.__dict__.setdefault("by_path", {}):
        held.by_path = {(path, keep): Encoder(path, keep)}
    return held.by_path[path, keep]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, block_ids: int = 65_536, plane: str = "byte", end_id: int = 0, keep: int = KEEP) -> str:
    """Write the token ids of ``docs(doc_id, text)`` in ascending ``doc_id`` order; returns ``path``.

    ``keep`` is the number of pieces of text that a worker remembers; it changes time and memory, not the result.
    Every text is encoded whole, without special tokens, and ``end_id`` is appended.  A null or empty text
    is the end id alone; a null doc_id comes first; rows that repeat a doc_id follow one another in the
    order of the table; an empty table writes empty files.  Other columns are not read.
    """
    key = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    kind = pa.string() if isinstance(key.dataType, T.StringType) else pa.int64()
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n_ids", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("docs", T.ArrayType(T.StructType([
            T.StructField("doc_id", T.StringType() if kind == pa.string() else T.LongType()), T.StructField("number", T.LongType()),
            T.StructField("length", T.IntegerType()), T.StructField("before", T.BooleanType()), T.StructField("after", T.BooleanType())])))])
    arrow = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()),
                       ("docs", pa.list_(pa.struct([("doc_id", kind), ("number", pa.int64()), ("length", pa.int32()), ("before", pa.bool_()), ("after", pa.bool_())])))])

    def encode(batches):
        encoder, part = worker_encoder(tokenizer, keep), TaskContext.get().partitionId()
        end, ids, held, inside, block, number = struct.pack("<I", end_id), [], 0, [], 0, -1

        def row():
            data = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_ids": len(data), "payload": pack(data, encoder.width, plane), "docs": inside}], schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, number = encoder.encode(text.as_py() or "") + end, 0, number + 1
                while at < len(data):
                    take = min(len(data) - at, 4 * block_ids - held)
                    inside.append({"doc_id": doc, "number": number, "length": take // 4, "before": at > 0, "after": at + take < len(data)})
                    ids.append(data[at:at + take])
                    at, held = at + take, held + take
                    if held == 4 * block_ids:
                        yield row()
                        ids, held, inside, block = [], 0, [], block + 1
        if held:
            yield row()
        give_back()

    # The place in the table parts rows of one id, so that many of them still go to several tasks.
    slim = docs.select(F.col("doc_id").cast("string" if kind == pa.string() else "long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    dealt = slim.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    dealt.select("doc_id", "text").mapInArrow(encode, schema).write.parquet(f"{path}/chunks")
    blocks = docs.sparkSession.read.schema(schema).parquet(f"{path}/chunks").select("part", "block", "n_ids")
    # One row a range reaches the ordered window; ranges number as many as the tasks of the writing job.
    ranges = blocks.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    first = ranges.select("part", (F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    index = blocks.withColumn("within", within).join(first, "part").select("part", "block", (F.col("base") + F.col("within")).alias("start"), "n_ids")
    index.write.parquet(f"{path}/index")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written folder: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit numbers).

    Blocks are unpacked where they are read; only documents that cross a block's border are brought together,
    one by one.
    """
    chunks, index = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/index")
    key = chunks.schema["docs"].dataType.elementType["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", key), T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("cut", T.BooleanType())])
    arrow = pa.schema([("doc_id", pa.string() if isinstance(key, T.StringType) else pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("cut", pa.bool_())])

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                held = r["docs"]
                ends = np.cumsum([0] + [d["length"] for d in held])
                data = pa.py_buffer(unpack(r["payload"]).tobytes())
                ids = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((4 * ends).astype(np.int32)), data])
                yield pa.RecordBatch.from_arrays([
                    pa.array([d["doc_id"] for d in held], arrow.field("doc_id").type), pa.array([r["part"]] * len(held), pa.int32()),
                    pa.array([d["number"] for d in held], pa.int64()), pa.array(ends[:-1] + r["start"], pa.int64()), ids,
                    pa.array([d["before"] or d["after"] for d in held], pa.bool_())], schema=arrow)

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        one = rows.slice(0, 1)
        return one.set_column(4, "ids", pa.array([b"".join(rows.column("ids").to_pylist())], pa.binary()))

    pieces = chunks.join(index.select("part", "block", "start"), ["part", "block"]).select("part", "start", "payload", "docs").mapInArrow(decode, schema)
    cut = pieces.where("cut").groupBy("part", "number").applyInArrow(whole, schema)
    return pieces.where("NOT cut").unionByName(cut).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
