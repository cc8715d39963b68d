"""Line dedup by winnowing: delete runs of lines that occurred before.

Lines that hold a word are hashed without their outer white space; the others stand aside.  In every window of
``window`` such lines the least hash is a fingerprint (of equals the last), so two runs of that many equal lines
always select the same line.  Fingerprints that occur once are dropped with their windows.  The windows around
the others are compared as wholes; of each content the first occurrence, in the order of doc_id, row and line,
stays, and all lines that a later one covers go.  Windows that follow each other join into runs, which extends each
match in both directions as far as it goes.

With ``words``, runs of fewer lines take part too if they hold more words than that, and so do whole texts of fewer
lines; these only match whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.shingles import mix
from ebbflow.session import settle

WINDOW, WORDS = 3, 50
BLANK = " \t\n\x0b\x0c\r"


def counted(text: str | None) -> tuple[list[str], list[int]]:
    """The lines of a text and the numbers of those that hold a word."""
    lines = (text or "").split("\n")
    return lines, [k for k, line in enumerate(lines) if line.strip(BLANK)]


def windows(text: str | None, window: int, words: int | None = None) -> tuple[np.ndarray, ...]:
    """For each window of counted lines its hash, its fingerprint's hash, the place of the fingerprint, its first line and its size."""
    lines, at = counted(text)
    content = [lines[k].strip(BLANK).encode("utf-8", "surrogatepass") for k in at]
    h = np.array([xxhash.xxh3_64_intdigest(c) for c in content], np.uint64)
    parts = [_windows(h, window, np.arange(len(at) - window + 1))]
    if words is not None:
        count = np.cumsum([0, *(len(c.split()) for c in content)])
        for size in range(1, min(window, len(at) + 1)):
            parts.append(_windows(h, size, np.flatnonzero(count[size:] - count[:-size] > words)))
        if 0 < len(at) < window:
            parts.append(_windows(h, len(at), np.arange(1), salt=1))
    return tuple(map(np.concatenate, zip(*parts)))


def _windows(h: np.ndarray, size: int, starts: np.ndarray, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Windows of ``size`` lines from ``starts`` on; equal ones of one ``salt`` have equal hashes."""
    if not starts.size:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grid = np.lib.stride_tricks.sliding_window_view(h, size)[starts]
    place = size - 1 - np.argmin(grid[:, ::-1], axis=1)
    with np.errstate(over="ignore"):
        whole = np.full(len(starts), salt, np.uint64)
        for k in range(size):
            whole = mix(whole + grid[:, k] + np.uint64(k))
    return whole, grid[np.arange(len(starts)), place], place + starts, starts, np.full(len(starts), size)


def remove(text: str | None, found: list[tuple[int, int]]) -> tuple[str | None, int, int, int]:
    """The text without the counted lines that the windows ``found`` (first line, size) cover; counted lines, removed ones, and runs of these."""
    lines, at = counted(text)
    gone = sorted({s + k for s, size in found for k in range(size)})
    drop = {at[g] for g in gone}
    runs = sum(k == 0 or g != gone[k - 1] + 1 for k, g in enumerate(gone))
    kept = text if not gone else "\n".join(line for k, line in enumerate(lines) if k not in drop)
    return kept, len(at), len(gone), runs


def deduplicate(docs: DataFrame, *, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """``place, doc_id, text, n_lines, n_removed, n_runs`` for every row of ``docs(place, doc_id, text)``; ``place`` is unique.

    A line goes if a run of ``window`` lines or more that covers it occurred earlier (in a row with a smaller doc_id, null
    first; of equal ids by place; or further up in the same text, overlapping or not).  Null texts stay null; empty
    texts and texts of fewer lines keep all; repeated rows lose all but their first; an empty table gives no rows.
    With ``words``, a line also goes if a run of any number of lines with more words than that covers it and occurred
    earlier, or if its text has fewer than ``window`` lines that hold a word and a whole earlier text has the same ones.
    """
    def scan(batches):
        for batch in batches:
            for place, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                whole, mark, at, start, size = windows(text, window, words)
                n = len(whole)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(whole.view(np.int64)), pa.array([doc] * n, batch.schema.field("doc_id").type),
                                                      pa.array(np.full(n, place, np.int64)), pa.array(at), pa.array(start), pa.array(size)], names=["mark", "whole", "doc_id", "place", "at", "start", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = settle(docs.select("place", "doc_id", "text").mapInArrow(scan, f"mark long, whole long, doc_id {kind}, place long, at long, start long, size long"))
    where = F.struct("place", "at")
    shared = found.groupBy("mark").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("mark")
    matched = found.join(shared, "mark").select("whole", F.struct("doc_id", "place", "start", "size").alias("where"))
    first = matched.groupBy("whole").agg(F.min("where").alias("first"), F.max("where").alias("last")).where("first <> last").select("whole", "first")
    later = matched.join(first, "whole").where("where <> first").select("where.place", "where.start", "where.size")
    later = later.groupBy("place").agg(F.collect_list(F.struct("start", "size")).alias("found"))

    def rewrite(batches):
        for batch in batches:
            rows = [remove(t, [(w["start"], w["size"]) for w in f or []]) for t, f in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist())]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64())))],
                                             names=["place", "doc_id", "text", "n_lines", "n_removed", "n_runs"])

    joined = docs.select("place", "doc_id", "text").join(later, "place", "left")
    return joined.mapInArrow(rewrite, f"place long, doc_id {kind}, text string, n_lines long, n_removed long, n_runs long")


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: runs of three lines or more."""
    return _documents(spark, folder)


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: runs of three lines or more, runs of fewer lines with over 50 words, and whole short texts."""
    return _documents(spark, folder, words=WORDS)


def _documents(spark: SparkSession, folder: str, **options) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    return deduplicate(docs, **options).drop("place")


SQL = r"""
WITH l AS (SELECT doc_id, n, trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t, x
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE t <> ''),
w AS (SELECT a.doc_id, a.k, [a.t, b.t, c.t] AS g FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
later AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM later, unnest([0, 1, 2]) AS u(j)),
kept AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.n) AS text FROM l LEFT JOIN c USING (doc_id, n) LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.k = c.k
    WHERE g.k IS NULL GROUP BY l.doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines FROM c GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p IS NULL OR k <> p + 1) AS n_runs
    FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM gone) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

#: The same with runs of one or two lines that hold over 50 words, and with whole texts of one or two lines.
PASSAGES_SQL = SQL.replace("later AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),", r"""
v AS (SELECT doc_id, k, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, count(*) OVER (PARTITION BY doc_id) AS n_all FROM c),
runs AS (SELECT doc_id, k, g, 3 AS size, false AS entire FROM w
    UNION ALL SELECT doc_id, k, [t], 1, false FROM v WHERE n_words > 50
    UNION ALL SELECT a.doc_id, a.k, [a.t, b.t], 2, false FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.n_words + b.n_words > 50
    UNION ALL SELECT doc_id, 1, list(t ORDER BY k), max(n_all), true FROM v WHERE n_all < 3 GROUP BY doc_id),
later AS (SELECT doc_id, k, size FROM runs QUALIFY row_number() OVER (PARTITION BY g, entire ORDER BY doc_id, k) > 1),
""".strip()).replace("gone AS (SELECT DISTINCT doc_id, k + j AS k FROM later, unnest([0, 1, 2]) AS u(j)),", "gone AS (SELECT DISTINCT doc_id, k + j AS k FROM later, unnest(range(0, size)) AS u(j)),")
