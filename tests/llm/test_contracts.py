"""Every query against its SQL or a plain version: on the small tables, on awkward rows, and on no rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import pytest

from compare import connect
from ebbflow.llm import queries
from ebbflow.llm.queries import QUERIES, SQL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    names = sorted(df.columns)
    return sorted(([r[n] for n in names] for r in df.collect()), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def expected(cursor):
    names = [c[0] for c in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(([r[i] for i in order] for r in cursor.fetchall()), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_on_tables(spark, folder, name):
    assert rows(QUERIES[name](spark, folder)) == expected(connect(folder).execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, stored, name):
    assert QUERIES[name](spark, stored["none"]).collect() == []


@pytest.fixture(scope="module")
def awkward(spark, stored):
    """The result of each query on the awkward tables."""
    return {name: QUERIES[name](spark, stored["some"]).collect() for name in QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_each(awkward, name):
    if not name.startswith("op13"):  # whose rows are pairs
        assert len(awkward[name]) == (8 if name.startswith("op5") else 67 if name.startswith("op12") else 15)


def test_substring_dedup_rows(awkward):
    found = by_id(awkward["op11_substring_dedup"], "n_words", "n_removed", "kept_sha256")
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[1] == [(63, 0, found[1][0][2])] and found[2] == [(63, 63, nothing)] * 2
    assert found[3][0][:2] == (63, 62) and found[3][0][2] == hashlib.sha256(b"four").hexdigest()
    assert found[4] == found[5] == found[6] == [(0, 0, nothing)] and found[9][0][1] == 0  # a text that repeats itself only


def test_cluster_rows(awkward):
    rows = awkward["op12_centroid_clustering"]
    assert sum(r.distance for r in rows) == rows[0].inertia and {r.vec_id for r in rows} >= {400, 401, 402}
    for r in rows:
        assert r.cluster_inertia == sum(s.distance for s in rows if s.cluster == r.cluster) and len(r.centroid_sha256) == 64


def test_negative_rows(awkward):
    rows = awkward["op13_hard_negatives"]
    assert {r.anchor_id for r in rows} <= {0, 100, 200, 400} and not {r.positive_id for r in rows} & {301, 302, 303, 304, 305, 306, 307, 308, 401}
    assert all(30 * r.positive_score <= 100 * r.negative_score <= 90 * r.positive_score for r in rows) and max(r["rank"] for r in rows) <= 10


def by_id(found, *columns):
    out = collections.defaultdict(list)
    for r in found:
        out[r.doc_id].append(tuple(r[c] for c in columns))
    return out


def test_decontamination_rows(awkward):
    found = by_id(awkward["op1_benchmark_decontamination"], "n_words", "n_hit", "n_items", "contaminated")
    assert found[1] == found[2][:1] == found[2][1:] and found[1][0][1] > 10 and found[1][0][2:] == (1, True)
    assert found[8] == [(1, 1, 2, True)]  # an item shorter than a window, and a repeated item_id
    assert found[4] == found[5] == found[6] == found[7] == [(0, 0, 0, False)]


def test_quality_rules_rows(stored, spark, awkward):
    for r, text in zip(sorted(awkward["op2_quality_rules"], key=key_of), texts(spark, stored)):
        w = WORDS.findall(text or "")
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def key_of(r):
    return (r.doc_id is None, r.doc_id or 0, *[r[c] for c in ("n_words", "n_bytes") if c in r.__fields__])


def texts(spark, stored):
    docs = spark.read.parquet(f"{stored['some']}/documents.parquet").select("doc_id", "text").collect()
    return [r.text for r in sorted(docs, key=lambda r: (r.doc_id is None, r.doc_id or 0, len(WORDS.findall(r.text or ""))))]


def plain_spans(texts_, length):
    """Removed bytes of every text, by counting all strings."""
    data = [(t or "").encode() for t in texts_]
    count = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_on_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = QUERIES["op3_suffix_dedup"](spark, folder).orderBy("doc_id").collect()
    assert [tuple(r[1:]) for r in found] == plain_spans([r.text for r in docs], 400)


def test_suffix_dedup_rows(awkward):
    found = by_id(awkward["op3_suffix_dedup"], "n_bytes", "n_removed", "n_spans")
    assert found[2][0] == found[2][1] == found[1][0] and found[9] == [(690_000, 690_000, 1)]  # equal rows, and a text that repeats itself
    assert found[4] == found[5] == [(0, 0, 0)]


def test_held_out_and_scores(awkward):
    for name in ("op4_quality_classifier", "op8_language_id"):
        for r in awkward[name]:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert all(r.predicted == (r.score >= 0.7) for r in awkward["op4_quality_classifier"])
    language = by_id(awkward["op8_language_id"], "lang_pred")
    assert language[4] == language[5] == language[6] == language[7] == [("und",)] and ("und",) not in language[1]


def test_url_rows(awkward):
    found = collections.defaultdict(list)
    for r in awkward["op5_url_filter"]:
        found[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert found[1] == [("a.example.org", "/es/x", "example.org/es/", "block")]
    assert found[2][0][:3] == found[3][0][:3] == ("", "", None)
    assert found[4] == [("x.com", "/fr/1", "com/fr/", "allow")] * 2
    assert found[5][0][:3] == ("org", "", None)  # the rule's path is not the start of the url's
    assert found[6][0][1] == "/" + "p" * 5000 and found[6][0][3] in ("allow", "block")
    assert found[None] == [("example.org", "/en/12", "example.org/en/1", "block")]


def test_line_dedup_rows(awkward):
    found = by_id(awkward["op6_line_dedup"], "text", "n_removed", "n_runs")
    assert found[12] == [("other", 3, 1)] and found[11][0][1:] == (0, 0) and found[4] == [(None, 0, 0)]


def test_mixing(spark, stored, awkward):
    again = QUERIES["op7_mixing"](spark, stored["some"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, awkward["op7_mixing"]))
    assert all(0 <= r.taken <= 3 * r.size for r in again)


def test_mixing_meets_targets(spark, folder):
    found = QUERIES["op7_mixing"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in found.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2


def test_tokens_on_tables(spark, folder):
    import struct

    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(queries.default_tokenizer()), 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for r, got in zip(docs, QUERIES["op9_token_output"](spark, folder).orderBy("doc_id").collect(), strict=True):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert tuple(got) == (r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_rows(awkward):
    found = sorted(awkward["op9_token_output"], key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, *range(1, 3), *range(2, 13)]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))


def test_jaccard_rows(awkward):
    found = by_id(awkward["op10_ngram_jaccard_join"], "n_shingles", "component_id")
    assert found[2] == found[1] * 2 and found[1][0][1] == 1
    assert found[4] == [(0, 4)] and found[5] == [(0, 5)] and found[6] == [(0, 6)] and found[8] == [(1, 8)]
    assert sorted(found[None], key=str) == [(0, None), (1, None)]


def test_sql_parses():
    for name, sql in SQL.items():
        assert name in QUERIES and duckdb.extract_statements(sql)
