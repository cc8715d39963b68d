"""The stages of the pipeline against plain versions, each on its own input."""

import collections

import corpus_pipeline
from ebbflow.llm import decontaminate, quality_classifier
from ebbflow.llm.queries import QUERIES
from ebbflow.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    (_, good), (_, unlike), (_, clean), (_, mixed), (_, tokens) = corpus_pipeline.STAGES

    kept = settle(good(spark, docs, folder))
    scored = {r.doc_id: r.score for r in quality_classifier.score_documents(docs, labels).collect()}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == {k for k, s in scored.items() if s >= 0.7}

    one = settle(unlike(spark, kept, folder))
    before = {r.doc_id: shingles(r.text) for r in kept.collect()}
    after = {r.doc_id for r in one.collect()}
    root = {k: k for k in before}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if before[a] and 100 * len(before[a] & before[b]) >= 80 * len(before[a] | before[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert one.columns == COLUMNS and after == {top(k) for k in ids}

    rest = settle(clean(spark, one, folder))
    dirty = {r.doc_id for r in QUERIES["op1_benchmark_decontamination"](spark, folder).where("contaminated").collect()}
    assert rest.columns == COLUMNS and {r.doc_id for r in rest.collect()} == after - dirty

    mix = settle(mixed(spark, rest, folder))
    times = collections.Counter(r.doc_id for r in mix.collect())
    assert mix.columns == COLUMNS and max(times.values()) <= 3 and set(times) <= {r.doc_id for r in rest.collect()}

    out = tokens(spark, mix, folder).collect()
    assert collections.Counter(r.doc_id for r in out) == times
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(times.elements())


def test_awkward_rows(spark, stored):
    docs = spark.read.parquet(f"{stored['some']}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = settle(stage(spark, docs, stored["some"]))
        assert k == 4 or out.columns == docs.columns
        assert settle(stage(spark, docs.limit(0), stored["some"])).count() == 0
    assert corpus_pipeline.run(spark, stored["none"]).count() == 0


def test_extra_columns_pass(spark, folder):
    docs = settle(spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS spans", "2 AS score", "3 AS size", "4 AS place", "5 AS node"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {tuple(r) for r in out.select("spans", "score", "size", "place", "node").distinct().collect()} == {(1, 2, 3, 4, 5)}


def test_decontamination_keeps_clean_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "three"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {1, 2}
