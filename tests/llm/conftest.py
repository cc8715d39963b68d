import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(TABLES):
        pytest.skip("tables not available")
    return TABLES


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with every awkward case; extra columns have names of results."""
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    rows = [
        (1, filler * 5 + "one two three", "en", "a", 7), (2, filler * 5 + "one two three", "en", "a", 7),
        (2, filler * 5 + "one two three", "en", "a", 7), (3, filler * 5 + "one two four", "en", "b", 7),
        (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n\t ", "de", None, 3), (7, "...", "de", "c", 3),
        (None, "a null id", "en", "c", 1), (None, None, None, None, None), (8, "word", "en", "a", 4),
        (9, "long text number nine. " * 30_000, "en", "c", 1), (10, "Ünï cödé 文字 № ½   end", "fr", "d", 2),
        (11, "line one here\nline two here\nline three here\nown line", "en", "d", 1),
        (12, "other\nline one here\nline two here\nline three here", "en", "d", 1)]
    schema = "doc_id long, text string, lang string, source string, n_words long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def stored(spark, documents, no_documents, tmp_path_factory):
    """Folders with the awkward documents, and with none, as tables on disk."""
    out = {}
    for name, docs in (("some", documents), ("none", no_documents)):
        path = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 1), (None, 1, 0), (9, None, None), (8, 1, 0)] if name == "some" else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, "gamma delta epsilon zeta eta theta iota kappa lambda mu ALPHA beta"), (2, "Word"), (3, None), (4, "..."), (1, "Word")]
                              if name == "some" else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([(1, "https://A.example.org/es/x?q"), (2, None), (3, "no scheme"), (4, "http://x.com/fr/1"), (4, "http://x.com/fr/1"), (5, "http://org"),
                               (6, "ftp://b.net/" + "p" * 5000), (None, "http://example.org/en/12#t")] if name == "some" else [], "page_id long, url string").write.parquet(f"{path}/pages.parquet")
        spark.createDataFrame(vectors() if name == "some" else [], "vec_id long, embedding array<float>, label int, cluster string").write.parquet(f"{path}/embeddings.parquet")
        out[name] = path
    return out


def vectors():
    """Vectors with every awkward case: 60 good ones in four groups, repeated rows, and nine that take no part."""
    good = [(k, [((k % 4) * 7 + j * 3 + k) % 11 / 16 - 0.3 for j in range(64)], k % 3, "x") for k in range(0, 300, 5)]
    flat = [0.125] * 64
    bad = [(301, None, 1, "x"), (302, [None] + [0.1] * 63, 1, "x"), (303, [float("nan")] + [0.1] * 63, 0, "x"), (304, [float("inf")] + [0.1] * 63, 0, None), (305, [0.1] * 63, 1, "x"),
           (306, [0.1] * 65, 1, "x"), (307, [], 1, "x"), (None, None, None, None), (308, None, None, None)]
    return good + good[:3] + [(400, flat, 1, "x"), (400, flat, 1, "x"), (401, flat, None, "x"), (402, flat, 2, "x")] + bad
