"""Substring dedup, centroid clustering and hard negatives: against plain versions, on awkward rows, and how much they look at."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from ebbflow.llm import centroid_clustering, hard_negatives, phrase_automata

# ---- substring dedup ---------------------------------------------------------------------------


def plain_repeats(docs, size=13):
    """``doc_id, n_words, n_removed, text`` by a table of all phrases; a null id is the least."""
    rank = lambda d: -math.inf if d is None else d
    words = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in words:
        for k in range(len(w) - size + 1):
            p = tuple(w[k:k + size])
            first[p] = min(first.get(p, math.inf), rank(d))
    out = []
    for d, w in words:
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k:k + size])] < rank(d) for j in range(size)}
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def removed(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "text").collect()), key=key)


def test_repeats_in_awkward_rows(spark, documents):
    found = removed(phrase_automata.remove_repeats(documents))
    assert found == sorted(plain_repeats([(r.doc_id, r.text) for r in documents.collect()]), key=key)


def test_repeats_in_random_texts(spark):
    """Few different words, so that phrases overlap in every way; shards so small that all marks are dealt anew."""
    rng = random.Random(5)
    pieces = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 40))) for _ in range(30)]
    docs = [(k, rng.choice([" ", "\n", "\t "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = sorted(plain_repeats(docs), key=key)
    assert removed(phrase_automata.remove_repeats(df)) == expected
    assert removed(phrase_automata.remove_repeats(df, shard=60)) == expected
    assert removed(phrase_automata.remove_repeats(df, size=3, gram=2)) == sorted(plain_repeats(docs, 3), key=key)
    assert sum(r[2] for r in expected) > 100


def test_spans_and_text_agree(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, "before all " + text + " and after"), (3, text.upper())], "doc_id int, text string")
    found = {r.doc_id: r for r in phrase_automata.remove_repeats(df).collect()}
    assert [tuple(s) for s in found[2].spans] == [(2, 42)] and found[2].text == "before all and after"
    assert found[1].spans == found[3].spans == []


def test_words_longer_than_a_slice():
    """A word that is hashed on its own has the same hash wherever it stands."""
    marks = phrase_automata.Marks(3, 2)
    long = b"x" * (phrase_automata.SLICE + 5)
    data = np.frombuffer(b"a b " + long + b" c" + long + b" d e", np.uint8)
    first, end, text, hashes = marks.words(data, np.array([0, 4 + len(long) + 2, len(data)]))
    assert [data[a:b].tobytes()[:2] for a, b in zip(first, end)] == [b"a", b"b", b"xx", b"c", b"xx", b"d", b"e"]
    assert text.tolist() == [0, 0, 0, 0, 1, 1, 1] and hashes[2] == hashes[4] and len(set(hashes.tolist())) == 6


def test_hot_phrase_goes_out_once_a_document(spark):
    """A phrase that all documents share makes one row a document and one different stretch."""
    shared = " ".join(f"s{k}" for k in range(13))
    df = spark.createDataFrame([(k, f"own{k} {shared} tail{k}") for k in range(500)], "doc_id long, text string")
    prepared = df.repartition(4).selectExpr("doc_id AS key", "xxhash64(text) AS print", "text")
    assert phrase_automata.marks(prepared, 13, 4, 16).count() <= 4 * 17
    found = phrase_automata.remove_repeats(df)
    assert found.where("n_removed = 13").count() == 499 and found.where("n_removed = 0").count() == 1


# ---- centroid clustering -----------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds, scale=256, seed=2):
    """``vec_id -> (cluster, distance)`` and centroids with every distance taken, in whole numbers."""
    data = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    order = sorted(data, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in data]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (_, at) in zip(data, near) if at == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i, k, d) for (i, _), (d, k) in zip(data, assign())), centres


def blobs(n, size, groups, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (groups, size))
    return [(k, (middle[rng.integers(groups)] + rng.normal(0, spread, size)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize(("groups", "spread"), [(6, 0.02), (1, 0.3)])
def test_clusters_against_every_distance(spark, groups, spread):
    rows = blobs(400, 8, groups, 3, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found, centroids = centroid_clustering.cluster(df, size=8, clusters=7, rounds=4)
    expected, centres = plain_clusters(rows, 7, 4)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == expected
    assert centroids.tolist() == centres
    if groups > 1:  # bounds part most vectors of separate groups: some are never scanned after the first round
        assert found.where("scans = 1").count() > 100


def test_loosening_is_sound_and_below_the_drift():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(200):
        old = rng.normal(0, 10, (4, 6))
        new = old + rng.normal(0, rng.choice([0.1, 3, 20]), (4, 6))
        radius = rng.uniform(0.1, 15, 4)
        drift, most = centroid_clustering.loosening(old, new, radius)
        for a in range(4):
            x = rng.normal(size=(300, 6))
            x = old[a] + x / np.linalg.norm(x, axis=1)[:, None] * radius[a] * rng.uniform(0, 1, (300, 1)) ** 0.2
            for j in range(4):
                if j != a:
                    lost = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                    assert lost.max() <= most[a] + 1e-9
            less += most[a] < np.delete(drift, a).max() - 1e-9
    assert less > 400


def test_cluster_edge_cases(spark):
    good = [0.5, -0.25, 0.0]
    rows = [(1, good), (1, good), (2, None), (3, [0.1, None, 0.2]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 2.0]), (7, []), (None, [0.1, 0.2, 0.3]),
            (8, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string")
    found, centroids = centroid_clustering.cluster(df, size=3, clusters=5, rounds=2)
    assert collections.Counter(r.vec_id for r in found.collect()) == {1: 2, None: 1} and len(centroids) == 3
    assert {r.distance for r in found.collect()} == {0} and found.where("vec_id = 1").select("cluster").distinct().count() == 1
    none, centroids = centroid_clustering.cluster(df.limit(0), size=3)
    assert none.collect() == [] and centroids.shape == (0, 3)


def test_large_components_are_exact():
    x = np.array([[(1 << 27) - 1, -(1 << 27) + 1]] * 2, np.int64)
    c = np.array([[-(1 << 27) + 1, (1 << 27) - 1], [0, 0]], np.int64)
    assert centroid_clustering.squares(x, c)[0].tolist() == [2 * (2 * ((1 << 27) - 1)) ** 2, 2 * ((1 << 27) - 1) ** 2]


# ---- hard negatives ----------------------------------------------------------------------------


def plain_negatives(rows, every, positives, negatives):
    data = [(i, lab, np.floor(256 * np.asarray(v, float)).astype(np.int64)) for i, v, lab in rows]
    out = []
    for i, lab, v in data:
        if i % every:
            continue
        scored = sorted((-int(v @ w), j, m) for j, m, w in data)
        near = [(-s, j) for s, j, m in scored if m == lab and j != i][:positives]
        for p, j in near:
            inside = [(-s, k) for s, k, m in scored if m != lab and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(i, j, n + 1, k, p, s) for n, (s, k) in enumerate(inside)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("spread", [0.03, 0.3])
def test_negatives_against_every_product(spark, spread):
    rng = np.random.default_rng(2)
    rows = [(i, v, int(rng.integers(3))) for i, v in blobs(600, 8, 5, 9, spread)]
    found = hard_negatives.mine(vectors(spark, rows).repartition(3), size=8, every=20, block=16, page=3, batch=7)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 20, 5, 10)


def test_equal_vectors_and_scores(spark):
    rows = [(k, [0.5, 0.5], k % 3) for k in range(300)] + [(300 + k, [0.4, 0.4], k % 3) for k in range(100)]
    found = hard_negatives.mine(vectors(spark, rows), size=2, every=50, block=16, page=2, batch=3)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 50, 5, 10)


def test_zone_maps_leave_blocks_unread(spark):
    """Groups far from each other: the bounds of most blocks do not meet the windows of an anchor."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, int(rng.integers(2)), np.floor(256 * np.asarray(v)).astype(int).tolist()) for i, v in blobs(2000, 8, 8, 6, 0.01)],
                                 "vec_id long, label long, v array<int>")
    found = hard_negatives.blocks(rows, 8, 32, 4, 2)
    zones = found.select("low", "high").collect()
    least, greatest = hard_negatives.bounds(np.array([r.v for r in rows.limit(20).collect()]), np.array([r.low for r in zones]), np.array([r.high for r in zones]))
    best = greatest.max(axis=1)[:, None]
    assert found.agg({"page": "max"}).first()[0] > 5 and (greatest < 0.5 * best).mean() > 0.4 and (least <= greatest).all()


def test_curve_visits_every_cell_once_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.lexsort(hard_negatives.along_curve(cells, bits).T[::-1])
        steps = np.abs(np.diff(cells[order], axis=0))
        assert len({c.tobytes() for c in hard_negatives.along_curve(cells, bits)}) == len(cells) and (steps.sum(axis=1) == 1).all()


def test_negative_edge_cases(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.2, 0.2], 0), (2, [0.2, 0.2], 0), (100, [-0.1, 0.0], 2), (101, [0.3, 0.0], 2), (3, None, 1), (4, [0.1, None], 1),
            (5, [0.1, float("nan")], 0), (6, [0.1, 0.1], None), (None, [0.1, 0.1], 0), (7, [0.1], 0), (8, [0.1, 0.2, 0.3], 0)]
    df = vectors(spark, rows).selectExpr("*", "'x' AS score", "1 AS block")
    found = sorted(map(tuple, hard_negatives.mine(df, size=2).collect()))
    score = sum((math.floor(256 * x) * math.floor(256 * y) for x, y in ((0.5, 0.5), (0.5, np.float32(0.4)))))
    low = 2 * 128 * math.floor(256 * np.float32(0.2))
    assert found == [(0, 1, 1, 2, score, low), (0, 1, 2, 2, score, low)] + found[2:] and all(r[0] == 0 and r[1] == 1 for r in found)
    assert hard_negatives.mine(df.limit(0), size=2).collect() == []
    assert hard_negatives.mine(df.where("vec_id = 1"), size=2).collect() == []  # no anchor
