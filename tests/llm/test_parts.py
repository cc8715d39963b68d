"""The operators' building blocks against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbflow.llm import decontaminate, induced, jaccard_join, language_id, line_dedup, quality_classifier, shingles, suffix_dedup, token_output
from ebbflow.llm.components import components
from ebbflow.llm.queries import default_tokenizer


def brute_suffixes(text, cap):
    s = bytes(text)
    order = sorted(range(len(s)), key=lambda i: s[i:])
    shared = [0]
    for a, b in itertools.pairwise(order):
        k = 0
        while a + k < len(s) and b + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        shared.append(min(k, cap))
    return order, shared


@pytest.mark.parametrize("in_memory", [0, 1 << 28])
def test_suffix_order(in_memory):
    rng = random.Random(3)
    for case in range(300):
        letters = rng.choice([1, 2, 3, 5, 255])
        text = [rng.randint(1, letters) for _ in range(rng.randint(0, 60))] + [0]
        text = np.array(text * 2 if case % 3 == 0 else text, np.uint8)
        order, shared = induced.suffix_order(text, 400, in_memory)
        assert (list(order), list(shared)) == brute_suffixes(text, 400)


def test_suffix_order_with_a_cap():
    rng, cap = random.Random(4), 8
    for _ in range(100):
        base = [rng.randint(1, 3) for _ in range(40)]
        text = np.array([c for _ in range(5) for c in (*base[rng.randint(0, 20):], 0)], np.uint8)
        order, shared = induced.suffix_order(text, cap)
        best, plain = np.zeros((2, len(text)), int)
        best[order] = np.maximum(shared, np.append(shared[1:], 0))
        o, s = brute_suffixes(text, cap)
        plain[o] = np.maximum(s, s[1:] + [0])
        assert (best == plain).all()


def test_marks_cover_each_start_once():
    data = bytes(np.random.default_rng(1).integers(0, 3, 5000, np.uint8))
    find = suffix_dedup.Marks(400, 50)
    _, first, last = find(data)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == list(range(len(data) - 399))
    assert [len(x) for x in find(data[:399])] == [0, 0, 0] and len(find(data[:400])[0]) == 1


def test_equal_strings_have_equal_marks():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 123, 400, np.uint8))
    find, seen = suffix_dedup.Marks(400, 50), []
    for n in (0, 17, 333):
        data = bytes(rng.integers(97, 123, n, np.uint8)) + shared + bytes(rng.integers(97, 123, 50, np.uint8))
        mark, first, last = find(data)
        seen.append(mark[(first <= n) & (n <= last)])
    assert len({int(s[0]) for s in seen}) == 1


def test_texts_that_repeat_a_few_letters(spark):
    """Their many equal marks travel as one row a text, and the result is that of counting all strings."""
    from test_contracts import plain_spans

    rng = random.Random(12)
    texts = ["ab" * 300, "xab" * 150 + "tail", "q" * 130 + "".join(rng.choice("abc") for _ in range(90)), "zz" + "ab" * 20, "q" * 99, None, "abc" * 25]
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    found = suffix_dedup.marks(docs, 60, 10)
    assert found.count() == found.select("mark", "place").distinct().count() < 150
    got = {r.place: r for r in suffix_dedup.deduplicate(docs, length=60, gram=10, shard=500).collect()}
    for k, (n, gone, runs, _) in enumerate(plain_spans(texts, 60)):
        spans = got[k].spans if k in got else []
        assert (sum(s.stop - s.begin for s in spans), len(spans)) == (gone, runs)
        if k in got:
            assert len(got[k].kept) == n - gone


@pytest.mark.parametrize("pad", [1, 3, 60])
def test_a_hot_mark_is_dealt_anew(spark, pad):
    """Texts around one common passage fill several shards; the result is that of counting all strings."""
    from test_contracts import plain_spans

    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefgh") for _ in range(45))
    texts = ["".join(rng.choice("ab") for _ in range(pad)) + passage + "".join(rng.choice("ab") for _ in range(pad)) for _ in range(120)]
    texts += [passage * 2, None, "short", *texts[:40], *[texts[7]] * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    got = {r.place: r for r in suffix_dedup.deduplicate(docs, length=40, gram=8, shard=2000).collect()}
    for k, (n, gone, runs, _) in enumerate(plain_spans(texts, 40)):
        spans = got[k].spans if k in got else []
        assert (sum(s.stop - s.begin for s in spans), len(spans)) == (gone, runs)
        if k in got:
            assert len(got[k].kept) == n - gone


def test_hot_shards_are_bounded(spark, monkeypatch):
    rng = random.Random(14)
    word = "".join(rng.choice("abcdefgh") for _ in range(8))
    texts = ["".join(rng.choice("cdefgh") for _ in range(60)) + word + "".join(rng.choice("cdefgh") for _ in range(60)) for _ in range(400)]
    mark = [(1, k, [0], t.encode()) for k, t in enumerate(texts)]
    hot = spark.createDataFrame(mark, "mark long, place long, firsts array<long>, fragment binary")
    seen = []
    monkeypatch.setattr(suffix_dedup, "text_spans", lambda texts, length, shard, plain=suffix_dedup.text_spans: seen.append(texts) or plain(texts, length, shard))
    assert suffix_dedup.hot_spans(hot, 40, 8, 4000).count() == 0
    sizes = [r.size for t in seen for r in t.groupBy("mark").agg(F.sum(F.octet_length("fragment")).alias("size")).collect()]
    assert max(sizes) <= 4000 and sum(map(len, texts)) > 10 * 4000


def test_common_lengths():
    """Zeros of the text count, zeros past its end do not, and what is known need not be compared."""
    rng = random.Random(15)
    for _ in range(200):
        base = [rng.choice([0, 0, 1, 255]) for _ in range(rng.randint(1, 30))]
        text = np.array(base * rng.randint(1, 3) + [0] * rng.randint(1, 10), np.uint8)
        a, b = (np.array([rng.randrange(len(text)) for _ in range(40)]) for _ in range(2))
        plain = [next((k for k in range(20) if max(x, y) + k >= len(text) or text[x + k] != text[y + k]), 20) for x, y in zip(a, b)]
        words = induced.words_at(text)
        assert induced.common(words, a, b, 20).tolist() == plain
        assert induced.common(words, a, b, 20, np.array([rng.randint(0, n) for n in plain])).tolist() == plain


def test_only_fragments_that_share_a_mark_are_sorted(monkeypatch):
    rng, sorted_ = random.Random(16), []
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda text, *rest, plain=suffix_dedup.suffix_order: sorted_.append(len(text)) or plain(text, *rest))
    passage = bytes(rng.choice(b"abcdef") for _ in range(45))
    texts = [b"x" + passage, b"yy" + passage, *(bytes(rng.choice(b"ghijkl") for _ in range(60)) for _ in range(50))]
    rows = [(k, [0], t) for k, t in enumerate(texts)] + [(9, [5], texts[7])]
    mark = [1, 1, *range(2, 52), 7]
    batch = pa.RecordBatch.from_arrays([pa.array(mark), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])],
                                       names=["mark", "place", "firsts", "fragment"])
    (found, of, dealt), = suffix_dedup.shards([batch.take(pa.array(np.argsort(mark, kind="stable")))], 1 << 20)
    hits = dict(zip(found, suffix_dedup.repeats(found, of, np.bincount([r[2] for r in dealt]), 40)))
    assert sorted_ == [len(texts[0]) + len(texts[1]) + 2]
    assert hits[texts[0]].tolist() == [False] + [True] * 6 and hits[texts[1]].tolist() == [False] * 2 + [True] * 6
    assert all(hits[t].tolist() == [t == texts[7]] * 21 for t in texts[2:])


def test_only_texts_of_hot_marks_are_cut_again(spark, monkeypatch):
    from test_contracts import plain_spans

    rng, cut = random.Random(17), []
    passage = "".join(rng.choice("abcdefgh") for _ in range(45))
    texts = ["".join(rng.choice("ab") for _ in range(60)) + passage + "".join(rng.choice("ab") for _ in range(60)) for _ in range(60)]
    texts += ["".join(rng.choice("mnopqrst") for _ in range(100)) for _ in range(50)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    monkeypatch.setattr(suffix_dedup, "fragments", lambda found, length, plain=suffix_dedup.fragments: cut.append(sorted(r.place for r in found.select("place").collect())) or plain(found, length))
    got = {r.place: r for r in suffix_dedup.deduplicate(docs, length=40, gram=8, shard=2000).collect()}
    for k, (n, gone, runs, _) in enumerate(plain_spans(texts, 40)):
        spans = got[k].spans if k in got else []
        assert (sum(s.stop - s.begin for s in spans), len(spans)) == (gone, runs)
    assert len(cut) == 2 and cut[1] and max(cut[1]) < 60 and len(cut[0]) >= 100


def test_marks_travel_in_few_batches():
    rng, seen = random.Random(18), []
    texts = ["".join(rng.choice("abcdefgh") for _ in range(100)) for _ in range(200)]

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["place", "text"])])

    seen = list(suffix_dedup.marks(Docs(), 40, 8))
    assert len(seen) == 1 and seen[0].column("place").to_pylist() == sorted(seen[0].column("place").to_pylist())
    find, rows = suffix_dedup.Marks(40, 8), seen[0].to_pylist()
    plain = {(int(m.view(np.int64)), k, int(a), int(b)) for k, t in enumerate(texts) for m, a, b in zip(*find(t.encode()))}
    assert {(r["mark"], r["place"], a, b) for r in rows for a, b in zip(r["firsts"], r["lasts"])} == plain


def test_matches_of_the_test_set():
    rng, names = random.Random(5), [b"a", b"b", b"c", b"d"]
    for _ in range(200):
        items = [(str(k), [rng.choice(names) for _ in range(rng.randint(0, 7))]) for k in range(3)]
        doc = [rng.choice(names + [b"x"]) for _ in range(40)]
        tests = decontaminate.TestSet(items, 4)
        text = np.array([tests.words.get(w, 0) for w in doc] + [0], np.int64)
        found = {(int(tests.item[q]), p + k) for p, q, n in zip(*decontaminate.matches(text, tests)) for k in range(n)}
        plain, kept = set(), [i for i in items if i[1]]
        for k, (_, item) in enumerate(kept):
            size = min(4, len(item))
            for i in range(len(item) - size + 1):
                plain |= {(k, p + j) for p in range(len(doc) - size + 1) if doc[p:p + size] == item[i:i + size] for j in range(size)}
        assert found == plain


def test_long_documents_are_cut_with_overlap(spark):
    docs = spark.createDataFrame([(1, "x " * 95 + "one two three four five six seven eight nine ten " + "y " * 200)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    found = decontaminate.digest(decontaminate.find_matches(docs, bench, shard_words=100)).first()
    assert (found.n_words, found.n_hit) == (305, 10)
    many = decontaminate.digest(decontaminate.find_matches(docs, bench, block_bytes=20)).first()
    assert many.n_hit == 10
    assert decontaminate.decontaminate(docs, bench).count() == 0


def test_repeated_benchmark_rows_fill_no_block(spark):
    bench = spark.createDataFrame([(1, "same words again")] * 300 + [(k, f"item number {k}") for k in range(2, 40)], "item_id long, text string")
    blocks = list(decontaminate.test_blocks(bench, 200))
    assert sorted(int(i) for b in blocks for i, _ in b) == list(range(1, 40))


def test_planes():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 50_000, n).astype("<u4")
        for plane, width in itertools.product(("byte", "bit"), (2, 3, 4)):
            assert (token_output.unpack(token_output.pack(ids, width, plane)) == ids).all()
    with pytest.raises(ValueError):
        token_output.pack(np.array([70_000]), 2)


def test_encoder_agrees_with_the_library():
    encoder, rng = token_output.Encoder(default_tokenizer(), keep=50), random.Random(7)
    letters = [*"abcZ éß'  \n\n\t123½²_-.,!?你好 ́", "'s", "'ll", "'re ", "<|endoftext|>", "😀", " "]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    # Every letter and sign that may pass by the library's own cutting, and those next to them.
    for sign in map(chr, range(1, 0x600)):
        for text in (f"a {sign} b", f"x{sign}y z", f" 1{sign}2\n{sign}!", f"\n{sign}", f"{sign}{sign} ({sign})."):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_bit_planes_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(k, "some words " * (k % 50)) for k in range(300)], "doc_id long, text string")
    for plane in ("byte", "bit"):
        path = token_output.write_tokens(docs, str(tmp_path / plane), default_tokenizer(), block_ids=64, plane=plane)
        read = {r.doc_id: (r.start, bytes(r.ids)) for r in token_output.read_tokens(spark, path).collect()}
        encoder, start = token_output.Encoder(default_tokenizer()), 0
        for k in range(300):
            ids = encoder.encode("some words " * (k % 50)) + bytes(4)
            assert read[k] == (start, ids)
            start += len(ids) // 4


def test_suffix_automaton():
    rng = random.Random(8)
    for _ in range(60):
        text = [rng.randint(0, 3) for _ in range(rng.randint(1, 40))]
        step = language_id.suffix_automaton(text, 4).reshape(-1, 4)
        parts = "".join(map(str, text)).split("0")
        for n in range(1, 5):
            for word in itertools.product((1, 2, 3), repeat=n):
                state = 1
                for c in word:
                    state = state and step[state, c]
                assert bool(state) == any("".join(map(str, word)) in p for p in parts)


def test_phrases():
    model = language_id.build({"x": ["abcabd"], "y": ["bbbb"]}, texts_each=2)
    texts = [language_id.letters(t) for t in ("abcabd", "abdabc", "bbbbb", "zz", "")]
    assert model.phrases(texts).tolist() == [[1, 6], [2, 6], [5, 2], [2, 2], [0, 0]]
    assert model.phrases(texts, piece=2).tolist()[0] == [3, 6]
    assert model.predict(["abcabd", None, "..."])[0] == ["x", "und", "und"]
    assert language_id.build({}).predict(["a"]) == (["und"], [0.0])


def test_language_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_isotonic():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([0, 1, 0.5, 0.5, 1.0]), np.ones(5))
    assert (np.diff(y) > 0).all() and x.tolist() == [0, 2, 4] and abs(y[1] - 2 / 3) < 1e-12


def test_quality_accuracy(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("tables not available")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_classifier.registered(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for n in (10, 600, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.append(a[n // 10:], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)))
        assert jaccard_join.apart(jaccard_join.wide_sketch(a), jaccard_join.wide_sketch(b)) <= len(np.setxor1d(a, b))


def test_shingles():
    three = shingles.Shingler(3)
    assert len(three("a B c\x0bd")) == 2 and (three("A b C d") == three("a B c  D")).all()
    assert len(three("a b")) == 1 and three("a b")[0] not in three("a b a b a") and len(three("\n")) == len(three(None)) == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def near_copies(rng, n):
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    for k in range(n):
        base = list(base)
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        yield k, " ".join(base)


@pytest.mark.parametrize("block", [20_000, 7])
def test_join_of_drifting_copies(spark, monkeypatch, block):
    """A chain of near copies: links exist between neighbours, and lists are dealt in pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = list(near_copies(random.Random(10), 60)) + [(100 + k, t) for k, t in near_copies(random.Random(11), 30)]
    docs = jaccard_join.placed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    for size, percent in ((3, 90), (5, 80)):
        found = {r.doc_id: r.component_id for r in jaccard_join.join(docs, size=size, percent=percent).collect()}
        sets = {k: set(zip(*(t.split()[i:] for i in range(size)))) for k, t in rows}
        parent = {k: k for k in sets}

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
        assert found == {k: root(k) for k in sets}


def test_passages_of_few_lines(spark):
    """A repeated run of over 50 words goes whatever its lines, a whole short text too; short lines need three."""
    long, half, other = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 51), ("b", 30), ("c", 30)))
    texts = [f"{long}\nx", f"y\n {long}\nz", f"{half}\n{other}\nu", f"v\n{half}\n\n{other}", "short", "short\n", "short\nw", f"{half}\nt", f"x\n{long}\n{long}", "p\nq", "p\nq", None]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "place long, doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.deduplicate(docs, words=50).collect()}
    assert got == {0: (texts[0], 0, 0), 1: ("y\nz", 1, 1), 2: (texts[2], 0, 0), 3: ("v\n", 2, 1), 4: ("short", 0, 0), 5: ("", 1, 1), 6: (texts[6], 0, 0), 7: (texts[7], 0, 0),
                   8: ("x", 2, 1), 9: ("p\nq", 0, 0), 10: ("", 2, 1), 11: (None, 0, 0)}
    assert {r.n_removed for r in line_dedup.deduplicate(docs).collect()} == {0}


def test_join_sends_fewer_pairs_than_links(spark, monkeypatch):
    """Copies of one text around the threshold: the components of brute force, without sending a pair for each link."""
    rng, copies = np.random.default_rng(7), 160
    texts = []
    for _ in range(copies):
        words = [f"w{k}" for k in range(300)]
        for at in rng.choice(300, rng.integers(2, 7), replace=False):
            words[at] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(words))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    linked = [(a, b) for a in range(copies) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = list(range(copies))
    for _ in range(copies):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    sent, sifted = [], jaccard_join.sifted
    monkeypatch.setattr(jaccard_join, "sifted", lambda pairs, *rest: sent.append(pairs.count()) or sifted(pairs, *rest))
    docs = jaccard_join.placed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    found = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
    assert found == dict(enumerate(root))
    assert sum(sent) < len(linked), (len(linked), sent)
