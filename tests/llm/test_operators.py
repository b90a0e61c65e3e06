"""Each operator against brute force on small fixtures, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliograph.llm import graph, language_model, mixing, mpeg, neighbours, ngram_join, packing, pii, quality, suffix_dedup, toxicity


def words(text):
    return text.encode().lower().split() if text else []


def small_corpus(n=160, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = list(rng.choice(rows)[1].split(" "))
            for _ in range(rng.choice([0, 1, 2, 5, 20])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 60, 150, 300]))]
        rows.append((i, " ".join(w)))
    return rows


def reachable(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# n-gram join

@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_finds_every_component(spark, n, percent):
    rows = small_corpus()
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = reachable(sets, links)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_join_of_large_sets(spark):
    """Sets beyond one map's cells, on both sides of the sizes where wide maps begin and double."""
    rng = random.Random(9)
    bases = [[f"b{k}x{i}" for i in range(n)] for k, n in enumerate((900, 1027, 1300, 2051, 2600, 5000))]
    rows = []
    for k, base in enumerate(bases):
        for changes in (0, len(base) // 300, len(base) // 150, len(base) // 80, len(base) // 50, len(base) // 25):
            w = list(base[: len(base) - rng.choice([0, len(base) // 30])])
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"c{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base[: len(base) // 2] + [f"d{k}x{i}" for i in range(len(base) // 2)])))
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in ((i, words(t)) for i, t in rows)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = reachable(sets, links)
    assert 10 < len(links) and len(set(want.values())) > 12
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_join_on_odd_rows(odd, none):
    got = ngram_join.classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[3].component_id == 1 and by[2].component_id == 1 and by[8].component_id == 7 and by[4].n_shingles == 0 and by[4].component_id == 4
    assert ngram_join.classes(none).count() == 0
    kept = ngram_join.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 6, 7, 9, 10, 11, 12]


def test_ids_with_several_texts_lose_none_unlike(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(100)) for k in "abcd")
    rows = [(1, a), (5, a), (5, b), (5, b), (5, None), (7, c), (7, d), (8, d + " more"), (9, b), (9, ""), (3, c), (None, a), (4, a), (4, "")]
    kept = ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, a), (5, b), (5, None), (7, d), (9, ""), (3, c), (None, a), (4, "")]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((i or 0, t or "") for i, t in want)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(8, 400), st.integers(0, 60))
def test_similar_sets_share_a_signature(seed, size, changes):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[min(changes, len(a) - 1) :], rng.integers(0, 2**63, changes // 2).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    for percent in (80, 85):
        if 100 * common >= percent * (len(a) + len(b) - common) and len(a) != len(b) | common:
            if not np.array_equal(a, b):
                assert np.intersect1d(ngram_join.signatures(a, percent, 100), ngram_join.signatures(b, percent, 100)).size


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (130, 129), (1, 1000), (1000, 1)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reachable({x for e in edges for x in e}, edges)
    assert all(got.get(k, k) == v for k, v in want.items())


# suffix arrays

def repeated_words(rows):
    """Word positions in fifty words that another row has too, by row number."""
    where = collections.defaultdict(set)
    for n, (_, t) in enumerate(rows):
        w = words(t)
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(n)
    want = collections.defaultdict(set)
    for n, (_, t) in enumerate(rows):
        w = words(t)
        for j in range(len(w) - 49):
            if len(where[tuple(w[j : j + 50])]) > 1:
                want[n].update(range(j, j + 50))
    return want


def found_words(found):
    got = collections.defaultdict(set)
    for r in found.collect():
        assert not got[r.doc_id] & set(range(r.first_word - 1, r.end_word + 1)) and r.n_words == r.end_word - r.first_word >= 50
        got[r.doc_id].update(range(r.first_word, r.end_word))
    return got


def passage_rows(rng):
    vocabulary = [f"v{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 300))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            a = rng.randrange(0, 30)
            w[at:at] = passage[a : a + rng.randrange(30, 70)]
        rows.append((i, " ".join(w)))
    return rows + [(90, rows[0][1]), (91, rows[1][1].upper()), (92, "the " * 900), (93, "the " * 200)]


def variant_rows(rng):
    """Near copies with a word changed here and there, so that every document shares other parts with each other one."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w, at = list(base), 0
        while (at := at + rng.randrange(25, 71)) < len(w):
            w[at] = f"c{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def run_rows(rng):
    """Runs of one word of any length between words that others have too, and periods of a few words."""
    ends = [[f"{k}{j}" for j in range(40)] for k in "xyz"]
    rows = []
    for i in range(60):
        w = [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(1, 4)):
            w += rng.choice(ends)[rng.randrange(0, 20) :] + rng.choice([["the"], ["the"], ["a", "b"], ["p", "q", "r"]]) * rng.choice([5, 17, 20, 33, 49, 50, 51, 60, 90, 200, 400])
        rows.append((i, " ".join(w + rng.choice(ends)[: rng.randrange(0, 40)])))
    return rows


@pytest.mark.parametrize("make", [passage_rows, variant_rows, run_rows])
@pytest.mark.parametrize("hot", [20_000, 30])
def test_repeats_are_exactly_those_of_fifty_words(spark, make, hot):
    rows = make(random.Random(3))
    want = {rows[n][0]: x for n, x in repeated_words(rows).items()}
    found = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot)
    assert found_words(found) == want


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(0, 400))
def test_selection_depends_on_content_alone(seed, kinds, n):
    g = np.random.default_rng(seed).integers(0, kinds * 40, n).astype(np.uint64) << np.uint64(40)
    plain = {max(range(i, i + suffix_dedup.REACH), key=lambda j: (-int(g[j]), j)) for i in range(n - suffix_dedup.REACH + 1)}
    assert suffix_dedup.selected(g).tolist() == sorted(plain)


@pytest.mark.parametrize(("parts", "batch"), [(1, 10_000), (1, 50), (40, 10_000), (40, 7)])
def test_repeats_in_runs_across_batches_and_partitions(spark, parts, batch):
    """One passage, hundreds of times in a few documents, so that a run of suffixes is longer than batches and partitions."""
    rng = random.Random(5)
    passages = [[f"p{k}x{rng.randrange(10**6)}" for _ in range(200)] for k in range(2)]
    rows, want = [], collections.defaultdict(set)
    for i, times in enumerate((900, 1, 700, 2, 1)):
        w = []
        for k in range(times):
            w += [f"f{rng.randrange(10**9)}" for _ in range(20)]
            want[i].update(range(len(w), len(w) + 200))
            w += passages[k % 2 if i < 4 else 1]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    settings = {"spark.sql.shuffle.partitions": parts, "spark.sql.execution.arrow.maxRecordsPerBatch": batch, "spark.sql.adaptive.coalescePartitions.enabled": False}
    former = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, str(v).lower())
    try:
        found = suffix_dedup.repeats(docs).collect()
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)
    got = collections.defaultdict(set)
    for r in found:
        got[r.doc_id].update(range(r.first_word, r.end_word))
    assert got == want


def test_repeats_on_odd_rows(spark, odd, none):
    assert {r.doc_id for r in suffix_dedup.repeats(odd).collect()} == {1, 2, 3}
    text = " ".join(f"k{i}" for i in range(60))
    same = spark.createDataFrame([(None, text), (5, text), (5, text), (None, text + " more")], "doc_id long, text string")
    for hot in (20_000, 1):
        got = [(r.doc_id, r.first_word, r.end_word, r.other_doc) for r in suffix_dedup.repeats(same, hot=hot).collect()]
        assert sorted(got, key=str) == sorted([(None, 0, 60, 5)] * 2 + [(5, 0, 60, None), (5, 0, 60, 5)], key=str)
    assert suffix_dedup.repeats(none).count() == 0


# language model

def test_model_keeps_counts_and_beats_the_base(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = "xy"[i % 2]
        rows.append((i, " ".join(f"{lang}{int(rng.paretovariate(1.0)) % 900}" for _ in range(rng.randrange(0, 120))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_model.score(docs).collect()}
    tokens = {i: [*words(t), b"\n"] for i, t, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    out = [i for i in tokens if held[i]]
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)


def _vocabulary(monkeypatch=None, n=9, small=2):
    """Head words in two strata, in small classes and in trees, and six tail words' worth of counts."""
    if monkeypatch:
        monkeypatch.setattr(language_model, "SMALL", small)
    rows = [(f"{'xy'[i % 2]}{i}a".encode(), 1 + i % 2, 400 // (1 + i) + 3) for i in range(n)] + [(language_model.END, 0, 100)]
    head = pa.table({"word": pa.array([r[0] for r in rows], pa.binary()), "lead": [r[1] for r in rows], "c": [r[2] for r in rows]})
    v = language_model.build_vocabulary(head, sum(r[2] for r in rows) + 12, n + 5)
    v.tail_log = -np.log10(np.full(v.classes - v.first_tail, 5.0))
    return v


def _shaken(v, seed=0):
    flat = language_model.initial(v)
    return flat + np.random.default_rng(seed).normal(0, 0.3, len(flat)).astype(flat.dtype)


@pytest.mark.parametrize(("n", "small"), [(9, 2), (9, 64), (400, 4), (3000, 64)])
def test_probabilities_sum_to_one(monkeypatch, n, small):
    v = _vocabulary(monkeypatch, n, small)
    flat = _shaken(v)
    assert (len(v.tree.row) > 0) == (n >= 400)
    before = np.array([0, 3, 1], np.int32)
    every = [*range(len(v.counts)), *(-1 - k for k in range(v.first_tail, v.classes))]
    worth = np.array([1.0] * len(v.counts) + [5.0] * (v.classes - v.first_tail))  # a tail class holds five words' worth
    base = language_model.score_documents([before], flat, v)[0]
    got = language_model.score_documents([np.append(before, np.int32(k)) for k in every], flat, v)
    assert (worth * 10 ** (got - base)).sum() == pytest.approx(1.0, abs=1e-4)


def test_within_class_factors_depend_on_the_state(monkeypatch):
    v = _vocabulary(monkeypatch, 400, 4)
    flat = _shaken(v)
    for k in np.unique(v.class_of[: len(v.counts)]).tolist():
        members = np.flatnonzero(v.class_of[: len(v.counts)] == k)
        if len(members) > 1:
            shares = []
            for before in ([0], [5, 9, 2]):
                got = language_model.score_documents([np.array([*before, w], np.int32) for w in members], flat, v)
                shares.append(10 ** (got - np.logaddexp.reduce(got * np.log(10)) / np.log(10)))
            assert np.abs(shares[0] - shares[1]).max() > 1e-4


def test_scores_do_not_depend_on_company():
    v = _vocabulary()
    flat = _shaken(v)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, len(v.counts), n).astype(np.int32) for n in (1, 300, 2, 90, 33, 32, 31, 1, 700)]
    alone = [language_model.score_documents([d], flat, v)[0] for d in docs]
    assert language_model.score_documents(docs, flat, v) == pytest.approx(alone, rel=1e-5)


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(np, "float32", np.float64)
    v = _vocabulary(monkeypatch, 60, 4)
    rng = np.random.default_rng(2)
    flat = language_model.initial(v).astype(float) + rng.normal(0, 0.3, len(language_model.initial(v)))
    docs = [np.append(rng.integers(-v.classes, 60, n), v.end).astype(np.int32) for n in (6, 5, 3, 2)]
    docs = [np.where(d < 0, -1 - rng.integers(v.first_tail, v.classes), d).astype(np.int32) for d in docs]
    lanes = language_model.Lanes.of(docs, v, 3)
    at, real = next(lanes.windows(32))
    args = (v, lanes.inputs[at], lanes.ids[at], real, lanes.fresh[at], np.zeros((3, language_model.STATE)), 1)

    def loss(p):
        return language_model.train_window(language_model.unpack(p, v), *args)[2] / real.sum()

    _, grads, _ = language_model.train_window(language_model.unpack(flat, v), *args)
    g = np.concatenate([x.ravel() for x in grads])
    assert g.shape == flat.shape
    moved = np.flatnonzero(g)
    for i in [*rng.choice(moved, 150, replace=False), *rng.choice(len(flat), 30, replace=False)]:
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(g[i], abs=2e-6)


def test_words_are_split_like_bytes():
    texts = [" a  B\tc ", "", None, "É x y\x0b", "  \n", "İ I\x1cq\x85r", "x" * 3000]
    flat, counts = language_model.tokenized(pa.array(texts))
    assert flat.to_pylist() == [w for t in texts for w in words(t)] and counts.tolist() == [len(words(t)) for t in texts]


def test_long_texts_take_little_memory():
    import tracemalloc

    v = _vocabulary()
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 9, 200_000).astype(np.int32)] + [rng.integers(0, 9, 20).astype(np.int32) for _ in range(511)]
    tracemalloc.start()
    got = language_model.score_documents(docs, _shaken(v), v)
    assert np.isfinite(got).all() and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_model_on_odd_rows(odd, none):
    got = language_model.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert language_model.score(none).count() == 0


# packing

def test_packing_is_gapless_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(i, " ".join(f"wörd{rng.randrange(999)}" for _ in range(rng.choice([1, 20, 300, 900])))) for i in range(80)] + [(80, None), (81, ""), (82, "a <|endoftext|> b")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), fan_in=2).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32
            assert r.length == 2048 or r.piece == 0
    total = 0
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
    assert len(by_bin) <= len(packing.best_fit([r.length for r in got], 2048)[2]) + 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_fills_bins(sizes):
    bins, offsets, fill = packing.best_fit(sizes, 64)
    assert all(f <= 64 for f in fill) and sum(fill) == sum(sizes)
    assert sum(a + b <= 64 for i, a in enumerate(fill) for b in fill[:i]) == 0
    spans = sorted((b, o, o + s) for b, o, s in zip(bins, offsets, sizes, strict=True))
    assert all(x[2] == y[1] for x, y in zip(spans, spans[1:]) if x[0] == y[0])


def test_packing_on_odd_rows(odd, none):
    assert packing.pack(odd).where("piece = 0").count() == odd.count()
    assert packing.pack(none).count() == 0


# neighbours

def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[100:140] = x[100]
    x[300] = x[40] + 1e-6
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.search(vectors, vectors.where("vec_id % 50 = 0"), window=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in range(900) if i % 50 == 0}
    for q, hits in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        assert [i for i, _ in hits] == want
        assert [s for _, s in hits] == pytest.approx(d[want].tolist(), abs=1e-12)


def test_windows_alone_reach_their_recall(spark):
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(2000, 32))  # no structure at all
    clustered = rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] + 0.1 * rng.normal(size=(2000, 32))
    tied = np.round(rng.normal(size=(2000, 3))) + 9.0
    for x in (flat, clustered, tied):
        vectors = spark.createDataFrame([(i, v.tolist(), 1, "x", 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, role int, slot string, score double").repartition(3)
        asked = vectors.where("vec_id % 25 = 0")
        windows = neighbours.search(vectors, asked, window=16, widen=False)
        exact = {}
        for i in range(0, 2000, 25):
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            exact[i] = [int(j) for j in np.lexsort((np.arange(2000), d)) if j != i][:10]
        want = spark.createDataFrame([(q, v) for q, vs in exact.items() for v in vs], "query_id long, vec_id long")
        assert neighbours.recall(windows, want) >= 0.9
        whole = collections.defaultdict(list)
        for r in neighbours.search(vectors, asked, window=16, target=0.5).orderBy("query_id", "rank").collect():
            whole[r.query_id].append(r.vec_id)
        assert whole == exact


def test_hilbert_is_a_path():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert sorted(neighbours.hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = neighbours.search(few, few.where("vec_id = 100")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert neighbours.search(few.limit(0), few.limit(0)).count() == 0


# personal data

PATTERN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PATTERN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(9)
    pieces = ["a@b.c", "@", ".", "x.y@z-1.example.com", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "é", " ", "\n", "12", "-", "_d@e.f", "5500005555555559", "日"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))) for i in range(300)]
    rows += [(900, None), (901, "1 2 " * 9000), (902, "7" * 60_000), (903, "é@ü.de+12345678901x 4111111111111111")]
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = plain_spans(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in want.split(",") if s]


def test_telling_terms_are_found_by_corpus_counts(spark):
    rows = [(i, f"note {i} please write zorblat secret@corp.example.com thanks the end {i * 7}") for i in range(6)]
    rows += [(100 + i, f"please write the end of story number {i} thanks") for i in range(800)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        text = dict(rows)[i]
        terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        assert terms == ["zorblat"]
    assert all(got[100 + i].spans == "" for i in range(800))
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[3] == "note 3 please write  [EMAIL] thanks the end 21" and clean[105] == dict(rows)[105]


def test_very_many_telling_terms_of_one_text(spark):
    """40,000 different ones, each twice: found in a time that grows with the text, at the places of a plain search."""
    words = [f"t{i}" if i % 2 else f"Other{i}" for i in range(80_000)] * 2
    text = " ".join(words)
    told = [(1, f"t{i}", i % 3 == 0) for i in range(1, 80_000, 2)] * 2 + [(2, "other0", True)]
    frame = spark.createDataFrame([(1, text), (2, "x other0 Other0,"), (3, "t1 t3"), (4, None)], "pii_key long, text string")
    lists = pii.listed_terms(spark.createDataFrame(told, "pii_key long, term string, removed boolean"))
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(8).alias("e")))
    began = time.perf_counter()
    got = {r.pii_key: r.s for r in frame.join(lists, "pii_key", "left").select("pii_key", pii.told_spans(F.col("text"), spans, F.col("pii_told")).alias("s")).collect()}
    assert time.perf_counter() - began < 40
    want, at = [], 0
    for w in words:
        if w[0] == "t" and at >= 8:
            want.append((4, at, at + len(w), int(w[1:]) % 3 == 0))
        at += len(w) + 1
    assert list(map(tuple, got[1])) == want and len(want) == 79_999
    assert got[2] == [] and got[3] == got[4] == []


def test_telling_terms_go_wherever_they_stand(spark):
    rows = [(i, f"note {i} please write zorblat secret@corp.example.com thanks the end {i * 7}") for i in range(6)]
    rows += [(10 + i, f"\n Zorblat was here on day {i} and zorblat left, zorblat!") for i in range(3)]
    rows += [(20, f"zorblat {'one two three four five six ' * 40} ask secret@corp.example.com"), (21, "zorblat"), (21, "zorblat"), (22, None), (23, ""), (24, "see zorblat@corp.example.com")]
    rows += [(100 + i, f"please write the end of story number {i} thanks") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        base = [s for s in r.spans.split(",") if s and not s.startswith("term")]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?<!\S)zorblat(?!\S)", text, re.I)]
        assert r.spans == ",".join(base + want), r
    clean = pii.sanitise(docs).collect()
    assert len(clean) == len(rows)
    assert not any(re.search(r"(?<!\S)zorblat(?!\S)", r.text or "", re.I) for r in clean)
    assert {r.doc_id: r.text for r in clean}[10] == "\n [TERM] was here on day 0 and [TERM] left, zorblat!"


def plain_report(rows, words=4, reach=160, support=3, share=0.5, certain=0.9, bits=6.0):
    """All spans of each text, base ones and telling words, by counting over lists."""
    word = r"[^\x20\x09-\x0D]+"
    docs, values, terms, together, texts = collections.Counter(t or "" for _, t in rows), collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    base = {}
    for t, n in docs.items():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in plain_spans(t).split(",") if x)]
        base[t] = spans
        values.update({x: n for x in {(k, t[a:b]) for k, a, b in spans}})
        terms.update({x: n for x in {m[0].lower() for m in re.finditer(word, t)}})
        near = set()
        islands = []
        for k, a, b in sorted(spans, key=lambda x: x[1:]):
            if islands and a < islands[-1][1]:
                islands[-1] = [islands[-1][0], max(b, islands[-1][1]), [*islands[-1][2], (k, t[a:b])]]
            else:
                islands.append([a, b, [(k, t[a:b])]])
        for a, b, members in islands:
            low = max(0, a - reach)
            left = [(low + m.start(), low + m.end()) for m in re.finditer(word, t[low:a]) if m.start() or not low][-words:]
            right = [(b + m.start(), b + m.end()) for m in re.finditer(word, t[b : b + reach]) if m.end() < reach][:words]
            free = [(x, y) for x, y in left + right if not any(x < q and p < y for _, p, q in spans)]
            near |= {(*m, t[x:y].lower()) for m in members for x, y in free}
        texts.update(near)
        together.update({x: n for x in near})
    telling = {x[2] for x, n in texts.items() if n >= support and together[x] >= share * terms[x[2]] and math.log2(together[x] / terms[x[2]] * len(rows) / values[x[:2]]) >= bits}
    out = {}
    for t, spans in base.items():
        added = [("term", m.start(), m.end()) for m in re.finditer(word, t) if m[0].lower() in telling and not any(m.start() < b and a < m.end() for _, a, b in spans)]
        out[t] = ",".join(f"{k}:{a}:{b}" for k, a, b in spans + added)
    return out, telling


def test_all_spans_match_plain_counting(spark):
    rng = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = [rng.choice(common) for _ in range(rng.randrange(0, 60))]
        if i % 14 < 3:
            for _ in range(rng.randrange(1, 3)):
                k = rng.randrange(30)
                value = [f"u{k}@corp.example.com", f"10.0.{k}.7", f"+1 555 000 11{k:02d}", f"x{k}@10.0.0.{k}", f"{k}@m.org"][k % 5]
                own = [rng.choice([f"Code{k}", f"code{k}", f"near{k}", "the"]) for _ in range(rng.randrange(0, 4))]
                at = rng.randrange(len(w) + 1)
                w[at:at] = [*own, value, *rng.choice([[], [value], [f"CODE{k}"], ["y" * 200, f"code{k}"]])]
        if i % 50 == 7:
            w.append(f"code{rng.randrange(30)}")
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(800 + i, rows[i * 14][1]) for i in range(20)] + [(900, None), (901, "")]
    want, telling = plain_report(rows)
    assert 5 < len(telling) < 60
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.spans == want[dict(rows)[r.doc_id] or ""], r


def test_texts_of_very_many_values(spark):
    import time

    rows = [(0, " ".join(f"write to u{i}@corp.example.com or 10.1.{i % 250}.{i % 99} now" for i in range(4000))), (1, "a@b.c " * 3000), (2, "1.2.3.4@5.6 " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pii.report(docs.limit(0)).collect()
    began = time.time()
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert time.time() - began < 60
    assert [(r.n_email, r.n_ip) for _, r in sorted(got.items())] == [(4000, 4000), (3000, 0), (2000, 2000)]
    assert all(got[i].base_sha256 == hashlib.sha256(plain_spans(t).encode()).hexdigest() for i, t in rows)
    assert clean[0] == " ".join(["write to [EMAIL] or [IP] now"] * 4000) and clean[1] == "[EMAIL] " * 3000


def test_sanitising_odd_rows(odd, none):
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert pii.sanitise(none).count() == 0 and pii.report(none).count() == 0


# mixing

def test_mixture_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "c", "d", None]) if i % 20 else "tiny") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted((x for x in size if x is not None)) + [None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        above = {s for s in open_ if target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    by_source = dict(zip([r[0] for r in rows], [r[2] for r in rows]))
    taken = collections.Counter()
    for r in got:
        s = by_source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 150 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mixed_rows(docs).where("text <> ''").count() == sum(r.taken // r.size for r in got if r.size)


def test_mixing_odd_rows(odd, none):
    assert mixing.mix(odd).count() == odd.count() and mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


# media

@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_streams_carry_any_bytes(payload):
    s = mpeg.read(mpeg.write(payload))
    assert s.payload == payload and s.bad_checksums == 0 and s.skipped == 0
    assert s.vbr_frames == s.frames and sum(s.samples.values()) == 1152 * s.frames


def test_reader_resynchronises_and_sees_damage():
    payload = bytes(range(1, 250)) * 40
    blob = mpeg.write(payload)
    whole = mpeg.read(blob)
    at = whole.offsets[2]
    assert mpeg.header(blob[at : at + 4]).bitrate == 320
    torn = mpeg.read(blob[:at] + b"\xff\xfb garbage \xff" + blob[at:])
    assert torn.skipped == 12 and torn.frames == whole.frames and torn.payload == payload
    broken = mpeg.read(blob[: at + 7] + b"\x55" + blob[at + 8 :])
    assert broken.bad_checksums == 1 and broken.frames == whole.frames
    assert mpeg.read(b"\xff" * 999).frames == 0 and mpeg.read(b"").frames == 0
    assert whole.offsets == sorted(whole.offsets) and len(whole.toc) == 100 and list(whole.toc) == sorted(whole.toc)


def frame(word, fill=0):
    head = bytes.fromhex(word)
    return head + bytes([fill]) * (mpeg.header(head).length - 4)


def tag(version, frames, flags=0, extra=b""):
    body = extra + b"".join(frames)
    return b"ID3" + bytes([version, 0, flags]) + mpeg._syncsafe(len(body)) + body


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=12), st.integers(0, 3000), st.binary(max_size=60))
def test_reader_takes_any_bytes(payload, changes, cut, before):
    blob = bytearray(mpeg.write(payload * 4))
    for at, byte in changes:
        blob[at % len(blob)] = byte
    for data in (payload, before + bytes(blob), bytes(blob[: len(blob) - cut % len(blob)]), b"ID3" + payload, tag(len(payload) % 6, [payload], 0xF0) + bytes(blob)):
        s = mpeg.read(data)
        assert s.skipped <= len(data) and len(s.offsets) == s.frames and s.seconds >= 0 and mpeg.features(s)


def test_tags_of_all_versions():
    sound = frame("fffb9064") * 3
    text = b"\0" + b"t" * 300
    cases = {
        2: (tag(2, [b"TT2" + len(text).to_bytes(3, "big") + text, b"TP1" + b"\0\0\2ab"]), "TT2", "TP1"),
        3: (tag(3, [b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text, b"TPE1\0\0\0\2\0\0ab"]), "TIT2", "TPE1"),
        4: (tag(4, [b"TIT2" + mpeg._syncsafe(len(text)) + b"\0\0" + text, b"TPE1\0\0\0\2\0\0ab"]), "TIT2", "TPE1"),
    }
    for blob, one, two in cases.values():
        s = mpeg.read(blob + sound)
        assert s.tags == {one: text, two: b"ab"} and s.frames == 3 and s.skipped == 0
    extended = mpeg.read(tag(3, [b"TPE1\0\0\0\2\0\0ab"], 0x40, b"\0\0\0\6" + bytes(6)) + sound)
    assert extended.tags == {"TPE1": b"ab"}
    assert mpeg.read(tag(4, [b"TPE1\0\0\0\2\0\0ab"], 0x40, b"\0\0\0\6\1\0") + sound).tags == {"TPE1": b"ab"}
    assert mpeg.read(tag(3, [b"TPE1\0\0\0\2\0\0\xff\0\xe0"], 0x80) + sound).tags == {"TPE1": b"\xff\xe0"}
    assert mpeg.read(tag(4, [b"TPE1\0\0\0\3\0\2\xff\0\xe0"]) + sound).tags == {"TPE1": b"\xff\xe0"}
    footed = mpeg.read(tag(4, [b"TPE1\0\0\0\2\0\0ab"], 0x10) + b"3DI" + bytes(7) + sound)
    assert footed.frames == 3 and footed.skipped == 0
    short = mpeg.read(tag(4, [b"PRIV\0\0\0\x0b\0\0payload\0abc", b"TPE1\0\0\0\2\0\0ab"]) + sound)
    assert short.tags["PRIV"] == b"payload\0abc" and short.tags["TPE1"] == b"ab" and len(short.payload) == 3 * (417 - 4 - 32)


def test_durations_are_exact_over_mixed_rates():
    s = mpeg.read(frame("fffb9064") * 3 + frame("fffb9464") * 3)
    assert s.samples == {44100: 3456, 48000: 3456} and float(s.seconds) == pytest.approx(0.150367, abs=1e-6)


def test_variable_bitrate_tables():
    first = bytearray(frame("fffb9064"))
    first[36:66] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 12, 2, 1, 2, 6) + b"\0\1\0\2"
    s = mpeg.read(bytes(first) + frame("fffb9064") * 2)
    assert (s.vbr_bytes, s.vbr_frames, s.toc, s.frames) == (5000, 12, b"\0\1\0\2", 2)
    cut = bytearray(frame("fff314c4"))  # a frame that ends inside its table
    cut[13:21] = b"Xing" + struct.pack(">I", 7)
    s = mpeg.read(bytes(cut) + frame("fff314c4") * 2)
    assert s.frames == 2 and s.toc == b""


def test_known_header_lengths():
    assert mpeg.header(bytes.fromhex("fffb9064")).length == 417 and mpeg.header(bytes.fromhex("fffb9264")).length == 418
    assert mpeg.header(bytes.fromhex("fff384c4")) is not None and mpeg.header(bytes.fromhex("fffbf064")) is None


def test_media_digests(odd, none):
    got = {r.doc_id: r for r in mpeg.digest(odd).collect()}
    texts = {r.doc_id: r.text for r in odd.collect()}
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    stored = mpeg.decode(mpeg.encode(odd)).collect()
    assert all(len(r.offsets) == r.frames == r.table_frames for r in stored)
    assert mpeg.digest(none).count() == 0


# classifiers

def labelled(spark, kind):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [f"n{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        if bad and kind == "toxic":
            for _ in range(rng.randrange(1, 8)):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "scumlike", "vileness"])
        if bad and kind == "quality":
            w = [x + "###" for x in w] if i % 8 else [w[0]] * len(w)
        docs.append((i, " ".join(w), "en", f"s{i % 5}"))
        if i % 3:
            labels.append((i, int(not bad) if kind == "quality" else 1, int(bad) if kind == "toxic" else 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_holds_out(spark, odd, none):
    docs, labels = labelled(spark, "quality")
    judged = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    unseen = [i for i in range(600) if i % 3 == 0]
    assert sum(judged[i].hb_keep == (i % 4 != 0) for i in unseen) >= 0.98 * len(unseen)
    out = quality.judge(odd, labels)
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    assert quality.judge(odd, labels.limit(0)).count() == odd.count() and quality.judge(none, labels).count() == 0


def test_posteriors_follow_from_the_evidence(spark):
    rng = random.Random(21)
    docs, labels = labelled(spark, "quality")
    sources = ["a"] * 40 + ["b"] * 25 + ["c"] * 8 + [None] * 5
    rows = [(r.doc_id, r.text, rng.choice(["en", "de", None]), rng.choice(sources)) for r in docs.collect()]
    rows += [(900, "alone on its site", "en", "single"), (901, None, None, "single path"), (901, None, None, "single path")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = quality.judge(made, labels).collect()
    assert len(got) == len(rows)
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        paths[r.source, r.lang].append(r.hb_evidence)
        hosts[r.source].append(r.hb_evidence)
    every = [x for p in hosts.values() for x in p]
    rate = sum(every) / len(every)

    def strength(groups, rates):
        means = [np.mean(g) for g in groups]
        between = np.mean([(m - q) ** 2 for m, q in zip(means, rates, strict=True)])
        noise = np.mean([np.var(g) / len(g) for g in groups])
        m = np.mean(rates)
        return float(np.clip(m * (1 - m) / (between - noise) - 1, 1, 1e6)) if between - noise > 1e-9 else 1e6

    alpha = strength(list(hosts.values()), [rate] * len(hosts))
    mid = {h: (sum(p) + alpha * rate) / (len(p) + alpha) for h, p in hosts.items()}
    beta = strength(list(paths.values()), [mid[h] for h, _ in paths])

    def logit(p):
        return math.log(p / (1 - p))

    for r in got:
        p = paths[r.source, r.lang]
        others = min(1 - 1e-6, max(1e-6, (sum(p) - r.hb_evidence + beta * mid[r.source]) / (len(p) - 1 + beta)))
        assert r.hb_site_rate == pytest.approx(others, rel=1e-6)
        assert logit(r.hb_posterior) == pytest.approx(logit(r.hb_evidence) + logit(others) - logit(rate), rel=1e-6, abs=1e-6)
        assert r.hb_keep == (r.hb_posterior >= 0.5)
        if r.doc_id == 900:
            assert others == pytest.approx(mid["single"])
    again = quality.judge(quality.judge(made, labels), labels)
    assert again.columns == [*made.columns, *quality.ADDED] and again.select("hb_evidence").count() == len(rows)


def test_urls_have_sites(spark):
    urls = spark.createDataFrame([("https://Www.Example.com:80/a/b?c=/d",), ("http://x.org",), ("mailto:x",), (None,)], "url string")
    host, path = quality.url_site(F.col("url"))
    assert [tuple(r) for r in urls.select(host, path).collect()] == [("www.example.com:80", "/a"), ("x.org", ""), ("", ""), (None, None)]


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 400 + [("big2", "p", 0.2)] * 400 + [("mid", "p", 0.5)] * 300 + [("rare", "p", 0.0)]
    site = {r.host: r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert abs(site["big"].mid - 0.9) < 0.02 and 0.0 < site["rare"].mid and site["rare"].mid > 0.05


def test_features_join_until_none_is_left(spark, monkeypatch):
    """However few may join at a time, the fit ends with the features that it has when all join at once."""
    rng = random.Random(5)
    bad = [c * 4 for c in "bcdfghjklmnpq"]
    rows = [(i, " ".join([*rng.choices(["some", "plain", "words", "here", "again"], k=6), *rng.choices(bad if i % 3 == 0 else [c * 5 for c in "rstvwxyz"], k=1)])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "JOINING", 2)
    slow = toxicity.fit(docs, labels)
    assert len(whole.places) > 5 and set(slow.places) == set(whole.places)
    for f, at in whole.places.items():
        assert abs(whole.weights[at] - slow.weights[slow.places[f]]) < 0.05 * max(1, abs(whole.weights[at]))


def test_toxicity_holds_out(spark, odd, none):
    docs, labels = labelled(spark, "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    unseen = [i for i in range(600) if i % 3 == 0]
    assert sum(got[i].toxic == (i % 4 == 0) for i in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.expected_severity <= 3 for r in got.values())
    many = toxicity.score(spark.createDataFrame([(1, "vilest"), (2, "vilest scumlike vileness vilest scumlike vileness vilest")], "doc_id long, text string"), labels.limit(0)).collect()
    assert len(many) == 2
    assert toxicity.score(odd, labels).count() == odd.count() and toxicity.score(none, labels).count() == 0


def ordinal_rows(kinds, n=500, features=12, seed=0):
    rng = np.random.default_rng(seed)
    true = np.where(np.arange(features) < 4, 2.0, 0.0) * np.array([1, -1] * (features // 2))
    rows = [np.sort(rng.choice(features, rng.integers(0, 6), replace=False)) for _ in range(n)]
    values = [rng.uniform(0.3, 2, len(r)) for r in rows]
    strength = np.array([true[r] @ v for r, v in zip(rows, values, strict=True)]) + rng.logistic(size=n)
    grade = np.searchsorted([0.5, 1.5, 3.0], strength)
    low, high = (grade, grade) if kinds == "graded" else ((grade > 0).astype(int), np.where(grade > 0, 3, 0))
    return toxicity.Sample(rows, values, low, high, rng.uniform(0.5, 2, n), features)


def plain_loss(sample, p):
    """Of each document's set of grades, straight from the definition."""
    w, t = p[: sample.features], np.concatenate(([-np.inf], [p[sample.features]], p[sample.features] + np.cumsum(np.exp(p[sample.features + 1 :])), [np.inf]))
    total = 0.0
    for i in range(len(sample.low)):
        at = sample.doc == i
        s = float(w[sample.col[at]] @ sample.val[at])
        below = [1 / (1 + math.exp(-max(-700.0, min(700.0, x - s)))) for x in t]
        total -= sample.weight[i] * math.log(sum(below[g + 1] - below[g] for g in range(sample.low[i], sample.high[i] + 1)))
    return total


@pytest.mark.parametrize("kinds", ["graded", "binary"])
def test_ordinal_fit_meets_a_plain_optimiser(kinds):
    sample = ordinal_rows(kinds)
    rng = np.random.default_rng(1)
    p = rng.normal(0, 0.5, sample.features + 3)
    loss, g = sample(p)
    assert loss == pytest.approx(plain_loss(sample, p), rel=1e-9)
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-5
        assert (plain_loss(sample, p + step) - plain_loss(sample, p - step)) / 2e-5 == pytest.approx(g[i], abs=1e-7)
    ridge = 1e-3
    pull = np.concatenate([np.full(sample.features, ridge), [0, ridge, ridge]])
    q = np.zeros(len(p))
    for _ in range(20_000):
        q -= 0.5 * (sample(q)[1] + pull * q)
    fitted = toxicity.fit_ordinal(sample, ridge)
    assert fitted == pytest.approx(q, abs=2e-3)
    assert fitted[0] > 1 and fitted[1] < -1 and (np.exp(fitted[-2:]) > 0).all()
    if kinds == "binary":
        assert fitted[-2:] == pytest.approx(0, abs=1e-6)  # two labels say nothing about the upper thresholds


def test_lasso_meets_its_conditions():
    sample = ordinal_rows("binary", seed=4)
    penalty = np.random.default_rng(5).uniform(0.005, 0.03, sample.features)
    p = toxicity.fit_lasso(sample, penalty, np.zeros(sample.features + 3))
    g, w = sample(p)[1], p[: sample.features]
    assert (w != 0).any() and (w == 0).any() and abs(g[sample.features]) < 1e-4
    assert (np.abs(g[: sample.features][w == 0]) <= penalty[w == 0] + 1e-4).all()
    assert g[: sample.features][w != 0] == pytest.approx(-penalty[w != 0] * np.sign(w[w != 0]), abs=1e-4)


def test_upper_grades_spread_evenly_and_severity_adds_up(spark):
    strength, weight = np.random.default_rng(2).normal(2, 3, 500), np.random.default_rng(3).uniform(1, 2, 500)
    t = toxicity.spread_thresholds(strength, 0.5, weight)
    assert (np.diff(t) > 0).all()
    over = toxicity.sigmoid(strength[:, None] - t) / toxicity.sigmoid(strength - 0.5)[:, None]
    assert weight @ over / weight.sum() == pytest.approx([1, 2 / 3, 1 / 3], abs=1e-6)
    docs, labels = labelled(spark, "toxic")
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, labels).where("doc_id % 7 = 0").collect():
        counts = collections.Counter()
        for w, n in collections.Counter(words(texts[r.doc_id])).items():
            for x in [b"w" + w, *(b"p" + w[:k] for k in (4, 5, 6) if len(w) > k)]:
                counts[xxhash.xxh3_64_intdigest(x) >> 1] += n
        s = sum(model.weights[model.places[f]] * math.log1p(n) for f, n in counts.items() if f in model.places)
        up = [1 / (1 + math.exp(x - s)) for x in model.thresholds]
        assert r.expected_severity == pytest.approx(sum(up)) and r.p_toxic == pytest.approx(up[0]) and r.grade == sum(x >= 0.5 for x in up)


def test_graded_labels(spark):
    rng = random.Random(4)
    docs = [(i, " ".join([*(f"n{rng.randrange(200)}" for _ in range(30)), *["vile"] * (3 * (i % 4))])) for i in range(800)]
    labels = spark.createDataFrame([(i, i % 4) for i in range(0, 800, 3)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert sum(r.grade == r.doc_id % 4 for r in got) >= 0.95 * len(got)


def test_nothing_here_needs_columns_beyond_its_own(odd):
    assert mpeg.digest(odd.select("text", F.col("doc_id"))).count() == odd.count()
