import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions.vectors import l2_normalise, literal, unit
from heliograph.operators import entities, metrics, preference, sampling, search


def unit_list(v):
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def samples(spark, rows):
    return spark.createDataFrame([(n, k, float(t), unit_list(v)) for n, (k, t, v) in enumerate(rows)], "vec_id long, item_key string, t double, vec array<double>")


def query(spark, v):
    return spark.createDataFrame([(unit_list(v),)], "query array<double>")


def keys(df):
    return [r.item_key for r in df.collect()]


def plain_search(rows, q, top_k, per_item, floor, exclude):
    """Every rule of the search over a list, one row after another."""
    scored = [(sum(a * b for a, b in zip(v, q, strict=True)), k, t, n) for n, k, t, v in rows if exclude is None or (k is not None and k != exclude)]
    best = sorted((r for r in scored if floor is None or r[0] >= floor), key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2]))
    taken, out = {}, []
    for r in best:
        taken[r[1]] = taken.get(r[1], 0) + 1
        if per_item is None or taken[r[1]] <= per_item:
            out.append(r[3])
    return out if top_k is None else out[:top_k]


@pytest.mark.parametrize("seed", range(4))
def test_search_like_a_loop(spark, seed):
    """Halves, quarters and zeros make many equal scores; some items have no key."""
    rng = random.Random(seed)
    rows = [(n, rng.choice(["a", "b", "c", "d", None]), float(n), [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]) for n in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, item_key string, t double, vec array<double>").repartition(5)
    q = [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)]
    asked = spark.createDataFrame([(q,)], "query array<double>")
    for top_k, per_item, floor, exclude in [(10, None, None, None), (None, 2, None, "b"), (7, 3, 0.0, None), (None, None, 0.25, "a"), (5, 1, 9.0, None)]:
        got = [r.vec_id for r in search.search(frame, asked, top_k, per_item, exclude_key=exclude, min_score=floor).orderBy(*search.best_first()).collect()]
        assert got == plain_search(rows, q, top_k, per_item, floor, exclude)


def test_search_by_a_sample_leaves_its_item_out(spark):
    rng = random.Random(8)
    rows = [(n, f"k{n % 6}", float(n // 6), unit_list([rng.gauss(0, 1) for _ in range(4)])) for n in range(48)]
    frame = spark.createDataFrame(rows, "vec_id long, item_key string, t double, vec array<double>")
    for key, at, nearest in (("k2", 3.4, 3), ("k0", -5.0, 0), ("k5", 2.5, 2)):
        q = next(v for _, k, t, v in rows if k == key and t == nearest)
        got = [r.vec_id for r in search.search_by_sample(frame, key, at, 9, 2).collect()]
        assert got == plain_search(rows, q, 9, 2, None, key)


def test_best_terms_of_several_rows(spark):
    """A term's score is its largest over a key's rows, whether the vocabulary fits in one array or is joined."""
    rng = random.Random(12)
    rows = [(k % 4, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for k in range(30)]
    terms = [(f"w{i:02d}", [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(25)]
    frame, words = spark.createDataFrame(rows, "k int, vec array<double>"), spark.createDataFrame(terms, "term string, vec array<double>")
    want = set()
    for k in range(4):
        best = {w: max(sum(a * b for a, b in zip(v, u, strict=True)) for j, v in rows if j == k) for w, u in terms}
        order = sorted((w for w in best if best[w] >= 0.5), key=lambda w: (-best[w], w))
        want |= {(k, w, best[w], n) for n, w in enumerate(order[:6], 1)}
    before = search.MOST_TERMS
    try:
        for most in (before, 10):
            search.MOST_TERMS = most
            found = search.top_terms(frame, words, ["k"], 6, 0.5)
            assert {(r.k, r.term, r.score, r["rank"]) for r in found.collect()} == want
    finally:
        search.MOST_TERMS = before


def test_quantiles_of_many_values(spark):
    """Beyond the sketch's accuracy, with an outlier and long runs of one value."""
    rng = np.random.default_rng(6)
    xs = np.concatenate([rng.normal(size=30_000), np.full(9_000, 0.25), [1e12, -1e9]])
    frame = spark.createDataFrame([(float(x),) for x in xs], "score double").repartition(4)
    shares = [0.0, 0.001, 0.25, 0.5, 0.5731, 0.99, 0.9999, 1.0]
    got = {r.share: r.value for r in metrics.quantiles(frame, "score", shares).collect()}
    assert got == pytest.approx({q: float(np.quantile(xs, q)) for q in shares}, rel=1e-9)


def test_next_uncertain(spark):
    rows = spark.createDataFrame([(i, f"k{i}", 0.0, i / 40) for i in range(40)], "vec_id long, item_key string, t double, p double")
    done = spark.createDataFrame([("k20", 0.001)], "item_key string, t double")
    assert preference.next_uncertain(rows, done, 40, "s", p="p").first().vec_id in (19, 21)
    assert preference.next_uncertain(rows, done, 40, "s", likeness="p").first().vec_id == 19  # the median is 19.5 / 40
    first = preference.next_uncertain(rows, done, 5, "s").first().vec_id
    pool = {r.vec_id for r in sampling.uniform_sample(rows, "vec_id", 5, "s").collect()}
    assert first in pool and preference.next_uncertain(rows, done, 5, "s").first().vec_id == first
    inside = preference.next_uncertain(rows, done, 5, "s", p="p").first().vec_id
    assert inside == min(pool - {20}, key=lambda i: (abs(i / 40 - 0.5), f"k{i}"))
    assert preference.next_uncertain(rows.where("vec_id = 20"), done, 5, "s").collect() == []


def test_nearest_in_time(spark):
    s = samples(spark, [("k", 0, [1, 0]), ("k", 10, [0, 1])])
    points = spark.createDataFrame([(1, "k", 1.0), (2, "k", 9.0), (3, "k", 5.0), (4, "gone", 1.0)], "point_id int, item_key string, at double")
    assert {r.point_id: r.t for r in search.asof(points, s).collect()} == {1: 0, 2: 10, 3: 0}


def test_nearest_in_time_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(5)}", rng.randrange(40) / 2, [1.0, i + 1.0]) for i in range(60)]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    s = samples(spark, rows)
    asked = [(i, f"k{rng.randrange(6)}", rng.randrange(-5, 50) / 2) for i in range(80)]
    got = {r.point_id: r.t for r in search.asof(spark.createDataFrame(asked + asked[:5], "point_id int, item_key string, at double"), s).collect()}
    want = {i: min((abs(t - at), t) for k2, t, _ in rows if k2 == k)[1] for i, k, at in asked if any(k2 == k for k2, _, _ in rows)}
    assert got == want


def test_quantiles_and_wide_ranks(spark):
    rng = random.Random(4)
    for xs in ([rng.gauss(0, 1) for _ in range(501)], [1.0] * 7, [3.0], [float(i % 3) for i in range(50)], [1e9, 0.0, 1e-9, 2e-9]):
        df = spark.createDataFrame([(x, i, 0.0) for i, x in enumerate(xs)], "score double, item_key int, t double").repartition(3)
        got = {r.share: r.value for r in metrics.quantiles(df, "score", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
        assert got == pytest.approx({q: float(np.quantile(xs, q)) for q in (0.0, 0.1, 0.5, 0.99, 1.0)})
        ranks = {r.item_key: r["rank"] for r in preference.ranked_widely(df).collect()}
        assert ranks == {k: n for n, k in enumerate(sorted(range(len(xs)), key=lambda i: (-xs[i], i)))}


def test_bootstrap_draws_in_proportion(spark):
    rows = spark.createDataFrame([(i, "a" if i < 300 else "b", float(i % 4)) for i in range(320)], "k long, c string, w double")
    drawn = sampling.weighted_bootstrap(rows, "k", "w", 4000, "s", "c").collect()
    assert len(drawn) == 8000 and {(r.c, r.draw) for r in drawn} == {(c, d) for c in "ab" for d in range(1, 4001)}
    share = [sum(r.k % 4 == j and r.c == "a" for r in drawn) / 4000 for j in range(4)]
    assert share[0] == 0 and share == pytest.approx([0, 1 / 6, 2 / 6, 3 / 6], abs=0.04)


def test_feed_wraps_around(spark):
    rows = samples(spark, [(f"k{i}", 0, [1, i]) for i in range(5)]).withColumn("score", 1.0 - F.col("vec_id"))
    got = preference.next_batch(rows, rows.where("vec_id in (0, 3)").select("item_key"), 4).collect()
    assert [(r.item_key, r.again) for r in got] == [("k1", False), ("k2", False), ("k4", False), ("k0", True)]


def test_entity_pages(spark):
    s = samples(spark, [("1", 0, [1, 0]), ("1", 5, [0, 1]), ("2", 0, [0.9, 0.1]), ("3", 0, [0.2, 0.8])])
    bridge = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "3")], "entity string, item_key string")
    names = spark.createDataFrame([("p", "Ada Moss"), ("q", "Bo")], "entity string, name string")
    scores = search.scored(s, query(spark, [1, 0]))
    details = spark.createDataFrame([("1", 5, 80.0)], "item_key string, counter int, rating double")
    terms = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "term string, vec array<double>")
    assert [r.vec_id for r in entities.moment_matches(bridge, s, "p", query(spark, [0, 1]), 2, 1).collect()] == [1, 2]
    page = entities.detail(bridge, names, scores, details, s, terms, "p", 2)
    assert page["stats"].first().name == "Ada Moss" and page["distribution"].agg(F.sum("n")).first()[0] == 3 and page["similar"].first().entity == "q"
    assert [r.entity for r in entities.named_like(names, " mos").collect()] == ["p"]
    board = entities.leaderboard(bridge, scores, details)
    assert {r.measure: (r.one, r.other) for r in entities.compared(board, "p", "q").collect()}["items"] == (2.0, 1.0)


def test_negative_terms(spark):
    terms = spark.createDataFrame([("beach", [1.0, 0.0, 0.0]), ("crowd", [0.0, 1.0, 0.0])], "term string, vec array<double>")
    q = search.posneg_query(terms, "beach", "crowd").first()[0]
    assert q[0] == pytest.approx(math.sqrt(0.5)) and q[1] == pytest.approx(-math.sqrt(0.5))
    assert search.posneg_query(terms, "beach", None).first()[0] == [1, 0, 0]


def test_norms(spark):
    r = spark.range(1).select(unit(literal([0, 0])).alias("z"), unit(literal([3, 4])).alias("u"), l2_normalise(literal([0, 0])).alias("e")).first()
    assert r.z == [0, 0] and r.u == [0.6, 0.8] and r.e == [0, 0]


def test_duplicates_and_blocked_similarity(spark):
    s = samples(spark, [("a", 0, [1, 0, 0]), ("b", 0, [1, 0, 0]), ("c", 0, [0, 1, 0])])
    assert keys(search.duplicates(s, "a", 0)) == ["b"]
    refs = s.where("vec_id > 0")
    for how in ("max", "mean"):
        x = {r.vec_id: r.score for r in search.similarity(s, refs, how).collect()}
        assert x == pytest.approx({r.vec_id: r.score for r in search.similarity_blocked(s, refs, how).collect()})


def test_diversity(spark):
    pool = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0]), (2, 1, [0.99, 0.14, 0.0, 0.0]), (3, 2, [0.0, 0.0, 1.0, 0.0])], "vec_id long, rank int, vec array<double>")
    assert [r.vec_id for r in preference.diversify(pool, 2, 0.0).orderBy("place").collect()] == [1, 2]
    assert [r.vec_id for r in preference.diversify(pool, 2, 0.6).orderBy("place").collect()] == [1, 3]


def test_seeded_draws_repeat(spark):
    rows = spark.range(500).withColumnRenamed("id", "vec_id")
    a, b, c = ([r.vec_id for r in sampling.uniform_sample(rows.repartition(n), "vec_id", 40, seed).collect()] for n, seed in ((1, "x"), (7, "x"), (1, "y")))
    assert a == b != c and len(set(a)) == 40
    ranked = rows.withColumn("rank", F.col("vec_id"))
    front = [r.vec_id for r in sampling.rank_weighted_sample(ranked, "vec_id", 50, "s").collect()]
    assert sum(front) / 50 < 249 and len(set(front)) == 50
    assert sampling.rank_weighted_sample(ranked.limit(10), "vec_id", 50, "s").count() == 10


def test_spread_may_exceed(spark):
    s = samples(spark, [("k", i, [1, 0]) for i in range(11)])
    assert sampling.time_spread(s, 6).count() == 11 and sampling.time_spread(s, 3).count() == 4


def test_metrics_of_two_items(spark):
    scores = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)], "item_key string, score double")
    r = metrics.threshold_report(scores, 0.5).first()
    assert (r.moments, r["items"], r.percentile) == (2, 1, 50.0)
    cdf = metrics.survival(scores).orderBy("step").collect()
    assert len(cdf) == 101 and all(x.moments >= y.moments for x, y in zip(cdf, cdf[1:]))
    one = spark.createDataFrame([("a", 0.3)] * 4, "item_key string, score double")
    assert metrics.survival(one).count() == 1 and metrics.histogram(one).agg(F.sum("n")).first()[0] == 4


def test_entities(spark):
    s = samples(spark, [("1", 0, [1, 0, 0, 0]), ("1", 5, [0, 1, 0, 0]), ("2", 0, [0.9, 0.1, 0, 0]), ("2", 5, [0.5, 0.5, 0, 0]), ("3", 0, [0.8, 0.2, 0, 0]), ("3", 5, [0.3, 0.7, 0, 0])])
    bridge = spark.createDataFrame([("p1", "1"), ("p1", "2"), ("p2", "3"), ("p1", "99")], "entity string, item_key string")
    scores = search.scored(s, query(spark, [1, 0, 0, 0]))
    details = spark.createDataFrame([("1", 5, 80.0), ("2", 0, None)], "item_key string, counter int, rating double")
    board = {r.entity: r for r in entities.leaderboard(bridge, scores, details).collect()}
    assert (board["p1"]["items"], board["p1"].moments, board["p1"].counter, board["p1"].rating) == (2, 4, 5, 80.0)
    assert [r.item_key for r in entities.best_moments(bridge.where("entity = 'p1'"), scores).orderBy("rank").collect()] == ["1", "2"]
    vectors = entities.centroids(bridge, s, 4)
    assert [r.entity for r in entities.similar(vectors, "p1").collect()] == ["p2"]
    low = scores.withColumn("score", F.lit(-1.0))
    assert entities.leaderboard(bridge, low, details).first().best == 0.0


def test_training_set_drops_uncached(spark):
    s = samples(spark, [("k1", 2 * i, [1, i / 10]) for i in range(10)])
    v = spark.createDataFrame([(0, "k1", 0.0, 1), (1, "k1", 18.0, 0), (2, "k2", 5.0, 1)], "seq long, item_key string, t double, label int")
    assert {(r.label, r.t) for r in preference.training_set(v, s).collect()} == {(1, 0.0), (0, 18.0)}


def test_candidates_keep_random_ones(spark):
    s = samples(spark, [("k1", 2 * i, [1, 0]) for i in range(20)]).withColumn("score", F.col("vec_id").cast("double"))
    none = spark.createDataFrame([], "item_key string, t double")
    got = sampling.top_and_random(s, none, 3, 3, 4, "s").collect()
    assert len(got) == 4 and min(r.score for r in got) < 17
    labelled = s.where("vec_id = 19").select("item_key", "t")
    assert {r.vec_id for r in sampling.top_and_random(s, labelled, 3, 0, 9, "s").collect()} == {17, 18}


def test_recency(spark):
    now = 1e9
    v = spark.createDataFrame([(now,), (now - 90 * 86400,), (now - 180 * 86400,), (0.0,)], "ts double")
    w = [r.weight for r in preference.weighted_by_age(v, 90, now).collect()]
    assert w[0] == 1 and w[1] == pytest.approx(0.5) and w[2] == pytest.approx(0.25) and w[3] == pytest.approx(0.25)
    assert {r.weight for r in preference.weighted_by_age(v, 0, now).collect()} == {None}


def test_quantiles_of_values_that_change_when_computed_again(spark):
    """Sums differ in their last digits from one run to the next; quantiles must count and order the same values."""
    shaken = F.udf(lambda i: i + random.random() * 1e-7, "double").asNondeterministic()
    frame = spark.range(20_001, numPartitions=7).withColumn("score", shaken("id"))
    shares = [i / 10 for i in range(11)]
    got = {r.share: r.value for r in metrics.quantiles(frame, "score", shares).collect()}
    assert got.keys() == set(shares) and all(abs(v - s * 20_000) < 1e-6 for s, v in got.items())


def test_least_certain_of_an_even_number(spark):
    """The two in the middle are equally far from the median, whatever the last digits say: the earlier item goes first."""
    done = spark.createDataFrame([], "item_key long, t double")
    for low, high in ((0.1, 0.3 - 2**-54), (0.1, 0.3), (0.1 + 2**-54, 0.7), (0.2, 0.9 + 2**-53)):
        for first, second in ((low, high), (high, low)):
            rows = [(1, 1.0, first), (2, 1.0, second), (0, 1.0, -1.0), (0, 2.0, 5.0)]
            scores = spark.createDataFrame(rows, "item_key long, t double, score double")
            assert keys(preference.least_certain(scores, done, by_median=True)) == [1]
