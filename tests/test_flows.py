"""Streams with state, versioned indexes, large reference sets and the perceptron against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from heliograph.operators import perceptron
from heliograph.operators.search import best_places, similarity
from heliograph.operators.tiled import similarity_tiled, similarity_to
from heliograph.sources.snapshots import Manifest, Snapshots
from heliograph.streaming import incremental, stateful

# --- reference sets of any size ----------------------------------------------------------------------------------


def vectors(spark, n, seed, dim=5):
    rows = np.random.default_rng(seed).normal(size=(n, dim)).tolist()
    return spark.createDataFrame([(i, "x", v) for i, v in enumerate(rows)], "k long, sid string, vec array<double>")


@pytest.mark.parametrize("reduce", ["max", "mean"])
@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_tiles_equal_one_array(spark, reduce, block):
    samples, references = vectors(spark, 120, 1).repartition(9), vectors(spark, 90, 2).select("vec")
    references = references.unionByName(references.limit(1).crossJoin(spark.range(60)).select("vec"))  # many alike
    want = {r.k: r.score for r in similarity(samples.select("k", "vec"), references, reduce).collect()}
    found = similarity_tiled(samples, references, reduce, block)
    got = {(r.k, r.sid): r.score for r in found.collect()}
    assert {k for k, _ in got} == set(want) and all(abs(v - want[k]) < 1e-12 for (k, _), v in got.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tiles_beyond_the_array_limit(spark):
    """More references than one array may hold."""
    references = spark.range(12_000).select(F.array(F.sin("id"), F.cos("id")).alias("vec"))
    samples = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -2.0]), (3, None)], "k long, vec array<double>")
    with pytest.raises(ValueError):
        similarity(samples, references)
    angles = np.arange(12_000)
    got = {r.k: r.score for r in similarity_tiled(samples, references).collect()}
    assert got.keys() == {1, 2} and abs(got[1] - np.sin(angles).max()) < 1e-12 and abs(got[2] - (-2 * np.cos(angles)).max()) < 1e-12
    assert {r.k: r.score for r in similarity_to(samples, references).collect()} == got
    assert similarity_to(samples, references.limit(3)).count() == similarity(samples, references.limit(3)).count()
    got = {r.k: r.score for r in similarity_tiled(samples, references, "mean", 5000).collect()}
    assert abs(got[1] - np.sin(angles).mean()) < 1e-12 and abs(got[2] + 2 * np.cos(angles).mean()) < 1e-12


def test_mean_likeness_needs_no_tiles(spark):
    """A mean of dot products is the dot product with the mean: no samples or references go to Python."""
    samples, references = vectors(spark, 30, 1), vectors(spark, 20, 2).select("vec")
    plan = similarity_tiled(samples, references, "mean")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Cartesian" not in plan


def test_tiles_without_rows(spark):
    some, none = vectors(spark, 3, 1), vectors(spark, 1, 1).where("false")
    for samples, references in ((some, none), (none, some), (none, none)):
        assert similarity_tiled(samples, references.select("vec")).collect() == []
    with pytest.raises(ValueError):
        similarity_tiled(some, some, "least")


def test_places(spark):
    rows = [(k, s) for k in range(50) for s in (k % 7 / 7, -1.0)] + [(60, 5.0)]
    got = {r.k: r.place for r in best_places(spark.createDataFrame(rows, "k long, score double"), "k").collect()}
    order = sorted({k for k, _ in rows}, key=lambda k: (-round(max(s for j, s in rows if j == k), 6), k))
    assert got == {k: i for i, k in enumerate(order, 1)}


# --- the feed ----------------------------------------------------------------------------------------------------

REQUESTS = "session long, request long, asked double, count int"


def run_feed(spark, tmp_path, parts, size, shown=None, ttl=None):
    """Lands the parts one after another and starts the stream anew for each, from the same checkpoint."""
    for part in parts:
        frame = spark.createDataFrame(part, REQUESTS)
        frame.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        before = None if shown is None else spark.createDataFrame(shown, "session long, place long")
        answers = stateful.session_feed(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), size, before, ttl)
        writer = answers.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        writer = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        stateful.started(writer, answers).awaitTermination()
    return sorted(map(tuple, spark.read.schema(stateful.FEED).parquet(str(tmp_path / "out")).collect()))


def test_feed_like_a_loop_with_restarts(spark, tmp_path):
    rng = random.Random(4)
    asked = [(rng.choice([1, 1, 1, 2, 3]), i, float(i // 2), rng.choice([0, 1, 3, 5])) for i in range(80)]
    shown = [(1, 2), (1, 3), (2, 1), (9, 4), (2, 11)]
    got = run_feed(spark, tmp_path, [asked[:30], asked[30:34], asked[34:]], 11, shown)
    assert got == sorted(stateful.feed_like_a_loop(asked, 11, shown))
    assert max(r[3] for r in got if r[0] == 1) > 3  # the library was gone through several times


def test_feed_forgets(spark, tmp_path):
    asked = [(1 + i % 2, i, 10.0 * i, 1 + i % 3) for i in range(40)]
    shown = [(1, 3), (2, 1)]
    got = run_feed(spark, tmp_path, [asked[:25], asked[25:]], 9, shown, ttl=60.0)
    assert got == sorted(stateful.feed_like_a_loop(asked, 9, shown, 60.0)) != sorted(stateful.feed_like_a_loop(asked, 9, shown))


def test_feed_asks_its_state_by_session(spark):
    """A long row of requests of one session costs a few calls of the state, not several a place."""

    class State:
        calls = 0

        def __getattr__(self, name):
            def call(*_):
                self.calls += 1
                return {"exists": False, "containsKey": False}.get(name)

            return call

    feed = stateful._Feed(50, None)
    feed.shown, feed.at = State(), State()
    rows = [Row(session=1, request=i, asked=float(i), count=3) for i in range(100)]
    answers = list(feed.handleInputRows((1,), iter(rows), None))
    assert len(answers) == 100 and feed.shown.calls + feed.at.calls <= 4


def test_feed_of_an_empty_library(spark, tmp_path):
    assert run_feed(spark, tmp_path, [[(7, 1, 1.0, 4), (None, 2, 2.0, 4)]], 0) == []


def run_queue(spark, tmp_path, parts, pool):
    for part in parts:
        frame = spark.createDataFrame(part, REQUESTS)
        frame.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        clips = spark.createDataFrame(pool, "clip long, item_key long, score double")
        answers = stateful.play_queue(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), clips, "s")
        writer = answers.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        stateful.started(writer.trigger(availableNow=True), answers).awaitTermination()
    return spark.read.schema(stateful.PLAYED).parquet(str(tmp_path / "out")).collect()


def test_each_clip_plays_once_before_any_comes_again(spark, tmp_path):
    pool = [(i, i // 3, [0.9, 0.1, None][i % 3]) for i in range(30)]
    asked = [(i % 2, i, float(i), 1 + i % 4) for i in range(60)]
    got = run_queue(spark, tmp_path, [asked[:23], asked[23:]], pool)
    for session in (0, 1):
        mine = sorted((r for r in got if r.session == session), key=lambda r: (r.asked, r.slot))
        assert len(mine) == sum(a[3] for a in asked if a[0] == session)
        # the same by a list that is worked off in one go
        clips, queue, recent, cycle, want = [(c, k, 1.0 if s is None else s) for c, k, s in pool], [], [], -1, []
        for _ in mine:
            if not queue:
                cycle += 1
                queue = stateful.shuffled(clips, f"s-{session}-{cycle}")
                assert sorted(queue) == list(range(30))
            want.append((cycle, clips[stateful.next_clip(queue, recent, clips)][0]))
        assert [(r.cycle, r.clip) for r in mine] == want
        for c in {r.cycle for r in mine}:
            once = [r.clip for r in mine if r.cycle == c]
            assert len(once) == len(set(once)) and (c == mine[-1].cycle or len(once) == 30)
        items = [r.item_key for r in mine]
        again = sum(items[i] in items[max(0, i - 8) : i] for i in range(len(items)))
        assert again < len(items) / 3  # by a plain draw about half would


def test_queue_order_follows_scores():
    pool = [(i, i, 1.0 if i < 50 else 0.1) for i in range(100)]
    early = [sum(p < 50 for p in stateful.shuffled(pool, str(n))[:50]) for n in range(40)]
    assert np.mean(early) > 40
    recent = [5]
    assert stateful.next_clip([5, 6], recent, pool) == 6 and recent == [5, 6]
    assert stateful.next_clip([5, 6], [5, 6], pool) == 5  # nothing else is left


def test_queue_limits(spark, tmp_path, monkeypatch):
    assert run_queue(spark, tmp_path, [[(1, 1, 1.0, 2)]], []) == []
    monkeypatch.setattr(stateful, "MOST_CLIPS", 2)
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        stateful.play_queue(stream, spark.createDataFrame([(i, i, 1.0) for i in range(3)], "clip long, item_key long, score double"))


# --- training ----------------------------------------------------------------------------------------------------


def plain_points(rows, every):
    out, state = [], {}
    for profile, seq, label in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(profile, [0, 0, 0, 0])
        s[0], s[1], s[2] = s[0] + 1, s[1] + (label == 1), s[2] + (label == 0)
        if s[0] >= every and s[1] and s[2]:
            s[0], s[3] = 0, s[3] + 1
            out.append((profile, s[3], seq, s[1] + s[2], s[1], s[2]))
    return sorted(out)


def test_due_points_and_versions(spark, tmp_path):
    rng = random.Random(9)
    rows = [("a", i, int(rng.random() < 0.3)) for i in range(0, 90)] + [("b", 100 + i, 1) for i in range(30)] + [("b", 140, 0)]
    rows += [("c", 200 + i, 0) for i in range(50)]
    made = []

    def start():
        stream = spark.readStream.schema("profile string, seq long, label long").parquet(str(tmp_path / "in"))
        points = stateful.due_points(stream, 10)
        latest = lambda profile: max((v for p, v, _ in made if p == profile), default=0)
        return stateful.trained(points, lambda *p: made.append(p), latest, str(tmp_path / "c"))

    seen = []
    for part in (rows[:35], rows[35:110], rows[110:]):
        spark.createDataFrame(part, "profile string, seq long, label long").write.mode("append").parquet(str(tmp_path / "in"))
        start().awaitTermination()
        seen.append(sorted(made))
    points = plain_points(rows, 10)
    last = {p: (v, s) for p, v, s, *_ in points}
    assert {p: (v, s) for p, v, s in sorted(made, key=lambda m: m[1])} == last and "c" not in last
    assert all(any(m == p[:3] for p in points) for m in made)
    # the last batch comes again, as after a crash before its commit: nothing is trained twice
    before = list(made)
    commits = tmp_path / "c" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink()
    start().awaitTermination()
    assert made == before


def test_models_are_published_once(spark, tmp_path):
    from heliograph.operators import learning, preference

    rng = random.Random(1)
    said = [(i, i % 12, 8.0 * (i // 12), int(i % 3 == 0), "quality") for i in range(40)]
    schema = "seq long, item_key long, t double, label int, profile string"
    frame = spark.createDataFrame([(i, k, 8.0 * t, [rng.gauss(k % 3, 1), rng.gauss(0, 1)]) for i, (k, t) in enumerate((k, t) for k in range(12) for t in range(4))], "vec_id long, item_key long, t double, vec array<double>")
    root = str(tmp_path / "models")

    def start(rows):
        spark.createDataFrame(rows, schema).select("profile", "seq", "label").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("profile string, seq long, label int").parquet(str(tmp_path / "in"))
        store = lambda: spark.createDataFrame(said, schema)
        stateful.autotrain(stream, store, frame, root, str(tmp_path / "c"), 2, every=10).awaitTermination()
        return sorted(p.name for p in (tmp_path / "models" / "quality").glob("model-*")) if (tmp_path / "models").exists() else []

    assert start(said[:8]) == [] and stateful.latest_model(spark, root, "quality", 2) is None
    assert start(said[8:12]) == ["model-1"]
    assert start(said[12:33]) == ["model-1", "model-3"]  # two points in one batch: the last one counts
    entry = Manifest(spark, f"{root}/quality/versions", stateful.MODEL).entries().orderBy(F.desc("version")).first()
    assert (entry.version, entry.seq) == (3, 29)
    rows = preference.training_set(preference.keep_latest(spark.createDataFrame(said[:30], schema)), frame)
    want = learning.fit_logistic(rows).coefficients.toArray()
    assert np.allclose(stateful.latest_model(spark, root, "quality", 2).coefficients.toArray(), want, atol=1e-6)


def test_nothing_is_due(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1), ("a", 2, 0)], "profile string, seq long, label long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("profile string, seq long, label long").parquet(str(tmp_path / "in"))
    points = stateful.due_points(stream, 0)
    q = points.writeStream.format("memory").queryName("none_due").option("checkpointLocation", str(tmp_path / "c"))
    stateful.started(q.trigger(availableNow=True), points).awaitTermination()
    assert spark.table("none_due").collect() == []


# --- versions of an index ----------------------------------------------------------------------------------------


def cache(spark, items, per=2):
    rows = [(k, float(t), [1.0 + k, 2.0]) for k in items for t in range(per)]
    return spark.createDataFrame(rows, "item_key long, t double, vec array<double>")


def test_index_is_rebuilt_by_its_count(spark, tmp_path):
    index = Snapshots(spark, str(tmp_path))
    assert index.current() is None
    with pytest.raises(FileNotFoundError):
        index.read()
    empty, built = index.index(cache(spark, [1]).where("false"))
    assert built and empty.rows == 0
    one, built = index.index(cache(spark, [1, 2]))  # the last one is empty
    assert built and (one.version, one.keys, one.rows) == (2, 2, 4)
    assert index.index(cache(spark, [1, 2, 3])) == (one, False)
    assert index.index(cache(spark, [7, 8], 5), refresh=True) == (one, False)  # as many items as before
    old = index.read(one)
    two, built = index.index(cache(spark, [1, 2, 3]), refresh=True)
    assert built and index.current() == two and two.version == 3
    assert old.count() == 4 and index.read().count() == 6
    assert abs(index.read().agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] - 1) < 1e-12
    assert index.vacuum(keep=1) == 2 and index.current() == two and index.read().count() == 6


def test_two_builders_and_a_half_written_entry(spark, tmp_path):
    one, two = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    a = one.publish(cache(spark, [1]), 1)
    real = two.manifest.numbers
    two.manifest.numbers = lambda: []  # has not seen the other one's entry
    b = two.publish(cache(spark, [1, 2]), 2)
    two.manifest.numbers = real
    assert (a.version, b.version) == (1, 2) and one.current() == b
    assert not Manifest(spark, str(tmp_path / "manifest")).add(2, path="", keys=0, rows=0)
    (tmp_path / "manifest" / "000000000003.json").write_text("")  # its writer died
    assert one.current() == b
    assert one.publish(cache(spark, [1, 2, 3]), 3).version == 4 and two.current().keys == 3


# --- passes ------------------------------------------------------------------------------------------------------


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    calls = []

    def run(checkpoint, fail=False):
        def after(rows, number):
            calls.append((number, rows.count()))
            if fail:
                raise RuntimeError("crash before the batch's commit")

        stream = incremental.file_stream(spark, source, "item_key long, v array<double>")
        incremental.pass_over(stream, target, str(tmp_path / checkpoint), lambda b: b, after=after).awaitTermination()

    def land(keys):
        spark.createDataFrame([(k, [float(k)]) for k in keys], "item_key long, v array<double>").write.mode("append").parquet(source)

    def have():
        return sorted(r.item_key for r in incremental.landed(spark, target).collect())

    land([1, 2, 2, 3])
    assert incremental.landed(spark, target) is None
    with pytest.raises(Exception, match="crash"):
        run("c", fail=True)
    assert have() == [1, 2, 3]
    run("c")
    assert have() == [1, 2, 3] and calls == [(0, 3), (0, 3)]
    land([3, 4])
    run("c")
    assert have() == [1, 2, 3, 4] and calls[2:] == [(1, 1)]
    run("lost")  # another checkpoint: everything is read again, nothing is written twice
    assert have() == [1, 2, 3, 4] and calls[3:] == [(2, 0)]
    land([5])
    run("lost")
    assert have() == [1, 2, 3, 4, 5]


# --- the perceptron ----------------------------------------------------------------------------------------------


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    shape = perceptron.Shape(4, 6)
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), rng.uniform(0.1, 3, 30)
    p = shape.start(1)
    _, grad = perceptron.loss_and_gradient(shape, p, x, y, w)
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        up, down = (perceptron.loss_and_gradient(shape, p + s, x, y, w)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-5 * max(1, abs(grad[i]))


def ring(n, seed):
    """Points inside a ring against points outside: no line tells them apart."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, (np.hypot(*x.T) > 1.2).astype(int)


def test_perceptron_learns_what_a_line_cannot(spark):
    x, y = ring(400, 1)
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "vec array<double>, label int").repartition(11)
    model = perceptron.fit(rows, hidden=16, steps=120)
    test_x, test_y = ring(500, 2)
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(test_x)] + [(999, None)], "k long, vec array<double>")
    got = {r.k: r.p for r in model.predict(test).collect()}
    assert np.mean([(got[i] > 0.5) == c for i, c in enumerate(test_y)]) > 0.95 and got[999] is None
    # the same objective by plain gradient descent does not get lower
    shape, mask = model.shape, model.shape.penalised()

    def value(p):
        loss, grad = perceptron.loss_and_gradient(shape, p, x, y.astype(float), np.ones(len(x)))
        return (loss + 5e-4 * float(mask @ (p * p))) / len(x), (grad + 1e-3 * mask * p) / len(x)

    assert abs(value(model.parameters)[0] - model.loss) < 1e-9
    p = shape.start(0)
    for _ in range(3000):
        p = p - 0.5 * value(p)[1]
    assert model.loss < value(p)[0] + 1e-3


def test_row_weights_are_repetitions(spark, tmp_path):
    x, y = ring(60, 3)
    rows = [(v.tolist(), int(c), 1 + i % 3) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    weighted = spark.createDataFrame(rows + [([0.0, 0.0], 1, 0), ([0.0, 0.0], None, 5)], "vec array<double>, label int, w int")
    repeated = spark.createDataFrame([r for r in rows for _ in range(r[2])], weighted.schema)
    a = perceptron.fit(weighted, hidden=4, weight="w", steps=15)
    b = perceptron.fit(repeated, hidden=4, steps=15)
    assert abs(a.loss - b.loss) < 1e-9 and np.allclose(a.parameters, b.parameters, atol=1e-6)
    a.save(spark, str(tmp_path / "m"))
    back = perceptron.Perceptron.load(spark, str(tmp_path / "m"))
    assert back.shape == a.shape and np.array_equal(back.parameters, a.parameters)
    with pytest.raises(ValueError):
        perceptron.fit(weighted.where("label = 1"))
