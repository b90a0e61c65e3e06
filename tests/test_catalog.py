import pytest
from pyspark.sql import functions as F

from heliograph.functions import scalars
from heliograph.operators import catalog, learning, preference
from heliograph.sources import stores
from heliograph.streaming import incremental


def test_reconcile_and_prune(spark):
    cached = spark.createDataFrame([("fp1", "/old", 1), ("fp2", "/b", 2), ("fp3", "/c", 3)], "item_key string, path string, item_id int")
    live = spark.createDataFrame([("fp1", "/new", 1), ("fp3", "/c", 3), ("fp4", "/d", 4)], "item_key string, path string, item_id int")
    assert {r.item_key: r.status for r in catalog.reconcile(cached, live).collect()} == {"fp1": "moved", "fp2": "orphaned", "fp3": "cached", "fp4": "new"}
    assert {r.item_key for r in catalog.prune(cached, live).collect()} == {"fp1", "fp3"}
    with pytest.raises(ValueError, match="empty"):
        catalog.prune(cached, live.limit(0))


def test_playlist(spark):
    m = spark.createDataFrame([(1, "i", 1.0, 25.0, "apex 0.873", "a"), (1, "i", 1.0, 25.0, "apex 0.873", "b"), (2, "i", 30.0, None, "plain", "b"), (3, None, 1.0, 2.0, "x", "a"), (4, "j", 5.0, 5.0, "y 1", "b")], "marker_id int, item_key string, start double, end double, title string, tag string")
    got = {r.marker_id: r for r in catalog.playlist(m, ["a", "b"]).collect()}
    assert set(got) == {1, 2, 4} and got[1].score == 0.873 and got[2].end == 50 and got[2].score is None and got[4].duration == 20


def test_scopes_names_and_keys(spark):
    paths = ["/lib/a", "/lib/a/x", "/lib/ab/x", "/other"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in rows.where(scalars.under_path(F.col("path"), "/lib/a/")).collect()] == ["/lib/a", "/lib/a/x"]
    r = spark.range(1).select(scalars.safe_tag(F.lit("a b/é-_")).alias("t"), scalars.safe_name(F.lit("--..")).alias("n"), scalars.path_key(F.lit("/x")).alias("k"), scalars.score_title(F.lit("tag"), F.lit(0.5)).alias("s")).first()
    assert (r.t, r.n, r.s) == ("a_b_é-_", "reel", "tag 0.500") and r.k.startswith("path-") and len(r.k) == 21


def test_time_plans(spark):
    def plan(d, i, o=0.0):
        return spark.range(1).select(scalars.plan_timestamps(F.lit(float(d)), i, o).alias("p")).first().p

    assert plan(10, 4.0) == [0, 4, 8] and plan(10, 4.0, 1.0) == [1, 5, 9] and plan(0, 4.0) == [] and plan(-1, 4.0) == [] and plan(8, 4.0) == [0, 4]


def test_verdicts_and_failures(spark):
    v = spark.createDataFrame([(1, "k", 1.001, 1, "a"), (2, "k", 1.002, 0, "a"), (3, "k", 1.0, 1, "b")], "seq int, item_key string, t double, label int, profile string")
    assert {(r.profile, r.label) for r in preference.keep_latest(v).collect()} == {("a", 0), ("b", 1)}
    log = spark.createDataFrame([("k", "old", 1.0)], "item_key string, error string, ts double")
    new = spark.createDataFrame([("k", "n" * 900, 2.0), ("j", "e", 1.0)], "item_key string, error string, ts double")
    got = {r.item_key: r.error for r in catalog.record_failures(log, new).collect()}
    assert got == {"k": "n" * 500, "j": "e"} and catalog.resolve_failures(new, log).count() == 1


def test_sample_store(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "k", "i", "/p", float(t), [1.0, 0.0], 8.0) for t in range(3)] + [("m2", "k", "i", "/p", 0.0, [1.0], 2.0)], stores.SAMPLES)
    path = str(tmp_path / "cache")
    stores.write_samples(rows, path)
    stores.write_samples(rows.where("model = 'm2'"), path)
    got = stores.read_samples(spark, path, "m1")
    assert got.count() == 3 and "PartitionFilters: [isnotnull(model" in got._jdf.queryExecution().toString()
    assert stores.sample_counts(got).first().n == 3 and stores.up_to_date(got, 8.0).count() == 1 and stores.up_to_date(got, 7.0).count() == 0


def test_text_and_binary_sources(spark, tmp_path):
    (tmp_path / "words.txt").write_text("beach\n\n# no\n  office \n")
    assert [r.term for r in stores.vocabulary(spark, str(tmp_path / "words.txt")).collect()] == ["beach", "office"]
    (tmp_path / "sub").mkdir()
    for name in ("a.jpg", "b.txt", "sub/c.jpg"):
        (tmp_path / name).write_bytes(b"x\xff\xd8one\xff\xd9\xff\xd8two\xff\xd9\xff\xd8tail")
    images = stores.reference_images(spark, str(tmp_path))
    assert images.count() == 1 and [bytes(r.frame) for r in stores.stream_frames(images).collect()] == [b"\xff\xd8one\xff\xd9", b"\xff\xd8two\xff\xd9"]
    assert stores.fixed_chunks(images, 8).count() == 2


def test_landed_catalog(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"id":"1","title":"t","files":[],"markers":[{"id":"m","seconds":3.0,"end_seconds":0.0,"title":"x","primary_tag":{"id":"1","name":"a"}}]}\n')
    m = stores.catalog_markers(stores.landed_catalog(spark, str(tmp_path))).first()
    assert (m.item_id, m.start, m.end, m.primary_tag) == ("1", 3.0, None, "a")


def test_preference_models(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2) * 2 - 1 + 0.01 * (i % 7), 0.1 * (i % 5)]) for i in range(60)], "point_id long, label int, vec array<double>")
    p = learning.predict(learning.fit_logistic(rows), rows).collect()
    assert all((r.p > 0.5) == (r.label == 1) for r in p) and learning.cv_auc(rows) == 1.0
    learning.save(learning.fit_logistic(rows), str(tmp_path / "m"), "a", 2, "logistic")
    assert learning.predict(learning.load(spark, str(tmp_path / "m"), "a", 2), rows).count() == 60
    with pytest.raises(ValueError, match="dimensions"):
        learning.load(spark, str(tmp_path / "m"), "a", 3)
    with pytest.raises(ValueError, match="positive"):
        learning.fit_logistic(rows.where("label = 1"))


def test_passes_skip_what_is_there(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).selectExpr("id as item_key").write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run(n):
        stream = incremental.file_stream(spark, source, schema)
        incremental.pass_over(stream, str(tmp_path / "out"), str(tmp_path / f"c{n}"), lambda b: b.withColumn("n", F.lit(n))).awaitTermination()

    run(1)
    spark.range(3, 8).selectExpr("id as item_key").write.mode("append").parquet(source)
    run(2)
    got = {r.item_key: r.n for r in incremental.landed(spark, str(tmp_path / "out")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}


def test_stream_runs_equal_batch_runs(spark, tmp_path):
    from heliograph.operators import segments

    rows = [(k, float(100 * i), float((i * 37 + k * 11) % 100)) for k in range(4) for i in range(50)]
    data = spark.createDataFrame(rows, "item_key long, t double, score double").withColumn("ts", F.timestamp_seconds("t"))
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), data.schema)
    q = incremental.online_runs(stream, 60.0, 30.0, "10 seconds").writeStream.format("memory").queryName("runs_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    live = {(r.item_key, r.start, r.end, r.peak, round(r.mean, 6), r.n) for r in spark.table("runs_test").collect()}
    batch = {(r.item_key, r.start, r.end, r.peak, round(r.mean, 6), r.n) for r in segments.runs(segments.hysteresis(data, 60.0, 30.0)).collect()}
    assert live <= batch and len(batch) - len(live) <= 4 + 2 * 4  # what the watermark has not closed yet


def test_collections_and_label_store(spark, tmp_path):
    folder = str(tmp_path / "collections")
    moments = spark.createDataFrame([("a", 1.0, 2.0, 0.5), ("b", 3.0, 4.0, None)], "item_key string, start double, end double, score double")
    assert stores.list_collections(spark, folder).count() == 0 and stores.load_collection(spark, folder, "x") is None
    stem = stores.write_collection(moments, folder, "My best/one", "beach")
    stores.write_collection(moments.limit(1), folder, "other")
    assert [(r.stem, r.name, r["count"]) for r in stores.list_collections(spark, folder).collect()] == [(stem, "My best/one", 2), ("other", "other", 1)]
    assert stores.rename_collection(spark, folder, "My best/one", " New ") == stem
    got = stores.load_collection(spark, folder, "My best/one").first()
    assert (got.name, got.query, [m.item_key for m in got.moments]) == ("New", "beach", ["a", "b"])
    with pytest.raises(ValueError, match="no collection"):
        stores.rename_collection(spark, folder, "gone", "x")
    assert stores.delete_collection(spark, folder, "other") and not stores.delete_collection(spark, folder, "other")
    assert stores.list_collections(spark, folder).count() == 1
    path = str(tmp_path / "labels")
    rows = spark.createDataFrame([("k", 1.0, 1, "a", None, 5.0), ("k", 1.001, 0, "a", None, 6.0)], stores.VERDICTS)
    stores.write_verdicts(rows, path)
    stores.write_verdicts(rows, path)
    assert [r.label for r in stores.read_json_store(spark, path, stores.VERDICTS).collect()] == [0]


def test_tags_markers_and_lookups(spark):
    tags = spark.createDataFrame([(4, "sea"), (2, "sea"), (9, "sky")], "tag_id long, name string")
    got = {r.name: (r.tag_id, r.created) for r in catalog.ensure_tags(tags, ["new", "sea", "", "Sea", "new"]).collect()}
    assert got == {"new": (10, True), "sea": (2, False), "Sea": (11, True)}
    assert [r.tag_id for r in catalog.ensure_tags(tags.limit(0), ["a"]).collect()] == [1]
    old = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "marker_id long, title string, end double")
    new = spark.createDataFrame([(2, "again"), (3, "c")], "marker_id long, title string")
    assert sorted((r.marker_id, r.title, r.end) for r in catalog.create(old, new, "marker_id").collect()) == [(1, "a", 2.0), (2, "b", None), (3, "c", None)]
    rows = spark.createDataFrame([("k", "x", 1), ("k", "y", 2), ("k", "z", None)], "key string, value string, at int")
    assert catalog.lookup(rows, "key", "value", "at").first().value == "x"
    assert catalog.lookup(rows, "key", "value", "at", last=True).first().value == "y"


def test_run_stats_and_queue(spark):
    def one(rows):
        frame, seen = incremental.observed(spark.createDataFrame(rows, "status string, frames int, seconds double"))
        assert len(frame.collect()) == len(rows)
        return incremental.run_stats(seen)

    first = one([("embedded", 5, 1.0), ("embedded", 3, 2.0), ("failed", None, 9.0), ("skipped", 0, 0.0)])
    assert first == {"embedded": 2, "skipped": 1, "failed": 1, "frames": 8, "seconds_per_item": 1.5}
    second = one([("skipped", 0, 0.0)])
    assert second == {"embedded": 0, "skipped": 1, "failed": 0, "frames": 0}
    both = incremental.queue([("a", lambda: first), ("b", lambda: second)])
    assert {k: both[k] for k in incremental.COUNTS} == {"embedded": 2, "skipped": 2, "failed": 1, "frames": 8}
    assert incremental.queue([("a", lambda: first)], lambda: True)["passes"] == {}


def test_items_without_scores_have_no_part_in_a_board(spark):
    from heliograph.operators import entities

    bridge = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "entity string, item_key long")
    scores = spark.createDataFrame([(1, 0.0, 0.5)], "item_key long, t double, score double")
    details = spark.createDataFrame([(1, 2, 80.0), (2, 7, 10.0), (3, 1, 1.0)], "item_key long, counter long, rating double")
    assert [(r.entity, r.items, r.moments, r.counter) for r in entities.leaderboard(bridge, scores, details).collect()] == [("p", 1, 1, 2)]


def test_a_board_is_made_in_tasks_of_one_size(spark, monkeypatch):
    """More order lines make more parts, not larger ones; no table of (entity, item) is left after items met the bridge."""
    from heliograph.plans import library
    from heliograph.sources import tables

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    lines = tables.table(spark, folder, "lineitem").count()
    for rows in (tables.bridge(spark, folder), library.item_scores(spark, folder), library.item_details(spark, folder)):
        assert rows.rdd.getNumPartitions() == -(-lines // 100) > 50
    plan = library.board(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan and plan.count("Exchange hashpartitioning(item_key") == 1


def test_a_pair_or_item_named_twice_counts_once(spark):
    from heliograph.operators import entities

    bridge = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", 2)], "entity string, item_key long")
    scores = spark.createDataFrame([(1, 0.0, 0.5), (1, 8.0, 0.25), (2, 0.0, 1.0)], "item_key long, t double, score double")
    details = spark.createDataFrame([(1, 2, 80.0), (1, 3, 20.0)], "item_key long, counter int, rating double")
    board = {r.entity: r[1:] for r in entities.leaderboard(bridge, scores, details).collect()}
    assert board == {"p": (2, 3, 1.0, 1.75 / 3, 5, 50.0), "q": (1, 1, 1.0, 1.0, 0, None)}
