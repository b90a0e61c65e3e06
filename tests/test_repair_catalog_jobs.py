"""The retry ladder carried out, the catalog as a data source, and jobs that stop between batches."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from heliograph.operators.repair import EXHAUSTED, LADDER, NO_WAY, repair
from heliograph.sources.catalog_source import CatalogReader, Pages, catalog
from heliograph.sources.stores import FAILURES
from heliograph.streaming import incremental
from heliograph.streaming.jobs import Jobs

# --- the ladder --------------------------------------------------------------------------------------------------


def failures(spark, keys):
    rows = [(f"k{i}", f"i{i}", f"/films/{i}.mp4", f"first error {i}", "sparse", "cuda", "raw", "m", float(i)) for i in keys]
    return spark.createDataFrame(rows, FAILURES).repartition(3)


def paths(spark, keys):
    return spark.createDataFrame([(f"/films/{i}.mp4",) for i in keys], "path string")


def attempts(calls, works):
    """Items work in the way ``works`` says; what was tried is noted."""

    def attempt(items, mode, hwaccel, pipeline):
        calls.append((mode, hwaccel, pipeline, sorted(r.item_key for r in items.select("item_key").collect())))
        good = [k for k, way in works.items() if way == mode]
        ok = F.col("item_key").isin(good)
        return items.select("item_key", ok.alias("ok"), F.when(~ok, F.concat(F.lit(f"{mode} failed on "), "path")).alias("error"), F.lit(7).alias("frames"))

    return attempt


def test_each_stage_takes_what_the_one_before_left(spark, tmp_path):
    log, calls = failures(spark, range(6)), []
    works = {"k0": "sparse", "k1": "interval", "k2": "sparse"}
    out = repair(log, paths(spark, [0, 1, 2, 3]), attempts(calls, works), str(tmp_path), 100.0, model="m2")
    assert calls == [("sparse", "", "raw", ["k0", "k1", "k2", "k3"]), ("interval", "", "jpeg", ["k1", "k3"])]
    assert (out.total, out.fixed, out.failed, out.left) == (6, 3, 3, 0)
    after = {r.item_key: r for r in out.log.collect()}
    assert set(after) == {"k3", "k4", "k5"}
    assert (after["k3"].error, after["k3"].mode, after["k3"].ts, after["k3"].model) == ("interval failed on /films/3.mp4", EXHAUSTED, 100.0, "m2")
    assert after["k4"].error == "first error 4" and after["k4"].ts == 4.0  # its file is missing: nothing is said anew
    assert {(r.item_key, r.mode, r.pipeline, r.frames) for r in out.made.collect()} == {
        ("k0", "sparse", "raw", 7), ("k1", "interval", "jpeg", 7), ("k2", "sparse", "raw", 7),
    }


def test_a_broken_or_stopped_run_goes_on(spark, tmp_path):
    log, calls, there = failures(spark, range(4)), [], paths(spark, range(4))
    good = attempts(calls, {"k0": "sparse", "k1": "interval"})

    def breaks(items, mode, hwaccel, pipeline):
        if mode == "interval":
            raise OSError("lost")
        return good(items, mode, hwaccel, pipeline)

    with pytest.raises(OSError):
        repair(log, there, breaks, str(tmp_path), 9.0)
    halted = repair(log, there, good, str(tmp_path), 9.0, stopped=lambda: True)
    assert (halted.fixed, halted.failed, halted.left) == (1, 0, 3) and {r.item_key for r in halted.log.collect()} == {"k1", "k2", "k3"}
    assert all(r.mode == "sparse" for r in halted.log.collect())  # nothing is exhausted yet
    out = repair(log, there, good, str(tmp_path), 9.0)
    assert [c[0] for c in calls] == ["sparse", "interval"] and (out.fixed, out.failed) == (2, 2)
    again = repair(log, there, breaks, str(tmp_path), 9.0)  # all is there, nothing is tried
    assert (again.fixed, again.failed) == (2, 2) and {r.item_key for r in again.log.collect()} == {"k2", "k3"}


def test_limits_and_empty_logs(spark, tmp_path):
    calls = []
    out = repair(failures(spark, range(5)), paths(spark, range(5)), attempts(calls, {}), str(tmp_path / "a"), 50.0, limit=2)
    assert calls[0][3] == ["k0", "k1"] and (out.total, out.failed) == (2, 2) and out.log.count() == 5
    silent = lambda items, *way: items.select("item_key", F.lit(False).alias("ok"), F.lit("").alias("error"))
    out = repair(failures(spark, [1]), paths(spark, [1]), silent, str(tmp_path / "b"), 50.0)
    assert out.log.first().error == NO_WAY
    out = repair(failures(spark, []), paths(spark, []), silent, str(tmp_path / "c"), 50.0)
    assert (out.total, out.fixed, out.failed, out.log.count()) == (0, 0, 0, 0) and len(LADDER) == 2


# --- the catalog -------------------------------------------------------------------------------------------------


@pytest.fixture
def service():
    """A catalog over HTTP that notes what it is asked, and fails once in a while."""
    items = [
        {"id": f"{i:04d}", "title": f"t{i}", "path": f"/{'films' if i % 5 == 0 else 'shorts'}/{i}.mp4", "duration": 1.5 * i, "tag": "ab"[i % 2], "updated": float(i)}
        for i in range(237)
    ]
    asked, trouble = [], [503, 429]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if trouble:
                self.send_error(trouble.pop())
                return
            asked.append(body)
            fits = [
                x for x in items
                if x["path"].startswith(body["prefix"] or "") and body["tag"] in (None, x["tag"]) and x["updated"] >= (body["since"] or 0)
            ]
            page = fits[(body["page"] - 1) * body["size"] :][: body["size"]]
            out = json.dumps({"count": len(fits), "items": page}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/", items, asked
    server.shutdown()


def pages_of(asked):
    return sorted(b["page"] for b in asked if b["size"])


def test_pages_are_partitions(spark, service):
    address, items, asked = service
    rows = catalog(spark, address, 50, sleeps="0.01,0.01,0.01")
    assert sorted(r.id for r in rows.collect()) == [x["id"] for x in items] and pages_of(asked) == [1, 2, 3, 4, 5]
    assert rows.rdd.getNumPartitions() == 5
    first = rows.where("id = '0007'").first()
    assert (first.title, first.path, first.duration, first.tag, first.updated) == ("t7", "/shorts/7.mp4", 10.5, "b", 7.0)


def test_conditions_reach_the_service(spark, service):
    address, items, asked = service
    rows = catalog(spark, address, 20, sleeps="0.01,0.01")
    got = rows.where("path LIKE '/films/%' AND tag = 'a' AND updated > 100 AND duration < 300").select("id")
    want = [x["id"] for x in items if x["path"].startswith("/films/") and x["tag"] == "a" and x["updated"] > 100 and x["duration"] < 300]
    assert sorted(r.id for r in got.collect()) == want
    assert pages_of(asked) == [1] and asked[-1] | {"page": 1} == {"page": 1, "size": 20, "prefix": "/films/", "tag": "a", "since": 100.0}
    del asked[:]
    assert catalog(spark, address, 20).where("tag = 'a' AND tag = 'b'").count() == 0
    assert catalog(spark, address, 20).where("path LIKE '/none/%'").count() == 0 and not pages_of(asked)


def test_which_conditions_are_taken():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, StringStartsWith

    reader = CatalogReader({"address": ""})
    filters = [StringStartsWith(("path",), "/a"), StringStartsWith(("path",), "/a/b"), EqualTo(("tag",), "x"), EqualTo(("title",), "y"),
               GreaterThan(("updated",), 3.0), GreaterThanOrEqual(("updated",), 5.0), EqualTo(("a", "tag"), "z")]
    left = list(reader.pushFilters(filters))
    assert left == [filters[1], filters[3], filters[4], filters[6]]
    assert (reader.asked.prefix, reader.asked.tag, reader.asked.since) == ("/a", "x", 5.0)


def test_a_growing_catalog_as_a_stream(spark, service, tmp_path):
    address, items, asked = service
    late, items[101:] = items[101:], []

    def run():
        del asked[:]
        stream = catalog(spark, address, 25, stream=True, sleeps="0.01,0.01")
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [x["id"] for x in items] and pages_of(asked) == [1, 2, 3, 4, 5]
    items.extend(late[:30])
    assert run() == [x["id"] for x in items] and pages_of(asked) == [5, 6]  # the last page again, from where it was left
    assert run() == [x["id"] for x in items] and pages_of(asked) == []


def test_a_page_range_is_cut_at_its_ends(service):
    address, items, _ = service
    from heliograph.sources.catalog_source import Asked, _rows

    got = _rows({"address": address, "sleeps": "0,0"}, 10, Pages(17, 42), Asked())
    assert [r[0] for r in got] == [x["id"] for x in items[17:42]]


# --- jobs --------------------------------------------------------------------------------------------------------


def test_a_stopped_pass_goes_on_without_loss_or_repeats(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for n in range(4):
        spark.range(10 * n, 10 * n + 12).selectExpr("id as item_key").coalesce(1).write.mode("append").parquet(str(source))
    jobs, seen = Jobs(spark), []

    def start(checkpoint="c", stop_after=None):
        def run(job):
            def after(rows, number):
                seen.append(number)
                if stop_after is not None and len(seen) >= stop_after:
                    job.asked_to_stop.set()

            stream = incremental.file_stream(spark, str(source), "item_key long", files_per_trigger=1)
            return incremental.pass_over(stream, target, str(tmp_path / checkpoint), lambda b: b, after=after, stopped=job.stopped)

        return jobs.start("pass", run)

    first = start(stop_after=2)
    assert first.wait() == "stopped" and seen == [0, 1]
    second = start()
    assert second.wait() == "done" and seen == [0, 1, 2, 3]
    keys = [r.item_key for r in incremental.landed(spark, target).collect()]
    assert sorted(keys) == list(range(42))
    table = jobs.table().collect()
    assert [(r.id, r.state) for r in table] == [(second.id, "done"), (first.id, "stopped")] and table[0].error is None
    assert {(r.id, r.batch) for r in jobs.progress().collect()} >= {(second.id, 2), (second.id, 3), (first.id, 0)}


def test_a_failed_job_says_why(spark, tmp_path):
    spark.range(3).selectExpr("id as item_key").write.parquet(str(tmp_path / "in"))

    def broken(batch):
        raise ValueError("no such picture")

    def run(job):
        stream = incremental.file_stream(spark, str(tmp_path / "in"), "item_key long")
        return incremental.pass_over(stream, str(tmp_path / "out"), str(tmp_path / "c"), broken)

    jobs = Jobs(spark)
    job = jobs.start("pass", run)
    assert job.wait() == "failed" and "no such picture" in jobs.table().first().error


def test_a_waiting_stream_stops_at_once(spark, tmp_path):
    spark.range(3).selectExpr("id as item_key").write.parquet(str(tmp_path / "in"))

    def run(job):
        stream = incremental.file_stream(spark, str(tmp_path / "in"), "item_key long")
        return incremental.pass_over(stream, str(tmp_path / "out"), str(tmp_path / "c"), lambda b: b, every="1 hour", stopped=job.stopped)

    job = Jobs(spark).start("pass", run)
    until = time.time() + 60
    while time.time() < until and (incremental.landed(spark, str(tmp_path / "out")) is None or job.query.status["isTriggerActive"]):
        time.sleep(0.2)
    assert job.state() == "running"
    job.stop()
    assert job.wait(30) == "stopped"
