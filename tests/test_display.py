import os

import pytest
from pyspark.sql import functions as F

from heliograph.functions import scalars
from heliograph.operators import learning, metrics
from heliograph.sources import stores


def test_stars_heat_and_links(spark):
    rows = spark.createDataFrame([(None,), (-5,), (9,), (10,), (50,), (89,), (100,), (140,)], "rating int")
    assert [r.s for r in rows.select(scalars.stars(F.col("rating")).alias("s")).collect()] == [0, 0, 0, 1, 3, 4, 5, 5]
    heats = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (7.0,)], "x double")
    colors = [r.c for r in heats.select(scalars.heat_color(F.col("x")).alias("c")).collect()]
    assert colors[0] == colors[1] and colors[3] == colors[4] and len(set(colors)) == 3
    names = spark.createDataFrame([("Ann Lee",), ("Bo",), (None,)], "name string")
    assert [r.name for r in names.where(scalars.has_name(F.col("name"), " LEE ")).collect()] == ["Ann Lee"]
    assert names.where(scalars.has_name(F.col("name"), "  ")).count() == 3
    one = spark.range(1).select(scalars.link("/x/", F.lit(3)).alias("a"), scalars.link("/x", F.lit(3), F.lit("s"), start=F.lit(None)).alias("b"), scalars.link("/x", F.lit(3), start=F.lit(1.5)).alias("c")).first()
    assert tuple(one) == ("/x/3", "/x/3/s", "/x/3?start=1.500")


def test_bands_cuts_and_strips(spark):
    scores = spark.createDataFrame([(1, 0.0, 0.1), (1, 1.0, 0.5), (1, 2.0, 0.9), (2, 0.0, 0.4), (3, 0.0, None)], "item_key int, t double, score double")
    cuts = spark.createDataFrame([(50, 0.4), (90, 0.8)], "pct int, cutoff double")
    got = [(r.score, r.band) for r in metrics.band_class(scores, cuts).orderBy("score").collect()]
    assert got == [(None, "low"), (0.1, "low"), (0.4, "top50"), (0.5, "top50"), (0.9, "top90")]
    assert {r.band for r in metrics.band_class(scores, cuts.limit(0)).collect()} == {""}
    strip = metrics.heat_strip(scores, "score").orderBy("t").collect()
    assert [(r.item_key, r.until, round(r.heat, 6)) for r in strip] == [(1, 1.0, 0.0), (1, 2.0, 0.5), (1, None, 1.0)]
    flat = spark.createDataFrame([(1, 0.0, 0.3), (1, 0.0, 0.3)], "item_key int, t double, score double")
    assert [r.heat for r in metrics.heat_strip(flat, "score").collect()] == [0.0, 0.0]
    cdf = spark.createDataFrame([(0, 0.0, 10, 4), (1, 0.5, 4, 3), (2, 1.0, 1, 1)], "step int, cutoff double, moments long, items long")
    assert tuple(metrics.at_cut(cdf, 0.7).first()) == (0.5, 4, 3, 60)
    assert tuple(metrics.at_cut(cdf, -1.0).first()) == (0.0, 10, 4, 0)
    assert metrics.at_cut(cdf.limit(0), 0.5).collect() == []


def test_transient_errors_are_tried_again():
    calls = []

    def broken(error, times):
        calls.append(1)
        if len(calls) <= times:
            raise error("no")
        return "yes"

    assert stores.patient(lambda: broken(ConnectionError, 2), (0, 0, 0)) == "yes" and len(calls) == 3
    calls.clear()
    with pytest.raises(TimeoutError):
        stores.patient(lambda: broken(TimeoutError, 9), (0, 0, 0))
    assert len(calls) == 4
    calls.clear()
    with pytest.raises(ValueError):
        stores.patient(lambda: broken(ValueError, 9), (0, 0, 0))
    assert len(calls) == 1


@pytest.mark.parametrize("total,count", [(0, 0), (7, 7), (10, 10), (23, 23), (23, 11)])
def test_paged_catalog_reads_every_row_once(spark, tmp_path, total, count):
    marks = str(tmp_path)

    def fetch(page, size):
        mark = f"{marks}/{page}"
        if not os.path.exists(mark):  # the first call for each page fails
            open(mark, "w").close()
            raise ConnectionError("down")
        ids = range(total)[(page - 1) * size : page * size]
        return [{"id": str(n), "title": None, "files": [{"path": f"/lib/{n}", "duration": 1.0}], "markers": []} for n in ids], count

    found = stores.paged_catalog(spark, fetch, size=5, tasks=3, sleeps=(0, 0))
    assert sorted(int(r.id) for r in found.collect()) == list(range(total))
    inside = stores.catalog_items(found, "/lib/3").collect()
    assert [(r.item_id, r.path) for r in inside] == ([("3", "/lib/3")] if total else [])


def test_first_file_gives_key_and_length(spark):
    rows = [("1", None, [("/a", 9.0, {"md5": "m", "oshash": "o"}), ("/b", 1.0, {})]), ("2", "t", []), ("3", "t", None), ("4", "t", [("/c", None, None)])]
    kind = "id string, title string, files array<struct<path:string,duration:double,fingerprints:map<string,string>>>"
    got = {r.item_id: r for r in stores.catalog_items(spark.createDataFrame(rows, kind)).collect()}
    assert (got["1"].item_key, got["1"].path, got["1"].duration) == ("o", "/a", 9.0)
    assert got["2"].item_key is None and got["3"].path is None and got["4"].item_key.startswith("path-")


def test_reels_maps_and_models(spark, tmp_path):
    folder = tmp_path / "out"
    assert stores.list_reels(spark, str(folder)).count() == 0
    folder.mkdir()
    for n, name in enumerate(["b.mp4", "a.mp4", "c.txt"]):
        (folder / name).write_bytes(b"x" * (n + 1))
        os.utime(folder / name, (1000 + n * 100, 1000 + n * 100))
    assert [(r.name, r.bytes) for r in stores.list_reels(spark, str(folder)).collect()] == [("a.mp4", 2), ("b.mp4", 1)]

    path = str(tmp_path / "maps")
    assert stores.read_map(spark, path, "v") is None
    points = spark.createDataFrame([("v", 1, 0.1), ("w", 2, 0.2)], "space string, item_key int, x double")
    stores.write_map(points, path)
    stores.write_map(points.where("space = 'v'").withColumn("x", F.lit(0.7)), path)
    assert [r.x for r in stores.read_map(spark, path, "v").collect()] == [0.7]
    assert [r.x for r in stores.read_map(spark, path, "w").collect()] == [0.2] and stores.read_map(spark, path, "z") is None

    models = str(tmp_path / "models")
    assert learning.saved(spark, models).count() == 0 and not learning.delete(spark, f"{models}/one")
    rows = spark.createDataFrame([([float(n % 2), 1.0], n % 2) for n in range(8)], "vec array<double>, label int")
    learning.save(learning.fit_logistic(rows), f"{models}/one", "taste", 2, "logistic")
    assert [tuple(r) for r in learning.saved(spark, models).collect()] == [("one", "logistic", "taste", 2)]
    assert learning.delete(spark, f"{models}/one") and learning.saved(spark, models).count() == 0
