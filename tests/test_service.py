import pytest
from pyspark.sql import functions as F

from heliograph.plans.search import vocabulary
from heliograph.service import Library, Settings
from heliograph.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library(spark):
    s = tables.samples(spark, FOLDER)
    marks = spark.createDataFrame([(1, 3, 8.0, None)], "marker_id long, item_key long, start double, end double")
    details = s.select("item_key").distinct().selectExpr("item_key", "1 as counter", "cast(null as double) as rating")
    bridge = s.selectExpr("grp as entity", "item_key").distinct()
    yield (lib := Library(s, tables.verdicts(spark, FOLDER).where("profile = 'toxic'"), marks, bridge, details, vocabulary(spark, FOLDER), Settings(modes=400)))
    lib.forget()


def test_calls(library):
    assert library.similar(3, 8.0).count() == 60 and library.text("group 1", "group 2").count() == 60
    assert library.similar(3, 8.0, 0.2).where("score < 0.2").count() == 0
    assert library.board(20, "a").count() == 20 and library.recommend(12, "a").count() == 12
    first = [r.vec_id for r in library.recommend(12, "a").orderBy("place").collect()]
    assert first == [r.vec_id for r in library.recommend(12, "a").orderBy("place").collect()]
    assert library.next_to_label().count() == 1 and library.candidates(3, 2, 30, "s").count() == 30
    assert library.bands().count() == 5 and library.leaderboard().count() > 0 and library.tags(2).count() == 100


def test_segments_and_jobs(library):
    with library.job("score") as group:
        found = library.segments(library.scores(scorer=lambda v: v[0]))
        assert group.startswith("score-") and found.where(F.col("end") < F.col("start")).count() == 0
    with pytest.raises(ValueError, match="normalisation"):
        Library(library.samples, settings=Settings().changed(normalise="x")).segments(library.preference())
