"""Queries of streams with state, versioned indexes and large reference sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, layout, learning, preference, search
from ..operators.repair import repair
from ..operators.search import best_places
from ..operators.tiled import similarity_tiled
from ..sources.scratch import own_folder, written
from ..sources.snapshots import Snapshots
from ..sources.tables import DIM, samples, seconds, table, verdicts
from .registry import chance, query
from .search import CENTRES, liked, preferred

GOOD = "good AS (SELECT vec FROM s JOIN labels ON vec_id = doc_id WHERE quality = 1)"


def tiled(spark: SparkSession, folder: str, reduce: str) -> DataFrame:
    s = samples(spark, folder)
    good = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    found = similarity_tiled(s.select("vec_id", "vec"), s.join(good, "vec_id").select("vec"), reduce)
    return found.select("vec_id", F.round("score", 4).alias("score"))


@query(
    f"""WITH {GOOD}
    SELECT vec_id, round(max(list_inner_product(s.vec, g.vec)), 4) AS score FROM s, good g GROUP BY vec_id""",
    "s",
)
def similarity_tiled_max(spark, folder):
    """Samples against all samples of good documents, in a grid of blocks."""
    return tiled(spark, folder, "max")


@query(
    f"""WITH {GOOD}
    SELECT vec_id, round(avg(list_inner_product(s.vec, g.vec)), 4) AS score FROM s, good g GROUP BY vec_id""",
    "s",
)
def similarity_tiled_mean(spark, folder):
    return tiled(spark, folder, "mean")


def in_two_starts(rows: DataFrame, order: str, run: Callable[[DataFrame, str], object]) -> None:
    """Lands ``rows`` in two parts by ``order``, and runs the stream over what has landed after each of them.

    ``run(stream, checkpoint)`` is given the same checkpoint twice, so the second start is a restart.
    """
    spark, base = rows.sparkSession, own_folder(rows.sparkSession, "flow")
    rows = written(rows, "flow")
    middle = rows.stat.approxQuantile(order, [0.5], 0.1)
    for part in ("{} <= {}", "{} > {}") if middle else ():
        rows.where(part.format(order, middle[0])).write.mode("append").parquet(f"{base}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/checkpoint")


@query(
    """WITH lib AS (SELECT item_key, row_number() OVER (ORDER BY round(max(score), 6) DESC, item_key) AS place
      FROM p GROUP BY item_key),
    n AS (SELECT (count(*) + 2) // 3 AS pages FROM lib),
    r AS (SELECT user_id AS session, event_id AS request,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT session, request, i // pages AS cycle, place - i % pages * 3 AS slot, item_key
    FROM r, n, lib WHERE (place - 1) // 3 = i % pages""",
    "p",
)
def session_feed(spark, folder):
    """Every event asks for its user's next three items, best first, anew when all have been shown; with a restart."""
    from ..streaming.stateful import FEED, session_feed, started

    library = written(best_places(preferred(spark, folder)), "feed")
    size, out = library.count(), own_folder(spark, "feed")
    events = table(spark, folder, "events")
    asked = events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("request"), seconds(F.col("ts")).alias("asked"),
        F.lit(3).alias("count"),
    )

    def run(stream: DataFrame, checkpoint: str) -> None:
        answers = session_feed(stream, size)
        writer = answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        started(writer.trigger(availableNow=True), answers).awaitTermination()

    in_two_starts(asked, "asked", run)
    answers = spark.read.schema(FEED).parquet(out)
    return answers.join(library, "place").select("session", "request", "cycle", "slot", "item_key")


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq) AS i,
        count(*) FILTER (WHERE label = 1) OVER (PARTITION BY profile ORDER BY seq) AS positive FROM v),
    f AS (SELECT profile, greatest(25, min(i) FILTER (WHERE label = 1), min(i) FILTER (WHERE label = 0)) AS first
      FROM n GROUP BY profile HAVING count(DISTINCT label) = 2)
    SELECT profile, (i - first) // 25 + 1 AS version, seq, i AS verdicts, positive, i - positive AS negative
    FROM n JOIN f USING (profile) WHERE i >= first AND (i - first) % 25 = 0""",
    "v",
)
def autotrain_points(spark, folder):
    """When a stream of verdicts makes the next model of a profile due; with a restart."""
    from ..streaming.stateful import DUE, due_points, started

    out = own_folder(spark, "due")

    def run(stream: DataFrame, checkpoint: str) -> None:
        due = due_points(stream, 25)
        writer = due.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        started(writer.trigger(availableNow=True), due).awaitTermination()

    in_two_starts(verdicts(spark, folder).select("profile", "seq", "label"), "seq", run)
    return spark.read.schema(DUE).parquet(out)


@query(
    """WITH one AS (SELECT count(DISTINCT item_key) AS keys, count(*) AS n FROM s WHERE grp < 5),
    two AS (SELECT count(DISTINCT item_key) AS keys, count(*) AS n FROM s)
    SELECT * FROM (
      SELECT 1 AS step, 1 AS version, keys, n, true AS built FROM one UNION ALL SELECT 2, 1, keys, n, false FROM one
      UNION ALL SELECT 3, 1, keys, n, false FROM one
      UNION ALL SELECT 4, CASE WHEN two.keys > one.keys THEN 2 ELSE 1 END,
        CASE WHEN two.keys > one.keys THEN two.keys ELSE one.keys END,
        CASE WHEN two.keys > one.keys THEN two.n ELSE one.n END, two.keys > one.keys FROM one, two
      UNION ALL SELECT 5, 1, keys, n, false FROM one)""",
    "s",
)
def index_refresh(spark, folder):
    """An index while its samples grow: built, kept, kept as nothing came, built anew, and the first version read again."""
    index = Snapshots(spark, own_folder(spark, "index"))
    all_ = samples(spark, folder).select("item_key", "t", "vec", "grp")
    part = all_.where("grp < 5")
    steps = [(part, False), (all_, False), (part, True), (all_, True)]
    found = [index.index(rows, refresh) for rows, refresh in steps]
    found.append((found[0][0], False))
    read = [
        index.read(v).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(i).alias("step"), F.lit(v.version).alias("version"), F.lit(v.keys).alias("keys"), "n",
            F.lit(built).alias("built"),
        )
        for i, (v, built) in enumerate(found, 1)
    ]
    out = read[0]
    for r in read[1:]:
        out = out.unionByName(r)
    return out


@query(
    """WITH f AS (SELECT user_id AS item_key, 'failure ' || event_id AS error, epoch_us(ts) / 1e6 AS ts, event_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error'),
    l AS (SELECT * FROM f WHERE n = 1), k AS (SELECT DISTINCT o_custkey AS item_key FROM orders)
    SELECT item_key, CASE WHEN item_key IN (FROM k) THEN 'interval failed on ' || event_id ELSE error END AS error,
      CASE WHEN item_key IN (FROM k) THEN 'fix-exhausted' ELSE 'sparse' END AS mode,
      CASE WHEN item_key IN (FROM k) THEN 2e9 ELSE round(ts, 3) END AS ts
    FROM l WHERE NOT (item_key IN (FROM k) AND event_id % 4 < 3)"""
)
def failure_repair(spark, folder):
    """The failure log after its items were tried again: half of them work one way, a quarter another, some files are gone."""
    e = table(spark, folder, "events").where("event_type = 'error'")
    newest = F.max_by(F.struct("event_id", seconds(F.col("ts")).alias("ts")), F.struct("ts", "event_id")).alias("e")
    last = e.groupBy(F.col("user_id").alias("item_key")).agg(newest)
    path = F.concat(F.lit("/films/"), F.col("item_key").cast("string"))
    log = last.select(
        "item_key", F.col("e.event_id").cast("string").alias("item_id"), path.alias("path"),
        F.concat(F.lit("failure "), F.col("e.event_id")).alias("error"), F.lit("sparse").alias("mode"), F.lit("cuda").alias("hwaccel"),
        F.lit("raw").alias("pipeline"), F.lit("m").alias("model"), F.round("e.ts", 3).alias("ts"),
    )
    there = table(spark, folder, "orders").select(F.concat(F.lit("/films/"), F.col("o_custkey").cast("string")).alias("path"))

    def attempt(items: DataFrame, mode: str, hwaccel: str, pipeline: str) -> DataFrame:
        rest = F.col("item_id").cast("long") % 4
        ok = rest < 2 if mode == "sparse" else rest == 2
        return items.select("item_key", ok.alias("ok"), F.concat(F.lit(f"{mode} failed on "), "item_id").alias("error"))

    out = repair(written(log, "failures"), there, attempt, own_folder(spark, "repair"), 2e9)
    return out.log.select("item_key", "error", "mode", "ts")


@query(
    f"""WITH w AS (SELECT * FROM p ORDER BY {chance("vec_id", "pool")}, vec_id LIMIT 200)
    SELECT vec_id FROM w WHERE NOT EXISTS (
      SELECT 1 FROM v WHERE v.item_key = w.item_key AND round(v.t, 2) = round(w.t, 2))
    ORDER BY abs(score - (SELECT median(score) FROM w)), item_key, t, vec_id LIMIT 1""",
    "p v",
)
def uncertain_of_pool(spark, folder):
    """The least certain sample of a random pool, by likeness."""
    found = preference.next_uncertain(preferred(spark, folder), verdicts(spark, folder), 200, "pool", likeness="score")
    return found.select("vec_id")


@query(
    f"""WITH {CENTRES}, h AS (SELECT item_key, t, list_inner_product(vec, centre) AS score FROM s JOIN c USING (item_key)),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS n FROM h)
    SELECT item_key, r.t, round(list_inner_product(centre, query), 3) AS taste FROM r JOIN c USING (item_key), q WHERE n = 1""",
    "s q",
)
def map_taste(spark, folder):
    """The items of the map with the moment that stands for each, and how much their mean is liked."""
    s = samples(spark, folder)
    centres = entities.item_centroids(s, DIM)
    points = learning.cluster(learning.project(centres))
    asked = preference.centroid(liked(spark, folder), DIM)
    liking = lambda rows: search.scored(rows, asked, "p")
    records = learning.map_records(points, entities.representatives(s, centres), liking)
    return records.select("item_key", "t", "taste")


@query()
def map_layout(spark, folder):
    """The map by neighbours instead of main axes."""
    centres = entities.item_centroids(samples(spark, folder), DIM)
    return layout.layout(centres.select("item_key", "vec")).select("item_key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
