"""Score series, segments and marker queries over the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, segments
from ..sources.tables import markers, samples, series
from .registry import query

HIGH, LOW, WINDOW, GAP, LEAST, LONGEST, PAD = 0.5, 0.0, 4, 7200.0, 3600.0, 20000.0, 1800.0

Z = """z AS (SELECT *, CASE WHEN stddev_pop(score) OVER (PARTITION BY item_key) < 1e-8 THEN 0.0
    ELSE (score - avg(score) OVER (PARTITION BY item_key)) / stddev_pop(score) OVER (PARTITION BY item_key) END AS z
    FROM e)"""


def smoothed_sql(window: int) -> str:
    return f"""i AS (SELECT item_key, t, event_id, z, row_number() OVER (PARTITION BY item_key ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY item_key) AS n FROM z),
    k AS (SELECT i.*, least({window}, n) AS w FROM i),
    j AS (SELECT k.item_key, k.t, k.event_id, k.i, k.n, k.w, k.i - k.w // 2 + r.o AS j FROM k, range(0, {window}) r(o) WHERE r.o < k.w),
    f AS (SELECT item_key, t, event_id, w, CASE WHEN j < 0 THEN -j WHEN j > n - 1 THEN 2 * (n - 1) - j ELSE j END AS j FROM j),
    sm AS (SELECT f.item_key, f.t, f.event_id, sum(i.z) / any_value(f.w) AS x FROM f JOIN i ON i.item_key = f.item_key AND i.i = f.j GROUP BY 1, 2, 3)"""


def runs_sql(high: float, low: float) -> str:
    return f"""a AS (SELECT *, coalesce(last_value(CASE WHEN isnan(x) THEN NULL WHEN x >= {high} THEN 1 WHEN x < {low} THEN 0 END IGNORE NULLS) OVER (PARTITION BY item_key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS act FROM sm),
    g AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY t, event_id) - row_number() OVER (PARTITION BY item_key, act ORDER BY t, event_id) AS isl FROM a),
    runs AS (SELECT item_key, min(t) AS s, max(t) AS e, max(x) AS pk, avg(x) AS mn, count(*) AS n FROM g WHERE act = 1 GROUP BY item_key, isl)"""


def merged_sql(source: str, name: str, gap: float) -> str:
    return f"""{name}1 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY item_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS nw FROM {source}),
    {name}2 AS (SELECT *, sum(nw) OVER (PARTITION BY item_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gr FROM {name}1),
    {name}3 AS (SELECT item_key, list_reduce(list({{'s': s, 'e': e, 'pk': pk, 'mn': mn}} ORDER BY s, e), lambda a, b: {{'s': a.s, 'e': greatest(a.e, b.e), 'pk': greatest(a.pk, b.pk), 'mn': CASE WHEN a.e - a.s + b.e - b.s > 0 THEN (a.mn * (a.e - a.s) + b.mn * (b.e - b.s)) / (a.e - a.s + b.e - b.s) ELSE (a.mn + b.mn) / 2 END}}) AS r FROM {name}2 GROUP BY item_key, gr),
    {name} AS (SELECT item_key, r.s AS s, r.e AS e, r.pk AS pk, r.mn AS mn FROM {name}3)"""


SMOOTH = f"WITH {Z}, {smoothed_sql(WINDOW)}"
RUNS = f"{SMOOTH}, {runs_sql(HIGH, LOW)}"
MERGED = f"{RUNS}, {merged_sql('runs', 'mg', GAP)}, kept AS (SELECT * FROM mg WHERE e - s >= {LEAST})"
SPLIT = f"""{MERGED}, cut AS (SELECT item_key, s + k * {LONGEST} AS s, least(s + (k + 1) * {LONGEST}, e) AS e, pk, mn
    FROM (SELECT kept.*, unnest(range(0, greatest(ceil((e - s) / {LONGEST})::BIGINT, 1))) AS k FROM kept))"""


def padded_sql(source: str) -> str:
    return f"lim AS (SELECT item_key, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), wide AS (SELECT c.item_key, greatest(c.s - {PAD}, lo) AS s, least(c.e + {PAD}, hi) AS e, pk, mn FROM {source} c JOIN lim USING (item_key)), {merged_sql('wide', 'pd', 0.0)}"


def out_sql(source: str) -> str:
    return f"SELECT item_key, round(s, 3) AS start, round(e, 3) AS \"end\", round(pk, 4) AS peak, round(mn, 4) AS mean FROM {source}"


def shown(segs):
    return segs.select("item_key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("peak", 4).alias("peak"), F.round("mean", 4).alias("mean"))


def prepared(spark, folder):
    return segments.smooth(segments.zscore(series(spark, folder)), WINDOW, "z", "x")


@query(f"WITH {Z} SELECT event_id, item_key, round(z, 4) AS z FROM z", "e")
def score_zscore(spark, folder):
    return segments.zscore(series(spark, folder)).select("event_id", "item_key", F.round("z", 4).alias("z"))


@query(f"{SMOOTH} SELECT event_id, item_key, round(x, 4) AS smooth FROM sm", "e")
def score_smooth(spark, folder):
    return prepared(spark, folder).select("event_id", "item_key", F.round("x", 4).alias("smooth"))


@query(f"""{RUNS} SELECT item_key, round(s, 3) AS start, round(e, 3) AS \"end\", round(pk, 4) AS peak, round(mn, 4) AS
    mean, n FROM runs""", "e")
def hysteresis_runs(spark, folder):
    found = segments.runs(segments.hysteresis(prepared(spark, folder), HIGH, LOW, "x"), "x")
    return found.select("item_key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("peak", 4).alias("peak"), F.round("mean", 4).alias("mean"), "n")


@query(f"{MERGED} {out_sql('kept')}", "e")
def segments_merged(spark, folder):
    return shown(segments.extract(prepared(spark, folder), HIGH, LOW, LEAST, GAP, value="x"))


@query(f"{SPLIT} {out_sql('cut')}", "e")
def segments_split(spark, folder):
    return shown(segments.extract(prepared(spark, folder), HIGH, LOW, LEAST, GAP, LONGEST, value="x"))


@query(f"{MERGED}, {padded_sql('kept')} {out_sql('pd')}", "e")
def segments_padded(spark, folder):
    return shown(segments.extract(prepared(spark, folder), HIGH, LOW, LEAST, GAP, padding=PAD, value="x"))


@query(f"""{SPLIT}, {padded_sql('cut')} SELECT item_key, round(s, 3) AS start, round(e, 3) AS \"end\", round(pk, 4) AS
    peak, round(mn, 4) AS mean, round(e - s, 3) AS duration, round((s + e) / 2, 3) AS midpoint FROM pd""", "e")
def segments_full(spark, folder):
    full = segments.extract(prepared(spark, folder), HIGH, LOW, LEAST, GAP, LONGEST, PAD, "x")
    return full.select("item_key", *[F.round(c, 3).alias(c) for c in ("start", "end", "duration", "midpoint")], F.round("peak", 4).alias("peak"), F.round("mean", 4).alias("mean"))


REF = """WITH sc AS (SELECT a.item_key, a.t, max(list_inner_product(a.vec, b.vec)) AS score FROM s a, s b
    WHERE b.vec_id < 12 GROUP BY 1, 2), e AS (SELECT item_key, t, (t / 8)::BIGINT AS event_id, score FROM sc)"""


@query(f"""{REF}, {Z}, sm AS (SELECT item_key, t, event_id, z AS x
    FROM z), {runs_sql(1.0, 0.2)}, {merged_sql('runs', 'mg', 8.0)} {out_sql('mg')}""", "s")
def segments_from_references(spark, folder):
    from ..operators.search import similarity

    s = samples(spark, folder)
    scores = similarity(s, s.where("vec_id < 12")).withColumn("event_id", (F.col("t") / 8).cast("long"))
    return shown(segments.extract(segments.zscore(scores), 1.0, 0.2, 0.0, 8.0, value="z"))


@query(f"""{MERGED} {out_sql('kept')} k WHERE NOT EXISTS (SELECT 1 FROM m
    WHERE m.item_key = k.item_key AND k.s <= coalesce(m.stop, m.start) AND k.e >= m.start)""", "e m")
def marker_overlap_anti(spark, folder):
    segs = segments.extract(prepared(spark, folder), HIGH, LOW, LEAST, GAP, value="x")
    return shown(segments.without_existing(segs, markers(spark, folder)))


@query("""SELECT marker_id, item_key, round(start, 3) AS start, round(CASE
    WHEN stop IS NULL OR stop <= start THEN start + 20
    ELSE stop END, 3) AS \"end\", title, try_cast(regexp_extract(title, '^(.*) ([^ ]*)$', 2) AS DOUBLE) AS score
    FROM m""", "m")
def marker_title_score(spark, folder):
    p = catalog.playlist(markers(spark, folder).withColumn("tag", F.lit("purchase")), ["purchase"])
    return p.select("marker_id", "item_key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "title", "score")


@query("""WITH x AS (SELECT event_id AS marker_id, user_id AS item_key, epoch_us(ts) / 1e6 AS start, event_type AS tag
    FROM events UNION ALL SELECT event_id, user_id, epoch_us(ts) / 1e6, 'click' FROM events
    WHERE event_type = 'purchase' AND event_id % 3 = 0), o AS (SELECT *, CASE tag WHEN 'click' THEN 0
    WHEN 'purchase' THEN 1 END AS o FROM x WHERE tag IN ('click', 'purchase')),
    u AS (SELECT *, row_number() OVER (PARTITION BY marker_id ORDER BY o) AS n FROM o)
    SELECT marker_id, item_key, round(start, 3) AS start, round(start + 20, 3) AS \"end\" FROM u WHERE n = 1""")
def playlist_multi_tag(spark, folder):
    from ..sources.tables import seconds, table

    e = table(spark, folder, "events")
    base = e.select(F.col("event_id").alias("marker_id"), F.col("user_id").alias("item_key"), seconds(F.col("ts")).alias("start"), F.lit(None).cast("double").alias("end"), F.col("event_type").alias("tag"), F.lit("").alias("title"))
    more = base.where("tag = 'purchase' and marker_id % 3 = 0").withColumn("tag", F.lit("click"))
    p = catalog.playlist(base.unionByName(more), ["click", "purchase"])
    return p.select("marker_id", "item_key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("""WITH c AS (SELECT a.event_id AS point_id, m.marker_id, abs(m.start - epoch_us(a.ts) / 1e6) AS d, m.start
    FROM events a JOIN m ON m.item_key = a.user_id WHERE a.event_type = 'click'),
    r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, start DESC, marker_id DESC) AS n FROM c
    WHERE d <= 5400) SELECT point_id, marker_id, round(d, 3) AS distance FROM r WHERE n = 1""", "m")
def near_marker(spark, folder):
    from ..sources.tables import seconds, table

    e = table(spark, folder, "events").where("event_type = 'click'")
    at = e.select(F.col("event_id").alias("point_id"), F.col("user_id").alias("item_key"), seconds(F.col("ts")).alias("at"))
    return catalog.near_marker(markers(spark, folder), at, 5400.0).select("point_id", "marker_id", F.round("distance", 3).alias("distance"))


@query("""SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, item_key, start)::INT AS place, item_key, round(start,
    3) AS start, round(CASE WHEN stop IS NULL OR stop <= start THEN start + 15 ELSE stop END, 3) AS \"end\", score
    FROM (SELECT *, try_cast(regexp_extract(title, '^(.*) ([^ ]*)$', 2) AS DOUBLE) AS score FROM m
    ORDER BY score DESC NULLS LAST, item_key, start LIMIT 200)""", "m")
def reel_edit_list(spark, folder):
    from ..functions.scalars import title_score

    m = markers(spark, folder).withColumn("score", title_score(F.col("title")))
    return catalog.edit_list(m).select("place", "item_key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "score")


ONLINE = f"""
WITH k AS (SELECT floor(max(epoch_us(ts)) / 1000) / 1000 - 3600 AS mark FROM events),
beyond AS (SELECT DISTINCT item_key FROM e, k WHERE t > mark),
sm AS (SELECT item_key, t, event_id, score AS x FROM e, k WHERE t <= mark),
{runs_sql(60.0, 30.0)},
ends AS (SELECT item_key, max(t) AS final FROM sm GROUP BY item_key)
SELECT item_key, round(runs.s, 3) AS start, round(runs.e, 3) AS "end", round(pk, 4) AS peak, round(mn, 4) AS mean, n FROM runs JOIN ends USING (item_key), k
WHERE runs.e < final OR (mark >= runs.e + 3600 AND item_key NOT IN (SELECT item_key FROM beyond))
"""


@query(ONLINE, "e")
def online_segments(spark, folder):
    """Hysteresis runs of the scores as a stream over the landed events, read once to the end: those closed when the watermark stops."""
    import uuid

    from ..sources.scratch import shared_folder
    from ..sources.tables import seconds, table
    from ..streaming.incremental import RUN, online_runs

    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*")
    ready = stream.select(F.col("user_id").alias("item_key"), F.col("ts").cast("timestamp").alias("ts"), seconds(F.col("ts")).alias("t"), F.col("value").alias("score"))
    base = f"{shared_folder(spark)}/online-{uuid.uuid4().hex}"
    writer = online_runs(ready, 60.0, 30.0).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(RUN).parquet(f"{base}/out")
    return found.select("item_key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("peak", 4).alias("peak"), F.round("mean", 4).alias("mean"), "n")
