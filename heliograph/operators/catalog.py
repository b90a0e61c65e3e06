"""Catalog upkeep: reconciliation, work lists, upserts, playlists, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip_end, title_score


def reconcile(cached: DataFrame, live: DataFrame, facts: Sequence[str] = ("path", "item_id")) -> DataFrame:
    """(item_key, status): cached, moved (a fact changed), orphaned (not live) or new (not cached)."""
    a = cached.select("item_key", F.lit(True).alias("_c"), *[F.col(x).alias(f"c_{x}") for x in facts])
    b = live.select("item_key", F.lit(True).alias("_l"), *[F.col(x).alias(f"l_{x}") for x in facts])
    changed = F.lit(False)
    for x in facts:
        changed = changed | ~F.col(f"c_{x}").eqNullSafe(F.col(f"l_{x}"))
    status = F.when(F.col("_l").isNull(), "orphaned").when(F.col("_c").isNull(), "new").when(changed, "moved").otherwise("cached")
    return a.join(b, "item_key", "full_outer").select("item_key", status.alias("status"))


def prune(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Cached rows that are live; an empty catalog beside a filled cache is taken for a failure."""
    if live.isEmpty() and not cached.isEmpty():
        raise ValueError("the catalog is empty, the cache is not")
    return cached.join(live.select("item_key").distinct(), "item_key", "left_semi")


def todo(wanted: DataFrame, cached: DataFrame, keys: Sequence[str] = ("item_key", "model", "signature")) -> DataFrame:
    """Wanted rows that are not cached under the same keys."""
    return wanted.join(cached.select(*keys).distinct(), list(keys), "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str = "ts") -> DataFrame:
    """The latest row of each key; of equally late ones the change."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def record_failures(log: DataFrame, failed: DataFrame) -> DataFrame:
    """The failure log with new failures, one a key, messages cut to 500 characters."""
    return upsert(log, failed.withColumn("error", F.left("error", F.lit(500))), ["item_key"])


def resolve_failures(log: DataFrame, done: DataFrame) -> DataFrame:
    return log.join(done.select("item_key"), "item_key", "left_anti")


def update_items(items: DataFrame, updates: DataFrame, editable: Sequence[str], key: str = "item_id") -> DataFrame:
    """Items with the non-null editable values of their update."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in editable])
    joined = items.join(u, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in editable else F.col(c) for c in items.columns])


def bump(items: DataFrame, deltas: DataFrame, column: str, key: str = "item_id") -> DataFrame:
    """A counter after summed changes, never below 0."""
    d = deltas.groupBy(key).agg(F.sum("delta").alias("_d"))
    return items.join(d, key, "left").withColumn(column, F.greatest(F.coalesce(column, F.lit(0)) + F.coalesce("_d", F.lit(0)), F.lit(0))).drop("_d")


def add_tags(items: DataFrame, additions: DataFrame, key: str = "item_id") -> DataFrame:
    """Tags (arrays) united with new ones; none is lost."""
    new = additions.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("_new"))
    return items.join(new, key, "left").withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def remove(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def create(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows and new ones; a new row whose key is there already is left out, columns that it lacks are null."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def ensure_tags(tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """(tag_id, name, created) of each name: the smallest id it has, or the next free one in the order of the list.

    The list is the caller's; names are told apart exactly, empty ones are left out.
    """
    wanted = list(dict.fromkeys(n for n in names if n))
    asked = tags.sparkSession.createDataFrame(list(enumerate(wanted)), "place int, name string")
    found = tags.where(F.col("name").isin(wanted)).groupBy("name").agg(F.min("tag_id").cast("long").alias("_id"))
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).cast("long").alias("_last"))
    both = asked.join(F.broadcast(found), "name", "left").crossJoin(F.broadcast(last))
    nth = F.count_if(F.col("_id").isNull()).over(W.orderBy("place"))
    return both.select(F.coalesce("_id", F.col("_last") + nth).alias("tag_id"), "name", F.col("_id").isNull().alias("created"))


def lookup(rows: DataFrame, key: str, value: str, order: str, last: bool = False) -> DataFrame:
    """(key, value): of rows with one key the value of the first in an order, or of the last; null orders lose."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key).agg(pick(value, order).alias(value))


def playlist(markers: DataFrame, tags: Sequence[str], tag: str = "tag", default: float = 20.0, limit: int | None = None) -> DataFrame:
    """Clips (marker_id, item_key, start, end, duration, title, score) of markers with any of the tags, once each, by first tag.

    Markers without an item are skipped.
    """
    order = F.coalesce(*[F.when(F.col(tag) == t, F.lit(i)) for i, t in enumerate(tags)])
    rows = markers.where(F.col(tag).isin(*tags) & F.col("item_key").isNotNull()).withColumn("_o", order)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("marker_id").orderBy("_o"))).where("_n = 1")
    end = clip_end(F.col("start"), F.col("end"), default)
    rows = rows.withColumn("end", end).withColumn("duration", end - F.col("start")).withColumn("score", title_score(F.col("title")))
    if limit is not None:
        rows = rows.orderBy("_o", "item_key", "marker_id").limit(limit)
    return rows.select("marker_id", "item_key", "start", "end", "duration", "title", "score")


def near_marker(markers: DataFrame, at: DataFrame, tolerance: float) -> DataFrame:
    """The marker nearest to each point (point_id, item_key, at) within a tolerance; of equally near ones the last."""
    # time is cut into stretches of the tolerance: a point meets those around it, however many markers its item has
    width = tolerance if tolerance > 0 else 1.0
    stretch = F.floor(F.col("at") / width)
    asked = at.where("at IS NOT NULL").withColumn("_b", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    met = asked.join(markers.withColumn("_b", F.floor(F.col("start") / width)), ["item_key", "_b"])
    met = met.withColumn("_d", F.abs(F.col("start") - F.col("at"))).where(F.col("_d") <= tolerance)
    best = F.max_by(F.col("marker_id"), F.struct(-F.col("_d"), F.col("start"), F.col("marker_id")))
    return met.groupBy("point_id").agg(best.alias("marker_id"), F.min("_d").alias("distance"))


def library_stats(items: DataFrame) -> DataFrame:
    """One row from (duration, markers): items, hours, markers, items without a duration."""
    return items.agg(F.count(F.lit(1)).alias("items"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600, 4).alias("hours"), F.coalesce(F.sum("markers"), F.lit(0)).alias("markers"), F.count_if(F.col("duration").isNull()).alias("without_duration"))


def edit_list(moments: DataFrame, limit: int = 200, default: float = 15.0) -> DataFrame:
    """The plan of a reel: the best ``limit`` moments as (place, item_key, start, end)."""
    top = moments.orderBy(F.col("score").desc_nulls_last(), "item_key", "start").limit(limit)
    place = F.row_number().over(W.orderBy(F.col("score").desc_nulls_last(), "item_key", "start"))
    return top.select(place.alias("place"), "item_key", "start", clip_end(F.col("start"), F.col("end"), default).alias("end"), "score")


def retry_ladder(failures: DataFrame, attempts: Sequence[tuple[str, str]]) -> DataFrame:
    """Failed items with each further (mode, pipeline) to try, in order: those after the one that failed."""
    place = F.coalesce(*[F.when((F.col("mode") == m) & (F.col("pipeline") == p), F.lit(i)) for i, (m, p) in enumerate(attempts)], F.lit(-1))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(m).alias("mode"), F.lit(p).alias("pipeline")) for i, (m, p) in enumerate(attempts)])
    return failures.select("item_key", place.alias("_at"), F.explode(steps).alias("s")).where("s.step > _at").select("item_key", "s.step", "s.mode", "s.pipeline")
