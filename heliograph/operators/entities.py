"""Entities (people, suppliers) that stand in a many-to-many relation (entity, item_key) to items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_of, sum_of, unit
from .metrics import histogram
from .sampling import time_spread, uniform_sample
from .search import best_first, capped, scored, top_terms


def item_centroids(samples: DataFrame, dim: int = 64) -> DataFrame:
    """(item_key, n, vec): unit mean of each item's samples."""
    mean = samples.groupBy("item_key").agg(mean_of(F.col("vec"), dim).alias("_m"), F.count(F.lit(1)).alias("n"))
    return mean.select("item_key", "n", unit(F.col("_m")).alias("vec"))


def representatives(samples: DataFrame, centroids: DataFrame) -> DataFrame:
    """(item_key, t, score): the sample most like its item's centroid, the earliest of equals."""
    met = samples.join(centroids.select("item_key", F.col("vec").alias("centre")), "item_key").withColumn("score", dot("vec", "centre"))
    rank = F.row_number().over(W.partitionBy("item_key").orderBy(F.desc("score"), "t"))
    return met.withColumn("_r", rank).where("_r = 1").select("item_key", "t", "score")


def centroids(bridge: DataFrame, samples: DataFrame, dim: int = 64) -> DataFrame:
    """(entity, moments, vec): unit sum over all samples of an entity's items; sums per item first, so only those meet the bridge."""
    per_item = samples.groupBy("item_key").agg(sum_of(F.col("vec"), dim).alias("vec"), F.count(F.lit(1)).alias("n"))
    total = bridge.join(per_item, "item_key").groupBy("entity").agg(sum_of(F.col("vec"), dim).alias("_s"), F.sum("n").alias("moments"))
    return total.select("entity", "moments", unit(F.col("_s")).alias("vec"))


def leaderboard(bridge: DataFrame, scores: DataFrame, details: DataFrame) -> DataFrame:
    """(entity, items, moments, best, affinity, counter, rating) over embedded items.

    ``scores`` is (item_key, t, score), ``details`` (item_key, counter, rating). best starts at 0, so it is never
    negative; affinity is the mean score of all samples; rating is the mean of known ones. A pair of the bridge counts
    once. All that is of an item is one row of it before it meets the bridge, so entities are plain sums of pairs.
    """
    per_item = scores.groupBy("item_key").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.sum("score").alias("total"))
    known = details.groupBy("item_key").agg(F.sum("counter").alias("counter"), F.sum("rating").alias("rated"), F.count("rating").alias("ratings"))
    rows = bridge.select("entity", "item_key").distinct().join(per_item.join(known, "item_key", "left"), "item_key")
    return rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n").alias("moments"), F.greatest(F.lit(0.0), F.max("best")).alias("best"),
        (F.sum("total") / F.sum("n")).alias("affinity"), F.coalesce(F.sum("counter"), F.lit(0)).alias("counter"),
        F.try_divide(F.sum("rated"), F.sum("ratings")).alias("rating"),
    )


def ordered(board: DataFrame, key: str) -> DataFrame:
    """By one measure, largest first, null as 0."""
    return board.orderBy(F.coalesce(key, F.lit(0)).desc(), "entity")


def best_moments(bridge: DataFrame, scores: DataFrame, k: int = 6) -> DataFrame:
    """(entity, item_key, t, score, rank): each entity's top items by their best sample."""
    per_item = scores.groupBy("item_key").agg(F.max_by(F.struct("score", "t"), F.struct(F.col("score"), -F.col("t"))).alias("b")).select("item_key", F.col("b.score").alias("score"), F.col("b.t").alias("t"))
    rank = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("score"), "item_key"))
    return bridge.join(per_item, "item_key").withColumn("rank", rank).where(F.col("rank") <= k).select("entity", "item_key", "t", "score", "rank")


def similar(vectors: DataFrame, entity, k: int = 10) -> DataFrame:
    """The entities whose centroid is nearest to one entity's."""
    own = vectors.where(F.col("entity") == entity).select(F.col("vec").alias("query"))
    others = vectors.where(F.col("entity") != entity).crossJoin(F.broadcast(own))
    return others.select("entity", dot("vec", "query").alias("score")).orderBy(F.desc("score"), "entity").limit(k)


def fingerprint(vectors: DataFrame, vocabulary: DataFrame, k: int = 8) -> DataFrame:
    return top_terms(vectors, vocabulary, ["entity"], k)


def resolve(bridge: DataFrame, names: DataFrame, embedded: DataFrame, pattern: str, excluded: Sequence[str] = ()) -> DataFrame:
    """The one entity whose name (entity, name) fits a pattern with most embedded items; excluded names are compared trimmed, in lower case."""
    fit = names.where(F.col("name").rlike(pattern) & ~F.lower(F.trim("name")).isin(*[x.strip().lower() for x in excluded] or [""]))
    count = bridge.join(embedded.select("item_key").distinct(), "item_key", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("items"))
    return fit.join(count, "entity").orderBy(F.desc("items"), "entity").limit(1)


def moments_of(bridge: DataFrame, samples: DataFrame, entity) -> DataFrame:
    """Samples of an entity's items."""
    return samples.join(bridge.where(F.col("entity") == entity).select("item_key"), "item_key", "left_semi")


def hall_of_fame(board: DataFrame, moments: DataFrame, top: int, each: int = 1, seconds: float = 20.0) -> DataFrame:
    """Clips of the best moments of the entities with most affinity."""
    chosen = board.orderBy(F.desc("affinity"), "entity").limit(top).select("entity", "affinity")
    return moments.where(F.col("rank") <= each).join(chosen, "entity").select("entity", "affinity", "item_key", F.col("t").alias("start"), (F.col("t") + seconds).alias("end"), F.lit(seconds).alias("duration"), "score")


def best_of(scores: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    rows = scores if floor is None else scores.where(F.col("score") >= floor)
    return rows.orderBy(*best_first()).limit(k)


def moment_matches(bridge: DataFrame, samples: DataFrame, entity, query: DataFrame, count: int = 300, per_item: int = 6) -> DataFrame:
    """Samples of an entity's items most like the one row of ``query``."""
    hits = capped(scored(moments_of(bridge, samples, entity), query), "item_key", per_item)
    return hits.orderBy(*best_first()).limit(count)


def board(bridge: DataFrame, samples: DataFrame, entity, count: int, per_item: int, seed: str, key: str = "vec_id") -> DataFrame:
    """``count`` samples of an entity's items, spread over time, in random order."""
    return uniform_sample(time_spread(moments_of(bridge, samples, entity), per_item), key, count, seed)


def detail(bridge: DataFrame, names: DataFrame, scores: DataFrame, details: DataFrame, samples: DataFrame, vocabulary: DataFrame, entity, dim: int = 64) -> dict[str, DataFrame]:
    """Everything about one entity: its leaderboard row with name, best moments, distribution, fingerprint, similar entities."""
    own = bridge.where(F.col("entity") == entity)
    vectors = centroids(bridge, samples, dim)
    return {
        "stats": leaderboard(own, scores, details).join(names, "entity", "left"), "best": best_moments(own, scores),
        "distribution": histogram(moments_of(bridge, scores, entity), 20), "fingerprint": fingerprint(vectors.where(F.col("entity") == entity), vocabulary),
        "similar": similar(vectors, entity),
    }


def named_like(names: DataFrame, part: str) -> DataFrame:
    """(entity, name) whose name holds a text, whatever the case."""
    return names.where(F.contains(F.lower("name"), F.lit(part.strip().lower())))


def compared(board: DataFrame, one, other) -> DataFrame:
    """(measure, one, other): two rows of a leaderboard side by side."""
    measures = [c for c in board.columns if c != "entity"]
    rows = [board.where(F.col("entity") == e).select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(side)) for m in measures])).alias("x")).select("x.*") for e, side in ((one, "one"), (other, "other"))]
    return rows[0].join(rows[1], "measure", "full_outer")
