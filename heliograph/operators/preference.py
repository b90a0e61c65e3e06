"""Preferences: what was liked, and how samples compare to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import recency_weight, uncertainty, uniform
from ..functions.vectors import dot, mean_of, unit
from ..sources.scratch import written
from .metrics import quantiles
from .places import numbered
from .sampling import uniform_sample
from .search import asof, best_first, capped, scored, similarity


def keep_latest(verdicts: DataFrame, order: str = "seq") -> DataFrame:
    """One verdict for each (item_key, t to hundredths, profile): the last."""
    w = W.partitionBy("item_key", F.round("t", 2), "profile").orderBy(F.desc(order))
    return verdicts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("profile").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def delete_recent(verdicts: DataFrame, now: float, minutes: float | None, profile: str, ts: str = "ts") -> DataFrame:
    """Verdicts without a profile's last minutes, or without the whole profile."""
    gone = F.col("profile") == profile
    if minutes is not None:
        gone &= F.col(ts) >= now - 60 * minutes
    return verdicts.where(~gone)


def training_set(verdicts: DataFrame, samples: DataFrame) -> DataFrame:
    """Each verdict with its item's nearest sample; items without samples drop."""
    points = verdicts.select(F.col("seq").alias("point_id"), "item_key", F.col("t").alias("at"), "label")
    near = asof(points.drop("label"), samples)
    return near.join(points.select("point_id", "label"), "point_id")


def loved_sources(markers: DataFrame, verdicts: DataFrame, samples: DataFrame) -> DataFrame:
    """(seq, item_key, at, vec...): markers, then positive verdicts, each at its nearest sample, once per (item, tenth of a second)."""
    marked = markers.select(F.lit(0).alias("part"), F.col("marker_id").alias("id"), "item_key", F.col("start").alias("at"))
    liked = verdicts.where("label = 1").select(F.lit(1).alias("part"), F.col("seq").alias("id"), "item_key", F.col("t").alias("at"))
    both = marked.unionByName(liked)
    once = W.partitionBy("item_key", F.round("at", 1)).orderBy("part", "id")
    both = both.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("point_id", F.concat_ws(":", "part", "id"))
    near = asof(both.select("point_id", "item_key", "at"), samples)
    return near.join(both.select("point_id", "part", "id"), "point_id")


def recent(sources: DataFrame, n: int) -> DataFrame:
    """The last ``n`` in the order of sources, markers first."""
    return sources.orderBy(F.desc("part"), F.desc("id")).limit(n)


def centroid(sources: DataFrame, dim: int, into: str = "query") -> DataFrame:
    mean = sources.agg(mean_of(F.col("vec"), dim).alias("_m"))
    return mean.select(unit(F.col("_m")).alias(into))


def mode_scores(samples: DataFrame, sources: DataFrame, most: int = 24, dim: int = 64) -> DataFrame:
    """Largest cosine to the modes of what was liked: each source itself if there are at most ``most``, else k-means centres."""
    if sources.limit(most + 1).count() <= most:
        modes = sources.select(unit(F.col("vec")).alias("vec"))
    else:
        from .learning import kmeans_centres

        modes = kmeans_centres(sources, most)
    return similarity(samples, modes, "max")


def universe(scores: DataFrame, per_item: int) -> DataFrame:
    """The best samples of each item."""
    return capped(scores, "item_key", per_item)


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 over a candidate pool, best first: a global order, kept for pools of bounded size."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*best_first())) - 1)


def ranked_widely(rows: DataFrame, score: str = "score") -> DataFrame:
    """As ``ranked`` for any number of rows."""
    placed = numbered(rows, *best_first(score), into="rank")
    return placed.withColumn("rank", F.col("rank") - 1)


def next_batch(rows: DataFrame, seen: DataFrame, count: int, key: str = "item_key") -> DataFrame:
    """The next ``count`` rows of a feed that does not repeat: unseen items best first, and from the front again when they run out.

    Adds ``again``, whether the item was seen before.
    """
    shown = seen.select(key).distinct().withColumn("again", F.lit(True))
    marked = rows.join(shown, key, "left").withColumn("again", F.coalesce("again", F.lit(False)))
    return marked.orderBy("again", *best_first()).limit(count)


def unseen(rows: DataFrame, seen: DataFrame, key: str = "item_key") -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def rerank(rows: DataFrame, preference: str, relevance: str, weight: float = 0.2) -> DataFrame:
    """(1 - weight) * preference + weight * relevance scaled to 0..1 over the result set (1 where it has no span)."""
    ends = rows.agg(F.min(relevance).alias("_lo"), F.max(relevance).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(relevance) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return rows.crossJoin(F.broadcast(ends)).withColumn("blend", (1 - weight) * F.col(preference) + weight * scaled).drop("_lo", "_hi")


def diversify(pool: DataFrame, k: int, diversity: float, key: str = "vec_id") -> DataFrame:
    """(key, place): maximal marginal relevance over a ranked pool (key, rank, vec); relevance falls linearly with rank.

    Picks depend on all before them, so the pool goes through one task; it is bounded by the caller. With at
    most ``k`` rows, or no diversity, the order stays.
    """
    pool = pool.select(key, "rank", "vec")

    def run(_, rows):
        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by([("rank", "ascending"), (key, "ascending")])
        ids = rows.column(key).to_numpy()
        n = len(ids)
        if n <= k or diversity <= 0:
            chosen = list(range(min(n, k)))
        else:
            x = np.array(rows.column("vec").to_pylist(), float)
            relevance, near = np.linspace(1.0, 0.0, n), np.full(n, -np.inf)
            chosen, open_ = [0], np.ones(n, bool)
            open_[0] = False
            while len(chosen) < k:
                near = np.maximum(near, x @ x[chosen[-1]])
                value = np.where(open_, (1 - diversity) * relevance - diversity * near, -np.inf)
                chosen.append(int(value.argmax()))
                open_[chosen[-1]] = False
        return pa.table({key: ids[chosen], "place": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return pool.groupBy(F.lit(1).alias("_one")).applyInArrow(run, f"{key} long, place int")


def recommend(
    scores: DataFrame, k: int, seed: str, diversity: float, seen: DataFrame | None = None, floor: float | None = None,
    model: Callable[[DataFrame], DataFrame] | None = None, per_item: int = 2, liking: str = "liking",
) -> DataFrame:
    """(vec_id, place): a feed of ``k`` moments from rows with their likeness ``score`` to what was liked.

    The best max(6 k, 300) with at most ``per_item`` an item; seen items and scores below the floor go; a ``model`` that
    adds the column ``liking`` (a probability) reorders what is left; then the shuffle towards the front and the spread.
    """
    from .sampling import rank_weighted_shuffle

    pool = capped(scores, "item_key", per_item).orderBy(*best_first()).limit(max(6 * k, 300))
    pool = pool if seen is None else unseen(pool, seen)
    pool = pool if floor is None else pool.where(F.col("score") >= floor)
    if model is not None:
        pool = rerank(model(pool), liking, "score").withColumn("score", F.col("blend"))
    mixed = rank_weighted_shuffle(ranked(pool), "vec_id", k, seed)
    return diversify(mixed.withColumn("rank", F.col("place") - 1), k, diversity)


def least_certain(scores: DataFrame, labelled: DataFrame, p: str = "score", by_median: bool = False) -> DataFrame:
    """The unlabelled sample whose score is nearest to one half (a probability) or to the median.

    The median of an even number of scores lies as far from the one below as from the one above it, whatever the last digits
    of the differences are; the earlier item and time decides there. Scores are written, so that the median is of these.
    """
    done = labelled.select("item_key", F.round("t", 2).alias("_t")).distinct()
    fresh = scores.withColumn("_t", F.round("t", 2)).join(done, ["item_key", "_t"], "left_anti").drop("_t")
    if by_median:
        fresh = written(fresh, "fresh")
        middle = quantiles(fresh, p, [0.5]).select(F.col("value").alias("_mid"))
        apart = F.abs(F.col(p) - F.col("_mid"))
        fresh = fresh.crossJoin(F.broadcast(middle)).withColumn("certainty", F.round(apart, 14)).drop("_mid")
    else:
        fresh = fresh.withColumn("certainty", -uncertainty(F.col(p)))
    return fresh.orderBy("certainty", "item_key", "t").limit(1)


def next_uncertain(
    samples: DataFrame, labelled: DataFrame, pool: int = 800, seed: str = "", p: str | None = None, likeness: str | None = None,
) -> DataFrame:
    """The sample to label next: of ``pool`` samples drawn at random the least certain one that is not labelled.

    Certainty is the distance of the model's probability ``p`` from one half; without a model that of the ``likeness``
    from the pool's median; without either the draw decides. The draw is by hash of vec_id and seed, and needs no
    order of all samples.
    """
    drawn = uniform_sample(samples, "vec_id", pool, seed)
    if p is not None:
        drawn = drawn.withColumn("certainty", F.abs(F.col(p) - 0.5))
    elif likeness is not None:
        middle = drawn.agg(F.expr(f"percentile({likeness}, 0.5)").alias("_mid"))  # of a pool of bounded size
        drawn = drawn.crossJoin(F.broadcast(middle)).withColumn("certainty", F.abs(F.col(likeness) - F.col("_mid"))).drop("_mid")
    else:
        drawn = drawn.withColumn("certainty", uniform(F.col("vec_id"), seed + "cold"))
    done = labelled.select("item_key", F.round("t", 2).alias("_t")).distinct()
    fresh = drawn.withColumn("_t", F.round("t", 2)).join(done, ["item_key", "_t"], "left_anti").drop("_t")
    return fresh.orderBy("certainty", "item_key", "t", "vec_id").limit(1)


def weighted_by_age(verdicts: DataFrame, halflife_days: float, now: float, ts: str = "ts", floor: float = 0.05) -> DataFrame:
    """Adds ``weight``; null throughout if the half-life is not positive or no time is known."""
    if halflife_days <= 0:
        return verdicts.withColumn("weight", F.lit(None).cast("double"))
    known = verdicts.agg(F.min(F.when(F.col(ts) > 0, F.col(ts))).alias("_old"), F.greatest(F.max(F.when(F.col(ts) > 0, F.col(ts))), F.lit(float(now))).alias("_now"))
    return verdicts.crossJoin(F.broadcast(known)).withColumn("weight", F.when(F.col("_old").isNotNull(), recency_weight(F.col(ts), F.col("_now"), F.col("_old"), halflife_days, floor))).drop("_old", "_now")


def training_due(verdicts: DataFrame, since: str, every: int = 25) -> DataFrame:
    """One row a profile: whether ``every`` verdicts came since the last training and both classes are there."""
    return verdicts.groupBy("profile").agg(((F.count_if(F.col(since)) >= every) & (F.max("label") == 1) & (F.min("label") == 0)).alias("due"))


def preference_scores(samples: DataFrame, query: DataFrame) -> DataFrame:
    return scored(samples, query)


def cosine(a: str, b: str):
    return dot(unit(F.col(a)), unit(F.col(b)))
