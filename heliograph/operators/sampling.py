"""Seeded sampling: a row's chance number depends on its key and the seed only, so results repeat on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import race, uniform


def uniform_sample(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """``count`` rows in random order; all of them, shuffled, if there are fewer."""
    return rows.withColumn("u", uniform(F.col(key), seed)).orderBy("u", key).limit(count)


def key_sample(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """All rows of ``count`` keys drawn without replacement."""
    drawn = uniform_sample(rows.select(key).distinct(), key, count, seed).select(key)
    return rows.join(F.broadcast(drawn), key, "left_semi")


def rank_weighted_sample(ranked: DataFrame, key: str, count: int, seed: str, rank: str = "rank", total: int | None = None) -> DataFrame:
    """Without replacement, in proportion to exp(-rank / T), T = max(n / 4, count, 200); unchanged if n <= count.

    ``rank`` starts at 0.
    """
    n = ranked.count() if total is None else total
    if n <= count:
        return ranked
    heat = float(max(n / 4, count, 200))
    drawn = ranked.withColumn("race", race(uniform(F.col(key), seed), F.exp(-F.col(rank) / F.lit(heat))))
    return drawn.orderBy("race", key).limit(count)


def diverse_board(ranked: DataFrame, count: int, diversity: float, seed: str, key: str = "vec_id") -> DataFrame:
    """(key, place): three times ``count`` moments drawn by rank, then ``count`` of them by maximal marginal relevance in the
    order drawn; without diversity, or from no more than ``count``, the draw alone."""
    from .preference import diversify

    n = ranked.count()
    if diversity <= 0 or n <= count:
        drawn = rank_weighted_sample(ranked, key, count, seed, total=n)
        order = "race" if n > count else "rank"
        return drawn.select(key, F.row_number().over(W.orderBy(order, key)).alias("place"))
    wide = min(n, 3 * count)
    drawn = rank_weighted_sample(ranked, key, wide, seed, total=n)
    order = W.orderBy("race" if n > wide else "rank", key)  # 3 * count rows at most
    return diversify(drawn.withColumn("rank", F.row_number().over(order) - 1), count, diversity, key)


def rank_weighted_shuffle(ranked: DataFrame, key: str, top_k: int, seed: str, rank: str = "rank") -> DataFrame:
    """Adds ``place`` (from 1): a full shuffle that favours the front, T = max(top_k, 20).

    Meant for a result list, which one task can order.
    """
    heat = float(max(top_k, 20))
    drawn = ranked.withColumn("race", race(uniform(F.col(key), seed), F.exp(-F.col(rank) / F.lit(heat))))
    return drawn.withColumn("place", F.row_number().over(W.orderBy("race", key)))


def score_weighted_shuffle(rows: DataFrame, key: str, seed: str, score: str = "score", floor: float = 0.05) -> DataFrame:
    """Adds ``draw`` = u ** (1 / max(score, floor)); descending order is the shuffle."""
    return rows.withColumn("draw", F.pow(uniform(F.col(key), seed), 1 / F.greatest(F.col(score), F.lit(floor))))


def roulette(entities: DataFrame, key: str, seed: str, least: int = 20) -> DataFrame:
    """One entity in proportion to max(.01, affinity or .1), of those with at least ``least`` moments if any have."""
    weight = F.greatest(F.lit(0.01), F.when(F.coalesce("affinity", F.lit(0.0)) == 0, 0.1).otherwise(F.col("affinity")))
    enough = entities.agg(F.max(F.col("moments") >= least).alias("any_enough"))
    pool = entities.crossJoin(F.broadcast(enough)).where(~F.col("any_enough") | (F.col("moments") >= least))
    return pool.withColumn("race", race(uniform(F.col(key), seed), weight)).orderBy("race", key).limit(1)


SLOTS = 256


def weighted_bootstrap(rows: DataFrame, key: str, weight: str, draws: int, seed: str, by: str) -> DataFrame:
    """``draws`` rows of each class with replacement, in proportion to weight, with ``draw`` from 1.

    A class is in SLOTS parts by hash of the key. A draw falls into one by the parts' weights, and there to the last row
    that begins before it in their running sum, which rows and draws pass in one order.
    """
    slot = F.floor(uniform(F.col(key), f"{seed}:slot") * SLOTS).cast("int")
    kept = rows.select(by, slot.alias("_slot"), F.col(key).alias("_key"), F.col(weight).cast("double").alias("_w"), F.struct(*rows.columns).alias("_row"))
    parts = kept.groupBy(by, "_slot").agg(F.sum("_w").alias("_mass"))
    along = W.partitionBy(by).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("_from", F.sum("_mass").over(along) - F.col("_mass")).withColumn("_all", F.sum("_mass").over(W.partitionBy(by)))
    picks = parts.select(by, "_all").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.select(by, "draw", (uniform(F.concat_ws(":", by, "draw"), seed) * F.col("_all")).alias("_u"))
    fallen = picks.join(F.broadcast(parts.select(by, "_slot", "_from", "_mass")), by).where("_u >= _from and _u < _from + _mass")  # SLOTS rows a class
    within = W.partitionBy(by, "_slot").orderBy("_key").rowsBetween(W.unboundedPreceding, 0)
    begins = kept.withColumn("_hi", F.sum("_w").over(within)).select(by, "_slot", (F.col("_hi") - F.col("_w")).alias("_at"), F.lit(0).alias("_kind"), "_hi", F.lit(None).cast("int").alias("draw"), "_row")
    nothing = F.lit(None).cast(begins.schema["_row"].dataType).alias("_row")
    marks = fallen.select(by, "_slot", (F.col("_u") - F.col("_from")).alias("_at"), F.lit(1).alias("_kind"), F.lit(0.0).alias("_hi"), "draw", nothing)
    passed = W.partitionBy(by, "_slot").orderBy("_at", "_kind", "_hi").rowsBetween(W.unboundedPreceding, 0)
    drawn = begins.unionByName(marks).withColumn("_row", F.last("_row", ignorenulls=True).over(passed)).where("_kind = 1")
    return drawn.select("_row.*", "draw")


def top_and_random(scored: DataFrame, labelled: DataFrame, top: int, random: int, limit: int, seed: str, key: str = "vec_id") -> DataFrame:
    """(columns, source): each item's best ``top`` and ``random`` others, labelled ones gone without replacement, in a shared budget.

    Labelled rows are (item_key, t). The random part gets round(limit * random / (top + random)) rows at least one, if it has them.
    """
    by_item = W.partitionBy("item_key")
    ranked = scored.withColumn("_rank", F.row_number().over(by_item.orderBy(F.desc("score"), "t")))
    done = labelled.select("item_key", F.round("t", 2).alias("_t")).distinct()
    fresh = ranked.withColumn("_t", F.round("t", 2)).join(done, ["item_key", "_t"], "left_anti")
    best = fresh.where(F.col("_rank") <= top)
    others = fresh.where(F.col("_rank") > top).withColumn("_u", uniform(F.col(key), seed))
    others = others.withColumn("_pick", F.row_number().over(by_item.orderBy("_u", key))).where(F.col("_pick") <= random)
    share = max(1, math.floor(limit * random / (top + random) + 0.5)) if random else 0
    n_random = others.limit(share).count()
    drop = ["_rank", "_t", "_u", "_pick"]
    part = others.orderBy("_u", key).limit(n_random).drop(*drop).withColumn("source", F.lit("random"))
    whole = best.orderBy(F.desc("score"), key).limit(limit - n_random).drop(*drop).withColumn("source", F.lit("top"))
    return whole.unionByName(part)


def time_spread(samples: DataFrame, per_item: int) -> DataFrame:
    """Every max(1, n // per_item)-th sample of each item, which may be up to twice ``per_item``."""
    by_item = W.partitionBy("item_key")
    placed = samples.withColumn("_i", F.row_number().over(by_item.orderBy("t")) - 1).withColumn("_n", F.count(F.lit(1)).over(by_item))
    return placed.where(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / per_item)) == 0).drop("_i", "_n")
