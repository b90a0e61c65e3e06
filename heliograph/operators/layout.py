"""A map of items that keeps neighbours together: a weighted neighbour graph, laid out by attraction and repulsion.

An item's k nearest others by cosine get weights that fall from 1 at the nearest one, at a rate by which they sum to
log2(k); the two weights of a pair unite as chances do. Items start where the main axes put them. Then, in
``ROUNDS`` rounds, groups of items move side by side: a group knows its own edges with the places of their far
ends, and ``OTHERS`` items drawn from all, which push its items away; it takes ``STEPS`` steps, in which what is
outside stays where it is. A round is two joins of the edges with the places and one grouped pass. No task holds
more than a group, and the driver nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..sources.scratch import drop, written
from .learning import project, scaled_to_one
from .tiled import neighbours_tiled

NEIGHBOURS, ROUNDS, STEPS = 15, 12, 20
#: Items of a group; items that push the others away in a round.
GROUP, OTHERS = 20_000, 2_048
#: The curve 1 / (1 + A d^(2 B)) is near 1 up to a distance of 0.1 and then falls like exp(-d).
A, B = 1.577, 0.895
#: Width of the map at the start, and the furthest an item moves in a step.
WIDTH, REACH = 10.0, 1.0
#: Pushes for each pull.
PUSHES = 5
PLACED = "item_key long, x double, y double"
PLACES = pa.schema([("item_key", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])


def _rate(gaps: np.ndarray) -> np.ndarray:
    """Of each row of distances beyond the nearest one, the scale s by which exp(-gap / s) sums to log2 of their number."""
    target = math.log2(max(2, gaps.shape[1]))
    low, high = np.full(len(gaps), 1e-6), np.full(len(gaps), 1e3)
    for _ in range(64):
        middle = np.sqrt(low * high)
        over = np.exp(-gaps / middle[:, None]).sum(1) > target
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return high


def graph(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, w), each pair both ways, from (item_key long, vec of unit length)."""
    near = neighbours_tiled(points, k)
    lists = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "b", (1 - F.col("score")).alias("d")))).alias("n"))

    def weights(batches):
        for batch in batches:
            for a, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = np.array([[max(0.0, x["d"]) for x in n]])
                gaps = d - d[:, :1]
                w = np.exp(-gaps / _rate(gaps)[:, None])[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * len(n), pa.int64()), pa.array([x["b"] for x in n], pa.int64()), pa.array(w)], names=["a", "b", "w"]
                )

    one_way = lists.select("a", "n").mapInArrow(weights, "a long, b long, w double")
    pair = one_way.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = F.when(F.count(F.lit(1)) > 1, F.sum("w") - F.max("w") * F.min("w")).otherwise(F.sum("w"))
    edges = pair.agg(both.alias("w"))
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _moved(seed: int, round_: int):
    """The places of one group's items after some steps; rows are its edges, and the others as edges without a weight."""

    def move(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("a", "ascending"), ("b", "ascending")])
        get = lambda name: rows[name].to_numpy()
        pushes = np.isnan(get("w"))
        others = np.stack([get("bx"), get("by")], 1)[pushes]
        ids, first, own = np.unique(get("a")[~pushes], return_index=True, return_inverse=True)
        y = np.stack([get("ax"), get("ay")], 1)[~pushes][first]
        far, far_ids, w = np.stack([get("bx"), get("by")], 1)[~pushes], get("b")[~pushes], get("w")[~pushes]
        if not len(ids):
            return pa.table({"item_key": [], "x": [], "y": []}, schema=PLACES)
        # far ends that are in the group move with it
        at = np.minimum(np.searchsorted(ids, far_ids), len(ids) - 1)
        inside = ids[at] == far_ids
        rng = np.random.default_rng([seed, round_, int(ids[0]) & 0x7FFFFFFF])
        strength = np.bincount(own, w, len(ids))
        for step in range(STEPS):
            alpha = 1.0 - (round_ * STEPS + step) / (ROUNDS * STEPS)
            ends = np.where(inside[:, None], y[at], far)
            gap = y[own] - ends
            d2 = np.maximum((gap**2).sum(1), 1e-12)
            pull = -2.0 * A * B * d2 ** (B - 1.0) / (1.0 + A * d2**B) * w
            force = np.stack([np.bincount(own, np.clip(pull * gap[:, i], -4, 4), len(ids)) for i in (0, 1)], 1)
            for _ in range(PUSHES):
                gap = y - others[rng.integers(len(others), size=len(ids))]
                d2 = (gap**2).sum(1)
                push = 2.0 * B / ((0.001 + d2) * (1.0 + A * d2**B)) * strength
                push[d2 == 0] = 0.0  # the item itself
                force += np.clip(push[:, None] * gap, -4, 4)
            length = np.linalg.norm(force, axis=1, keepdims=True)
            y = y + alpha * force * np.minimum(0.1, REACH / np.maximum(length, 1e-12))
        return pa.table([ids, y[:, 0], y[:, 1]], schema=PLACES)

    return move


def layout(points: DataFrame, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """``points`` (item_key long, vec, ...) with x and y in 0..1. With fewer than three points, as ``project`` does it.

    One seed gives one map, up to the last digits of sums.
    """
    n = points.count()
    if n < 3:
        return project(points)
    vectors = written(points.select("item_key", "vec"), "layout-points")
    edges = written(graph(vectors, min(k, n - 1)), "layout-edges")
    groups = -(-n // GROUP)
    start = project(vectors)
    places = written(start.select("item_key", ((F.col("x") - 0.5) * WIDTH).alias("x"), ((F.col("y") - 0.5) * WIDTH).alias("y")), "layout-places")
    at_a = [F.col("item_key").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")]
    at_b = [F.col("item_key").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")]
    for round_ in range(ROUNDS):
        placed = edges.join(places.select(*at_a), "a").join(places.select(*at_b), "b")
        group = F.pmod(F.xxhash64("a", F.lit(seed + round_)), F.lit(groups)).cast("int")
        placed = placed.select(group.alias("g"), "a", "ax", "ay", "b", "bx", "by", "w")
        drawn = places.orderBy(uniform(F.col("item_key"), f"layout-{seed}-{round_}"), "item_key").limit(OTHERS)
        nan, none = F.lit(float("nan")), F.lit(-1).cast("long")
        drawn = drawn.select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), none.alias("a"), nan.alias("ax"), nan.alias("ay"), *at_b, nan.alias("w")
        )
        moved = placed.unionByName(drawn).groupBy("g").applyInArrow(_drop_group(_moved(seed, round_)), PLACED)
        before, places = places, written(moved, "layout-places")
        drop(before)
    out = points.join(scaled_to_one(places, "x", "y"), "item_key")
    return out


def _drop_group(move):
    def run(rows: pa.Table) -> pa.Table:
        return move(rows.drop_columns(["g"]))

    return run
