"""The neighbour graph and the map laid out from it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import layout, learning
from heliograph.operators.tiled import neighbours_tiled


def points(spark, rows):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    frame = spark.createDataFrame([(3 * i, v.tolist(), "x") for i, v in enumerate(unit)], "item_key long, vec array<double>, sid string")
    return unit, frame.repartition(6)


@pytest.mark.parametrize("block", [13, 10_000])
def test_neighbours_like_a_loop(spark, block):
    unit, frame = points(spark, np.random.default_rng(1).normal(size=(70, 4)))
    got = {}
    for r in neighbours_tiled(frame, 5, block=block).collect():
        got.setdefault(r.a // 3, []).append((r.place, r.b // 3, r.score))
    for i in range(70):
        scores = unit @ unit[i]
        order = [j for j in np.argsort(-scores, kind="stable") if j != i][:5]
        found = sorted(got[i])
        assert [p for p, _, _ in found] == [1, 2, 3, 4, 5] and [j for _, j, _ in found] == order
        assert all(abs(s - scores[j]) < 1e-12 for _, j, s in found)
    few = neighbours_tiled(frame.where("item_key < 9"), 5, block=block).collect()
    assert len(few) == 6 and neighbours_tiled(frame.where("false"), 5).collect() == []


def test_weights_of_the_graph(spark):
    unit, frame = points(spark, np.random.default_rng(2).normal(size=(60, 5)))
    one_way = {}
    for i in range(60):
        d = np.sort(np.maximum(0, 1 - np.delete(unit @ unit[i], i)))[:8]
        low, high = 1e-6, 1e3
        for _ in range(200):
            s = (low + high) / 2
            low, high = (low, s) if np.exp(-(d - d[0]) / s).sum() > math.log2(8) else (s, high)
        order = [j for j in np.argsort(-(unit @ unit[i]), kind="stable") if j != i][:8]
        one_way |= {(i, j): math.exp(-(x - d[0]) / high) for j, x in zip(order, d, strict=True)}
    want = {}
    for (i, j), w in one_way.items():
        v = one_way.get((j, i))
        want[i, j] = want[j, i] = w if v is None else w + v - w * v
    got = {(r.a // 3, r.b // 3): r.w for r in layout.graph(frame, 8).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-6 for p in want)


def kept(unit, flat, k=10):
    """Share of each point's k nearest that are among its k nearest on the map."""
    near = np.argsort(-(unit @ unit.T) + 2 * np.eye(len(unit)), axis=1)[:, :k]
    d = ((flat[:, None] - flat[None]) ** 2).sum(2) + 1e9 * np.eye(len(flat))
    on_map = np.argsort(d, axis=1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near, on_map, strict=True)])


def test_neighbours_stay_together(spark, monkeypatch):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 24))
    turns = np.arange(30)[:, None] * 2 * np.pi / 30
    loops = [m + 1.2 * (np.sin(turns) * rng.normal(size=24) + np.cos(turns) * rng.normal(size=24)) for m in middles]
    unit, frame = points(spark, np.concatenate(loops) + 0.05 * rng.normal(size=(270, 24)))

    def flat(found):
        assert set(found.columns) == {"item_key", "vec", "sid", "x", "y"}
        at = {r.item_key // 3: (r.x, r.y) for r in found.collect()}
        return np.array([at[i] for i in range(len(unit))])

    plain = kept(unit, flat(learning.project(frame)))
    one = flat(layout.layout(frame))
    assert one.min() == 0 and one.max() == 1
    assert kept(unit, one) > max(0.7, 1.3 * plain), (kept(unit, one), plain)
    assert np.allclose(one, flat(layout.layout(frame)), atol=1e-6)
    monkeypatch.setattr(layout, "GROUP", 70)  # several groups, which see each other's places of the round before
    grouped = kept(unit, flat(layout.layout(frame, seed=7)))
    assert grouped > max(0.6, 1.2 * plain), (grouped, plain)


def test_small_maps(spark):
    _, frame = points(spark, np.random.default_rng(4).normal(size=(5, 3)))
    assert layout.layout(frame.where("item_key < 0")).collect() == []
    assert {(r.x, r.y) for r in layout.layout(frame.where("item_key < 6")).collect()} == {(0, 0), (1, 1)}
    assert layout.layout(frame.where("item_key < 9")).count() == 3
    same = frame.withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    assert all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in layout.layout(same).collect())


def test_records_of_the_map(spark):
    rows = spark.createDataFrame([(1, [1.0], 0.25, 0.12345678, 0), (2, [0.5], 1.0, 0.0, -1)], "item_key long, vec array<double>, x double, y double, c int")
    reps = spark.createDataFrame([(1, 8.004), (2, 16.0)], "item_key long, t double")
    plain = {tuple(r) for r in learning.map_records(rows, reps).collect()}
    assert plain == {(1, 8.0, 0.25, 0.1235, 0, 0.0), (2, 16.0, 1.0, 0.0, -1, 0.0)}
    liking = lambda df: df.withColumn("p", F.when(F.col("item_key") == 1, F.col("vec")[0] * 0.77777))
    assert {r.item_key: r.taste for r in learning.map_records(rows, reps, liking).collect()} == {1: 0.778, 2: 0.0}


def test_nearest_point_of_the_map(spark):
    rows = spark.createDataFrame([(3, 0.5, 0.5), (1, 0.1, 0.5), (2, 0.1, 0.5), (4, None, 0.0)], "item_key long, x double, y double")
    nearest = learning.nearest_on_map(rows, 0.2, 0.5).first()
    assert nearest.item_key == 1 and abs(nearest.distance - 0.1) < 1e-12
    assert learning.nearest_on_map(rows, 0.2, 0.5, within=0.05).collect() == []
