"""Density clusters against a version that compares all points with each other."""

import numpy as np
import pytest

from heliograph.operators import density, learning


def parts(n, links):
    home = list(range(n))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in links:
        home[top(a)] = top(b)
    out = {}
    for i in range(n):
        out.setdefault(top(i), []).append(i)
    return [frozenset(p) for p in out.values()]


def plain(xy, m, k):
    """Components at every height, the condensed tree of the large ones, and the most stable of them."""
    n = len(xy)
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    core = np.sort(d, axis=1)[:, min(k, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    pairs = [(reach[i, j], i, j) for i in range(n) for j in range(i)]
    heights = sorted({h for h, _, _ in pairs})
    levels = []  # large components at each height, from the top
    for h in reversed(heights):
        levels.append((h, [p for p in parts(n, [(i, j) for w, i, j in pairs if w <= h]) if len(p) >= m]))
    if not levels or not levels[0][1]:
        return [-1] * n
    clusters = []

    def follow(whole, at, above):
        """A cluster from just below ``above`` down to where it splits or ends."""
        born = {}
        now, level = whole, at
        while True:
            inner = [p for h, ps in levels[level : level + 1] for p in ps if p <= now]
            h = levels[level - 1][0]
            if len(inner) == 1:
                for i in now - inner[0]:
                    born[i] = h
                now, level = inner[0], level + 1
                continue
            for i in now:
                born[i] = h
            children = [follow(p, level + 1, h) for p in inner]
            break
        lam = lambda x: 1 / max(x, density.LEAST)
        stability = sum(lam(born[i]) - (0 if above is None else 1 / above) for i in whole)
        clusters.append((whole, stability, children, above))
        return len(clusters) - 1

    follow(levels[0][1][0], 1, None)
    best = {}
    for c, (_, stability, children, above) in enumerate(clusters):
        inner = sum(best[x][0] for x in children)
        if above is not None and (not children or stability >= inner):
            best[c] = (stability, [c])
        else:
            best[c] = (inner, [y for x in children for y in best[x][1]])
    labels = [-1] * n
    for i, c in enumerate(best[len(clusters) - 1][1]):
        for p in clusters[c][0]:
            labels[p] = i
    return labels


def same(a, b):
    return {frozenset(np.flatnonzero(np.array(a) == c)) for c in set(a) if c >= 0} == {frozenset(np.flatnonzero(np.array(b) == c)) for c in set(b) if c >= 0}


def found(spark, xy, m, k=None):
    rows = [(i, float(x), float(y), "kept") for i, (x, y) in enumerate(xy)]
    out = density.density_clusters(spark.createDataFrame(rows, "item_key long, x double, y double, root string").repartition(4), m, k)
    assert out.columns == ["item_key", "x", "y", "root", "c"]
    at = {r.item_key: r.c for r in out.collect()}
    return [at[i] for i in range(len(xy))]


def blobs(seed, sizes, spread=0.04):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(0, 1, 2) + spread * rng.normal(size=(n, 2)) for n in sizes] + [rng.uniform(0, 1, (12, 2))])


def test_curve_is_a_path(monkeypatch):
    monkeypatch.setattr(density, "BITS", 5)
    x, y = (g.ravel() for g in np.meshgrid(np.arange(32), np.arange(32)))
    at = density.hilbert(x, y)
    order = np.argsort(at)
    assert sorted(at) == list(range(1024)) and (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()


@pytest.mark.parametrize(("seed", "block", "edges"), [(1, 256, 50_000), (2, 8, 50_000), (3, 8, 12)])
def test_labels_like_all_pairs(spark, monkeypatch, seed, block, edges):
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "TASK_EDGES", edges)
    xy = blobs(seed, [25, 18, 30])
    want = plain(xy, 8, 5)
    assert len(set(want)) > 2 and same(found(spark, xy, 8, 5), want)


def test_many_equal_heights_and_points(spark, monkeypatch):
    """A grid has few different distances; some of its points stand very many times."""
    monkeypatch.setattr(density, "BLOCK", 10)
    monkeypatch.setattr(density, "TASK_EDGES", 15)
    grid = np.array([(i, j) for i in range(6) for j in range(5)] + [(i + 20, j) for i in range(5) for j in range(5)], float)
    xy = np.concatenate([grid, np.repeat([[3.0, 40.0]], 9, axis=0), np.repeat([[22.0, 2.0]], 4, axis=0), [[60.0, 60.0]]])
    assert same(found(spark, xy, 7, 4), plain(xy, 7, 4))


def test_nothing_to_find(spark):
    assert found(spark, np.random.default_rng(1).normal(size=(4, 2)), 10) == [-1] * 4
    assert found(spark, np.zeros((30, 2)), 10) == [-1] * 30  # one place is the whole, which is no cluster
    assert found(spark, np.array([[float("nan"), 1.0]] * 3), 2) == [-1] * 3
    none = spark.createDataFrame([], "item_key long, x double, y double")
    assert density.density_clusters(none, 5).collect() == []


def test_clusters_of_a_map(spark):
    xy = np.concatenate([np.random.default_rng(s).normal(size=(40, 2)) * 0.01 + [s, s % 2] for s in range(3)])
    rows = spark.createDataFrame([(i, [float(x), float(y)], float(x), float(y)) for i, (x, y) in enumerate(xy)], "item_key long, vec array<double>, x double, y double")
    got = {r.item_key: r.c for r in learning.cluster(rows).collect()}
    assert [len({got[i] for i in range(40 * s, 40 * s + 40) if got[i] >= 0}) for s in range(3)] == [1, 1, 1]
    assert sorted({c for c in got.values() if c >= 0}) == [0, 1, 2]
    assert {r.c for r in learning.cluster(rows.limit(4)).collect()} == {0}
    assert {r.c for r in learning.cluster(rows, method="kmeans").collect()} == {0, 1}


def test_components_in_few_tables(spark, monkeypatch):
    """Links of one task are joined there; more of them meet in parts, also where no part is a better start than all."""
    made, write = [], density.written
    monkeypatch.setattr(density, "written", lambda rows, what: made.append(what) or write(rows, what))
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(1, 60)] + [(70, 80), (80, 90), (5, 5)]
    spread = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2)) + [100, 400]]
    for most, links, tables in ((50_000, path, 2), (25, path, 6), (7, spread, None)):
        monkeypatch.setattr(density, "TASK_EDGES", most)
        made.clear()
        got = density.components(spark.createDataFrame(links, "a long, b long").repartition(3))
        got = {r.node: r.root for r in got.collect()}
        ids = sorted({i for a, b in links if a != b for i in (a, b)})
        at = {i: n for n, i in enumerate(ids)}
        want = {ids[i]: ids[min(p)] for p in parts(len(ids), [(at[a], at[b]) for a, b in links if a != b]) for i in p}
        assert got == want and (tables is None or len(made) == tables)


def test_points_are_made_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float(i * i % 7)

    rows = spark.range(8).select(F.col("id").alias("item_key"), value("id").alias("v"))
    rows = rows.select("item_key", F.array("v", F.col("item_key").cast("double"), F.lit(1.0)).alias("vec"))
    assert learning.project(rows).count() == 8 and seen.value == 8
