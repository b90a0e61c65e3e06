"""Nearest neighbours along shifted Hilbert curves.

Each of several curves orders all vectors: a random projection, a random shift, a Hilbert key, and a range
partitioning by (curve, key). A query stands in that order like any vector; the rows within a window of places
around it on any curve are its candidates, and their exact distances rank them. How wide windows must be depends on
the vectors: no curve keeps far dimensions together. So it is measured: for PROBE of the queries all rows are
searched, and the window is the least one that holds the part ``target`` of their neighbours on some curve. A window
is looked at in slots of bounded size, to which queries are copied, never rows.

What is still missing is found by bounds: the first curve is cut into blocks, each in a ball, and every block that
the ball's bound cannot rule out at the distance found so far is looked at too, queries and rows meeting in
pieces of bounded size. The result is exact; how much of it the windows find is ``recall``.

Equal vectors are one point of the curves with their k + 1 smallest ids, of which no more can matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

DIMS, BITS = 8, 7  # of a curve: 56-bit keys
FIT = 10_000  # rows, about, that the scale of the grid is fitted on, by hash of the id
PROBE = 64  # queries that the window is fitted on
SLOT, PIECE, BLOCKS, QUERIES = 4096, 1024, 4096, 4096


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (rows) on a grid of ``bits`` bits a side, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _keys(curves: list[tuple[np.ndarray, np.ndarray]], low: np.ndarray, step: np.ndarray):
    """For each row and curve (curve, key, role, id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            for c, (turn, shift) in enumerate(curves):
                cells = np.clip((x @ turn - low[c]) / step[c] + shift, 0, 2**BITS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert(cells, BITS)), *batch.columns], names=["curve", "key", "role", "id", "vector"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["curve", "role", "id", "vector", "part", "place"])
        at += n


HIT = "query_id long, vec_id long, score double"


def _nearest(k: int, window: int | None):
    """The k nearest rows (role 0) of each query (role 1) in a group, within ``window`` places if given."""

    def run(key, rows):
        role, ids = rows.column("role").to_numpy(), rows.column("id").to_numpy()
        x, place = _matrix(rows.column("vector")), rows.column("place").to_numpy()
        r, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(r) and len(q):
            sizes = (x[r] ** 2).sum(axis=1)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                rough = sizes - 2 * (x[part] @ x[r].T) + (x[part] ** 2).sum(axis=1)[:, None]
                off = ids[r][None, :] == ids[part][:, None]
                if window is not None:
                    off |= np.abs(place[r][None, :] - place[part][:, None]) > window
                rough[off] = np.inf
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(r) > k else np.full(len(part), np.inf)
                slack = 1e-9 * (1 + sizes.max())
                for i, row in enumerate(rough):
                    near = np.flatnonzero((row <= kth[i] + slack) & (row < np.inf))
                    d = np.sqrt(((x[r[near]] - x[part[i]]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[r[near]], d))[:k]
                    out.append((np.full(len(best), ids[part[i]]), ids[r[near]][best], d[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _scan(ids: np.ndarray, asked: np.ndarray, k: int):
    """(query_id, vec_id, score): the k nearest rows of a partition to each of a few queries, by plain comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own, x = part.column(0).to_numpy(), _matrix(part.column(1))
                for i, q in enumerate(asked):
                    other = own != ids[i]
                    d = np.append(best[i][1], np.sqrt(((x[other] - q) ** 2).sum(axis=1)))
                    v = np.append(best[i][0], own[other])
                    order = np.lexsort((v, d))[:k]
                    best[i] = v[order], d[order]
        yield pa.record_batch([pa.array(np.repeat(ids, [len(v) for v, _ in best])), pa.array(np.concatenate([v for v, _ in best])), pa.array(np.concatenate([d for _, d in best]))], names=["query_id", "vec_id", "score"])

    return run


def fitted_window(points: DataFrame, asked: DataFrame, placed: DataFrame, k: int, least: int, target: float) -> int:
    """The least window, but no less than ``least``, that holds the part ``target`` of the neighbours of PROBE queries."""
    probe = asked.orderBy(F.xxhash64("id"), "id").limit(PROBE).collect()
    if not probe:
        return least
    ids = np.array([r.id for r in probe], np.int64)
    true = _top(points.select("id", "vector").mapInArrow(_scan(ids, np.array([r.vector for r in probe]), k), HIT), k).collect()  # PROBE * k rows at most
    wanted = {(0, r.vec_id) for r in true} | {(1, int(i)) for i in ids}
    named = points.sparkSession.createDataFrame(sorted(wanted), "role int, id long")
    places: dict[tuple[int, int], dict[int, list[int]]] = {}
    for r in placed.join(F.broadcast(named), ["role", "id"]).select("role", "id", "curve", "place").collect():
        places.setdefault((r.role, r.id), {}).setdefault(r.curve, []).append(r.place)
    apart = [min(abs(a - b) for c, x in places[1, r.query_id].items() for a in x for b in places[0, r.vec_id][c]) for r in true]
    return max(least, sorted(apart)[math.ceil(target * len(apart)) - 1]) if apart else least


def _ball(key, rows):
    """(block, centre, radius) around vectors, or around balls if they have a radius."""
    x = _matrix(rows.column("vector"))
    centre = x.mean(axis=0)
    far = np.sqrt(((x - centre) ** 2).sum(axis=1)) + (rows.column("radius").to_numpy() if "radius" in rows.column_names else 0.0)
    return pa.table([[key[0].as_py()], [centre.tolist()], [float(far.max())]], schema=pa.schema([("block", pa.int64()), ("vector", pa.list_(pa.float64())), ("radius", pa.float64())]))


BALL = "block long, vector array<double>, radius double"


def _open_blocks(balls):
    """(block, role, id, vector) for the blocks that may hold something nearer than ``reach`` of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, centres, radius = balls.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, reach = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                gap = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1))) - radius
                i, j = np.nonzero(gap <= reach[:, None] * (1 + 1e-9) + 1e-6)
                yield pa.record_batch([pa.array(blocks[j]), part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i))], names=["block", "id", "vector"])

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, curves: int = 4, window: int = 512, target: float = 0.95, widen: bool = True, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` to each row of ``queries``.

    Distances are Euclidean in double precision on the vectors as given; ties go to smaller ids, and a row
    with the query's own id is not its neighbour. Unusable vectors and null ids take no part on either
    side; all others must have one length. Of repeated rows one counts. Empty tables give an empty one.
    ``window`` is the least window; ``widen=False`` stops at the windows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    first = W.partitionBy("vector").orderBy("id")
    points = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select(F.lit(0).cast("int").alias("role"), "id", "vector")
    both = points.unionByName(asked.select(F.lit(1).cast("int").alias("role"), "id", "vector"))

    every = max(1, rows.count() // FIT)
    sample = np.array([r.vector for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vector").collect()])  # about FIT to 2 * FIT rows
    if not len(sample):
        sample = np.array([r.vector for r in rows.select("vector").limit(1).collect()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rng = np.random.default_rng(seed)
    dims, turns, low, step = sample.shape[1], [], [], []
    for _ in range(curves):
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, : min(DIMS, dims)]
        seen = sample @ turn
        a, b = seen.mean(axis=0) - 3.5 * seen.std(axis=0), seen.mean(axis=0) + 3.5 * seen.std(axis=0)
        low.append(a)
        step.append(np.maximum(b - a, 1e-12) / (2**BITS - 9))
        turns.append((turn, rng.uniform(0, 8, turn.shape[1])))
    keyed = both.mapInArrow(_keys(turns, np.array(low), np.array(step)), "curve int, key long, role int, id long, vector array<double>")
    order = ["curve", "key", "role", "id"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.mapInArrow(_number, "curve int, role int, id long, vector array<double>, part int, place long"), "hilbert-order")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = written(placed.join(offsets, "part").withColumn("place", F.col("place") + F.col("before")).select("curve", "role", "id", "vector", "place"), "hilbert-places")

    window = fitted_window(points, asked, placed, k, window, target)
    size = min(window, SLOT)
    place = F.col("place")

    def slot(at: Column) -> Column:
        return F.floor(at / F.lit(size)).cast("long")

    near = F.when(F.col("role") == 1, F.sequence(slot(F.greatest(place - window, F.lit(0))), slot(place + window))).otherwise(F.array(slot(place)))
    hits = placed.withColumn("slot", F.explode(near)).groupBy("curve", "slot").applyInArrow(_nearest(k, window), HIT)
    found = written(_top(hits, k), "hilbert-hits")
    if not widen:
        return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    line = placed.where("curve = 0 and role = 0")
    most = line.agg(F.max("place")).first()[0] or 0
    pieces = -(-(most + 1) // PIECE)
    per_block = -(-pieces // BLOCKS)
    pieced = line.withColumn("piece", F.floor(F.col("place") / F.lit(PIECE)).cast("long")).withColumn("block", F.floor(F.col("piece") / F.lit(per_block)).cast("long"))
    balls = pieced.select("piece", "vector").groupBy("piece").applyInArrow(_ball, BALL)
    balls = balls.withColumn("block", F.floor(F.col("block") / F.lit(per_block)).cast("long")).groupBy("block").applyInArrow(_ball, BALL).collect()  # at most BLOCKS
    shared = spark.sparkContext.broadcast((np.array([b.block for b in balls], np.int64), np.array([b.vector for b in balls]), np.array([b.radius for b in balls])))
    reach = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("reach"))
    asking = asked.join(reach, asked["id"] == reach["query_id"], "left").select("id", "vector", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    opened = asking.mapInArrow(_open_blocks(shared), "block long, id long, vector array<double>")
    groups = max(1, -(-asked.count() // QUERIES))
    of_block = pieced.select("block", "piece").distinct()
    asking = opened.join(of_block, "block").select("piece", F.lit(1).cast("int").alias("role"), "id", "vector", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"))
    grouped = pieced.join(asking.select("piece", "grp").distinct(), "piece").select("piece", F.lit(0).cast("int").alias("role"), "id", "vector", "grp")  # pieces meet only those who ask for them
    wide = grouped.unionByName(asking).withColumn("place", F.lit(0).cast("long")).groupBy("piece", "grp").applyInArrow(_nearest(k, None), HIT)
    return _top(found.select("query_id", "vec_id", "score").unionByName(wide), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows of ``exact`` that ``found`` has."""
    total = exact.count()
    return found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
