"""Density clusters of points in the plane, by hierarchy (HDBSCAN), without comparing all points with each other.

Equal points are one node with a weight. Nodes are numbered along a Hilbert curve and cut into blocks of ``BLOCK``,
each with its box. All that tasks share is the boxes, one row a block, whose number is checked.

1. The core distance of a node is the distance within which ``min_samples`` points lie, itself included. How far a
   block has to look follows from boxes and weights; it meets the blocks that are no further away than that.
2. The spanning forest under the reachability max(core, core, distance) grows in Borůvka rounds: a block looks for
   each of its components' shortest way out, among blocks that a bound by boxes, cores and components leaves.
3. d, the height at which a node's component first has ``min_cluster`` points, comes from the forest's edges. While
   they are too many for one task, they are halved by weight: components that the lighter half makes large are
   problems of their own, the heavier half goes on with components as nodes.
4. Edges that join large components are no more than n / min_cluster. Without them the forest falls into families, each
   with one place where a cluster is born. Those edges are the condensed tree; sums over (family, height between
   two merges) give the stabilities, and the most stable clusters that do not lie in each other are chosen.
   Merges of equal height are one merge of many. The whole is never chosen, what is in no chosen cluster is noise, -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written
from .places import numbered

BLOCK, BITS = 256, 16
#: Most neighbours that a core distance looks at, and most blocks whose boxes tasks share (50 million points).
MOST_NEAR, MOST_BLOCKS = 64, 200_000
#: Edges that one task works through in order.
TASK_EDGES = 50_000
LEAST = 1e-10  # of a height, when it is divided by
SHIFT = 1 << 31


def hilbert(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place on the curve of points of a grid of 2^BITS by 2^BITS."""
    x, y, at = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    s = 1 << (BITS - 1)
    while s:
        right, up = (x & s) > 0, (y & s) > 0
        at += s * s * ((3 * right) ^ up)
        flip = ~up & right
        x, y = np.where(flip, s - 1 - (x & (s - 1)), x & (s - 1)), np.where(flip, s - 1 - (y & (s - 1)), y & (s - 1))
        x, y = np.where(up, x, y), np.where(up, y, x)
        s >>= 1
    return at


def nodes_of(points: DataFrame) -> DataFrame:
    """(id, block, x, y, w): distinct points along the curve."""
    distinct = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    ends = distinct.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    spans = [max(ends[1] - ends[0], 1e-300), max(ends[3] - ends[2], 1e-300)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = (1 << BITS) - 1
        for b in batches:
            grid = [((b.column(i).to_numpy() - low) / span * top).round() for i, low, span in ((0, ends[0], spans[0]), (1, ends[2], spans[1]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(*grid))], names=["x", "y", "w", "key"])

    placed = numbered(distinct.mapInArrow(keyed, "x double, y double, w long, key long"), "key", "x", "y", into="id")
    return placed.select("id", F.floor((F.col("id") - 1) / BLOCK).cast("long").alias("block"), "x", "y", "w")


def packed(nodes: DataFrame) -> DataFrame:
    """(block, p): the nodes of each block."""
    rest = [c for c in nodes.columns if c not in ("block", "id")]
    return nodes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", *rest))).alias("p"))


def _lists(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a column of lists of structs, as one array a field."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = column.flatten()
    fields = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield {k: v[a:b] for k, v in fields.items()}


class Boxes:
    """What tasks know of all blocks: boxes, weights, and with them cores and components."""

    def __init__(self, nodes: DataFrame):
        more = [F.min("core").alias("near"), F.max("core").alias("far"), F.min("comp").alias("one"), F.max("comp").alias("other")]
        more = more if "comp" in nodes.columns else []
        sides = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("w").alias("w")]
        rows = nodes.groupBy("block").agg(*sides, *more).toArrow().sort_by("block")
        for name in rows.column_names:
            setattr(self, name, rows[name].to_numpy())
        if more:
            self.whole = np.where(self.one == self.other, self.one, -1)

    def gaps(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distances between points of block ``b`` and of each block."""
        dx = np.maximum(0, np.maximum(self.x0 - self.x1[b], self.x0[b] - self.x1))
        dy = np.maximum(0, np.maximum(self.y0 - self.y1[b], self.y0[b] - self.y1))
        wx = np.maximum(self.x1 - self.x0[b], self.x1[b] - self.x0)
        wy = np.maximum(self.y1 - self.y0[b], self.y1[b] - self.y0)
        return np.hypot(dx, dy), np.hypot(wx, wy)


def _met(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(b, p, q): pairs of blocks with the nodes of both."""
    own, theirs = blocks.withColumnRenamed("block", "b"), blocks.select(F.col("block").alias("c"), F.col("p").alias("q"))
    return pairs.join(theirs, "c").join(own, "b").select("b", "p", "q")


def _distances(p: dict, q: dict) -> np.ndarray:
    return np.hypot(p["x"][:, None] - q["x"], p["y"][:, None] - q["y"])


def with_cores(nodes: DataFrame, k: int) -> DataFrame:
    """Adds ``core``, the distance within which k points lie; the largest distance if there are fewer."""
    boxes, blocks = Boxes(nodes), written(packed(nodes), "density-blocks")

    def to_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                near, far = boxes.gaps(b)
                order = np.argsort(far, kind="stable")
                enough = np.searchsorted(np.cumsum(boxes.w[order]), k)
                c = np.flatnonzero(near <= far[order[min(enough, len(order) - 1)]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), b)), pa.array(c)], names=["b", "c"])

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = d = w = None
        for batch in batches:
            for p, q in zip(_lists(batch.column(1)), _lists(batch.column(2)), strict=True):
                if ids is None:
                    ids, d, w = p["id"], np.empty((len(p["id"]), 0)), np.empty((len(p["id"]), 0), np.int64)
                d = np.concatenate([d, _distances(p, q)], axis=1)
                w = np.concatenate([w, np.broadcast_to(q["w"], (len(ids), len(q["w"])))], axis=1)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                d, w = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
        enough = np.minimum((np.cumsum(w, axis=1) < k).sum(1), d.shape[1] - 1)
        core = np.take_along_axis(d, enough[:, None], 1)[:, 0]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(core)], names=["id", "core"])

    pairs = blocks.select("block").mapInArrow(to_meet, "b long, c long")
    found = _met(pairs, blocks).groupBy("b").applyInArrow(_iterated(cores), "id long, core double")
    return written(nodes.join(found, "id").select("id", "block", "x", "y", "w", "core"), "density-cores")


def _iterated(f):
    """A function of record batches with the annotations by which Spark hands it a group in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)

    return run


BEST = "comp long, w double, lo long, hi long, to long"


def spanning_forest(nodes: DataFrame) -> DataFrame:
    """(lo, hi, w): the tree of least reachability over nodes with cores; ties go to smaller ids."""
    spark, found = nodes.sparkSession, None
    nodes = written(nodes.withColumn("comp", F.col("id")), "density-nodes")
    while True:
        boxes = Boxes(nodes)
        if boxes.one.min() == boxes.other.max():
            break
        blocks = written(packed(nodes.select("id", "block", "x", "y", "core", "comp")), "density-blocks")

        def reach(batches: Iterator[pa.RecordBatch], boxes: Boxes = boxes) -> Iterator[pa.RecordBatch]:
            """How far a block's nodes must look at most, by blocks that hold a foreign node for each of them."""
            for batch in batches:
                found = []
                for b in batch.column(0).to_pylist():
                    foreign = boxes.whole == -1
                    if boxes.whole[b] != -1:
                        foreign |= boxes.whole != boxes.whole[b]
                    far = np.maximum(boxes.gaps(b)[1], np.maximum(boxes.far, boxes.far[b]))
                    found.append(float(far[foreign].min()))
                own = boxes.whole[batch.column(0).to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(found)], names=["b", "whole", "reach"])

        bounds = blocks.select("block").mapInArrow(reach, "b long, whole long, reach double")
        least = bounds.where("whole >= 0").groupBy("whole").agg(F.min("reach").alias("least"))
        bounds = bounds.join(least, "whole", "left").select("b", F.coalesce("least", "reach").alias("reach"))

        def to_meet(batches: Iterator[pa.RecordBatch], boxes: Boxes = boxes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, far in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    low = np.maximum(boxes.gaps(b)[0], np.maximum(boxes.near, boxes.near[b]))
                    c = np.flatnonzero((low <= far) & ((boxes.whole == -1) | (boxes.whole != boxes.whole[b])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), b)), pa.array(c)], names=["b", "c"])

        pairs = bounds.mapInArrow(to_meet, "b long, c long")
        best = _met(pairs, blocks).groupBy("b").applyInArrow(_iterated(_ways_out), BEST)
        best = best.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "to")).alias("e")).select("comp", "e.*")
        best = written(best, "density-best")
        edges = best.select("lo", "hi", "w").distinct()
        found = edges if found is None else found.unionByName(edges)
        roots = components(best.select(F.col("comp").alias("a"), F.col("to").alias("b")))
        before, nodes = nodes, written(
            nodes.join(roots, nodes["comp"] == roots["node"]).select("id", "block", "x", "y", "w", "core", F.col("root").alias("comp")),
            "density-nodes",
        )
        drop(before, blocks)
    return spark.createDataFrame([], "lo long, hi long, w double") if found is None else found


def _ways_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each component in one block the shortest edge to a node of another one, ties by the edge's smaller ids."""
    best: dict[int, tuple[float, int, int, int]] = {}
    for batch in batches:
        for p, q in zip(_lists(batch.column(1)), _lists(batch.column(2)), strict=True):
            way = np.maximum(_distances(p, q), np.maximum(p["core"][:, None], q["core"]))
            way[p["comp"][:, None] == q["comp"]] = np.inf
            least = way.min(1)
            lo, hi = np.minimum(p["id"][:, None], q["id"]), np.maximum(p["id"][:, None], q["id"])
            edge = np.where(way == least[:, None], lo * SHIFT + hi, np.iinfo(np.int64).max)
            at = edge.argmin(1)
            for i in np.flatnonzero(least < np.inf):
                new = (float(least[i]), int(lo[i, at[i]]), int(hi[i, at[i]]), int(q["comp"][at[i]]))
                comp = int(p["comp"][i])
                if comp not in best or new < best[comp]:
                    best[comp] = new
    columns = list(zip(*((c, *e) for c, e in best.items()), strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["comp", "w", "lo", "hi", "to"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected nodes of (a, b) links of longs share the smallest of them.

    A task joins TASK_EDGES links that lie next to each other. A node that several tasks know links the roots it has
    there; these links are fewer and are joined in the same way, or in rounds over all of them if they are not.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    n = links.count()
    if n <= TASK_EDGES:
        return written(links.coalesce(1).mapInArrow(_connected, "node long, root long"), "components")
    parts = links.repartitionByRange(-(-n // TASK_EDGES), "a", "b")
    local = written(parts.mapInArrow(_connected, "node long, root long"), "components")
    tops = local.groupBy("node").agg(F.min("root").alias("top"), F.max("root").alias("last")).where("top <> last").select("node", "top")
    across = local.join(tops, "node").where("root <> top").select(F.col("root").alias("a"), F.col("top").alias("b")).distinct()
    across = written(across, "components")
    upper = components(across) if across.count() <= n // 2 else _components_in_rounds(across)
    known = local.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    out = written(known.groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root")), "components")
    drop(links, local, across)
    return out


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one task's links with the smallest node that these lead to."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _components_in_rounds(links: DataFrame) -> DataFrame:
    """(node, root) of links that are no fewer when tasks have joined their own: rounds over all of them."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "components")
    while True:
        # a root goes under the smallest root that a link leads to, then everybody looks two steps up
        ends = links.join(state.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ends = ends.join(state.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        under = ends.groupBy(F.greatest("ra", "rb").alias("node")).agg(F.min(F.least("ra", "rb")).alias("m"))
        hooked = written(state.join(under, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root")), "components")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        once = hooked.join(up, "root").select("node", F.col("top").alias("root"))
        new = written(once.join(up, "root").select("node", F.col("top").alias("root")), "components")
        changed = new.join(state.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        drop(state, hooked)
        state = new
        if not changed:
            return state


def _born(m: int):
    """Of one problem's items the height at which their component gets large; rows (sub, a, b, w, sa, sb) with the items'
    sizes, which are at least ``m`` for components that are large already."""

    def run(rows: pa.Table) -> pa.Table:
        sub = rows["sub"][0].as_py()
        a, b, w, sa, sb = (rows[c].to_numpy() for c in ("a", "b", "w", "sa", "sb"))
        members, home, size = {}, {}, {}
        for i, s in zip(np.concatenate([a, b]).tolist(), np.concatenate([sa, sb]).tolist(), strict=True):
            members[i], home[i], size[i] = [i], i, s

        def top(i: int) -> int:
            while home[i] != i:
                home[i] = i = home[home[i]]
            return i

        born: dict[int, float] = {}
        order, at = np.argsort(w, kind="stable").tolist(), 0
        while at < len(order):
            height, grown = w[order[at]], set()
            while at < len(order) and w[order[at]] == height:
                x, y = top(int(a[order[at]])), top(int(b[order[at]]))
                at += 1
                if x == y:
                    continue
                if len(members[x]) < len(members[y]):
                    x, y = y, x
                home[y] = x
                members[x] += members.pop(y)
                size[x] += size.pop(y)
                grown.discard(y)
                grown.add(x)
            for x in grown:
                if size[x] >= m:
                    born.update((i, float(height)) for i in members[x] if i not in born)
                    members[x] = []
        out = list(born.items())
        return pa.table([pa.array([sub] * len(out), pa.int64()), pa.array([i for i, _ in out], pa.int64()), pa.array([h for _, h in out], pa.float64())], names=["sub", "item", "d"])

    return run


def births(nodes: DataFrame, forest: DataFrame, m: int) -> DataFrame:
    """(id, d): the height at which each node's component first has m points; nodes that never get there are left out."""
    alone = nodes.where(F.col("w") >= m).select("id", F.col("core").alias("d"))
    sizes = nodes.select("id", F.least("w", F.lit(m)).alias("s"))
    edges = forest.select(F.lit(0).cast("long").alias("sub"), F.col("lo").alias("a"), F.col("hi").alias("b"), "w")
    ends = lambda e, s: (
        e.join(s.select("sub", F.col("item").alias("a"), F.col("s").alias("sa")), ["sub", "a"])
        .join(s.select("sub", F.col("item").alias("b"), F.col("s").alias("sb")), ["sub", "b"])
        .select("sub", "a", "b", "w", "sa", "sb")
    )
    items = sizes.select(F.lit(0).cast("long").alias("sub"), F.col("id").alias("item"), "s")
    where = written(nodes.where(F.col("w") < m).select("id", F.lit(0).cast("long").alias("sub"), F.col("id").alias("item")), "density-where")
    edges = written(ends(edges, items), "density-edges")
    done, problems = [alone], 1
    while True:
        counts = edges.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most"), F.percentile_approx("w", 0.5).alias("mid"))
        counts = written(counts, "density-counts")
        big = counts.where(F.col("n") > TASK_EDGES)
        small = edges.join(big.select("sub"), "sub", "left_anti")
        solved = small.groupBy("sub").applyInArrow(_born(m), "sub long, item long, d double")
        done.append(written(where.join(solved, ["sub", "item"]).select("id", "d"), "density-births"))
        if big.isEmpty():
            break
        # what is of one weight is one step: all of it is light, and what it makes large is born at it
        cut = F.when(F.col("mid") < F.col("most"), F.col("mid")).when(F.col("least") < F.col("most"), (F.col("least") + F.col("most")) / 2)
        big = big.select("sub", F.coalesce(cut, "most").alias("cut"), (F.col("least") == F.col("most")).alias("flat"))
        halves = edges.join(big, "sub")
        pair = lambda c: F.col("sub") * SHIFT + F.col(c)
        light = written(halves.where("w <= cut"), "density-light")
        joined = components(light.select(pair("a").alias("a"), pair("b").alias("b")))
        joined = joined.select(F.shiftright("node", 31).alias("sub"), F.col("node").bitwiseAND(SHIFT - 1).alias("item"), F.col("root").bitwiseAND(SHIFT - 1).alias("root"))
        held = halves.select("sub", F.col("a").alias("item"), F.col("sa").alias("s")).unionByName(halves.select("sub", F.col("b").alias("item"), F.col("sb").alias("s"))).distinct()
        held = held.join(joined, ["sub", "item"], "left").withColumn("root", F.coalesce("root", "item"))
        total = held.groupBy("sub", "root").agg(F.sum("s").alias("sum"), F.count(F.lit(1)).alias("k"))
        total = total.select("sub", "root", F.least("sum", F.lit(m)).alias("size"), ((F.col("sum") >= m) & (F.col("k") > 1)).alias("large"))
        held = written(held.join(total, ["sub", "root"]), "density-held")
        # problems are numbered anew: the heavier half of each, and each component that got large
        heavy_of = held.select("sub").distinct().select("sub", F.lit(None).cast("long").alias("root"))
        named = heavy_of.unionByName(held.where("large").select("sub", "root").distinct())
        named = written(numbered(named, "sub", "root", into="new").withColumn("new", F.col("new") + problems), "density-names")
        problems += named.count()
        heavy_name, large_name = named.where("root IS NULL").select("sub", "new"), named.where("root IS NOT NULL")
        lower = light.join(held.where("large").select("sub", F.col("item").alias("a"), "root"), ["sub", "a"])
        lower = lower.join(large_name, ["sub", "root"]).select(F.col("new").alias("sub"), "a", "b", "w", "sa", "sb")
        upper = halves.where("w > cut").select("sub", "a", "b", "w")
        upper = upper.join(held.select("sub", F.col("item").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa")), ["sub", "a"])
        upper = upper.join(held.select("sub", F.col("item").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb")), ["sub", "b"])
        upper = upper.join(heavy_name, "sub").select(F.col("new").alias("sub"), F.col("ra").alias("a"), F.col("rb").alias("b"), "w", "sa", "sb")
        moved = where.join(held, ["sub", "item"]).join(big, "sub")
        done.append(written(moved.where("large AND flat").select("id", F.col("cut").alias("d")), "density-births"))
        lower = lower.join(big.where("flat").join(large_name, "sub").select(F.col("new").alias("sub")), "sub", "left_anti")
        down = moved.where("large AND NOT flat").join(large_name, ["sub", "root"]).select("id", F.col("new").alias("sub"), "item")
        up = moved.where("NOT large").join(heavy_name, "sub").select("id", F.col("new").alias("sub"), F.col("root").alias("item"))
        edges, where = written(lower.unionByName(upper), "density-edges"), written(down.unionByName(up), "density-where")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


class _Tree:
    """Clusters over families: ``merges`` are (height, family, family), few of them."""

    def __init__(self, families: list[int], merges: list[tuple[float, int, int]]):
        self.chain: dict[int, list[int]] = {f: [i] for i, f in enumerate(families)}
        self.top: list[float] = [float("inf")] * len(families)  # height at which a cluster ends in a larger one
        self.low: list[float] = [0.0] * len(families)
        self.children: list[list[int]] = [[] for _ in families]
        home = {f: f for f in families}
        now = {f: i for i, f in enumerate(families)}
        held = {f: [f] for f in families}
        merges = sorted(merges)
        at = 0
        while at < len(merges):
            height, met = merges[at][0], {}
            while at < len(merges) and merges[at][0] == height:
                a, b = home[merges[at][1]], home[merges[at][2]]
                at += 1
                if a == b:
                    continue
                parts = met.pop(a, [now[a]]) + met.pop(b, [now[b]])
                for f in held[b]:
                    home[f] = a
                held[a] += held.pop(b)
                met[a] = parts
            for a, parts in met.items():
                new = len(self.top)
                self.top.append(float("inf"))
                self.low.append(height)
                self.children.append(parts)
                for c in parts:
                    self.top[c] = height
                now[a] = new
                for f in held[a]:
                    self.chain[f].append(new)

    def chosen(self, weight: dict[tuple[int, int], float], inverse: dict[tuple[int, int], float]) -> set[int]:
        """The clusters of largest stability, by sums of weights and of weights over heights by (family, place in chain)."""
        stable = [0.0] * len(self.top)
        for f, chain in self.chain.items():
            below = 0.0
            for t, c in enumerate(chain):
                here = weight.get((f, t), 0.0)
                stable[c] += inverse.get((f, t), 0.0) + (below / max(self.low[c], LEAST) if below else 0.0)
                below += here
                stable[c] -= below / self.top[c]
        best, picked = [0.0] * len(self.top), [set() for _ in self.top]
        for c in range(len(self.top)):
            inner = sum(best[x] for x in self.children[c])
            whole = self.top[c] == float("inf")
            if not whole and (not self.children[c] or stable[c] >= inner):
                best[c], picked[c] = stable[c], {c}
            else:
                best[c], picked[c] = inner, set().union(*(picked[x] for x in self.children[c]))
        return set().union(*(picked[c] for c in range(len(self.top)) if self.top[c] == float("inf")))


def density_clusters(points: DataFrame, min_cluster: int, min_samples: int | None = None) -> DataFrame:
    """``points`` with ``c``: the number of their cluster from 0, or -1. Rows without x or y are noise.

    ``min_samples`` is ``min_cluster`` if not given, but no more than MOST_NEAR.
    """
    k = min(min_samples or min_cluster, MOST_NEAR)
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    known = known.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    nothing = points.withColumn("c", F.lit(-1))
    if known.isEmpty():
        return nothing
    nodes = written(nodes_of(known), "density-nodes")
    if nodes.agg(F.max("block")).first()[0] >= MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS * BLOCK} distinct points")
    nodes = with_cores(nodes, k)
    forest = written(spanning_forest(nodes), "density-forest")
    nodes = written(nodes.join(births(nodes, forest, min_cluster), "id"), "density-nodes")
    d_of = lambda e: nodes.select(F.col("id").alias(e), F.col("d").alias(f"d_{e}"))
    edges = written(forest.join(d_of("lo"), "lo").join(d_of("hi"), "hi"), "density-edges")
    # nodes that get large together are a clump; its first edge to what is large before makes it of that family,
    # further ones, which are of the same height, join families as edges between two large components do
    both, one = F.least("d_lo", "d_hi"), F.greatest("d_lo", "d_hi")
    inner = edges.where(F.col("w") <= both).select("lo", "hi")
    clumps = components(inner.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    new = F.when(F.col("d_lo") > F.col("d_hi"), F.col("lo")).otherwise(F.col("hi"))
    joining = edges.where((F.col("w") > both) & (F.col("w") <= one)).withColumn("node", new).join(clumps, "node", "left")
    first = joining.groupBy(F.coalesce("root", "node").alias("clump")).agg(F.min(F.struct("lo", "hi")).alias("e"))
    kept = written(inner.unionByName(first.select("e.*")), "density-kept")
    cuts = written(edges.join(kept, ["lo", "hi"], "left_anti").select("lo", "hi", "w"), "density-cuts")
    if cuts.isEmpty():
        return nothing
    family = components(kept.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    nodes = nodes.join(family, nodes["id"] == family["node"], "left").withColumn("f", F.coalesce("root", "id"))
    nodes = written(nodes.select("id", "x", "y", "w", "d", "f"), "density-nodes")
    f_of = lambda e: nodes.select(F.col("id").alias(e), F.col("f").alias(f"f_{e}"))
    cuts = cuts.join(f_of("lo"), "lo").join(f_of("hi"), "hi").select("w", "f_lo", "f_hi")
    merges = [(r.w, r.f_lo, r.f_hi) for r in cuts.collect()]  # fewer than points / min_cluster
    families = sorted({f for _, a, b in merges for f in (a, b)})
    tree = _Tree(families, merges)
    heights = [(f, [tree.top[c] for c in chain[:-1]]) for f, chain in tree.chain.items()]
    tops = nodes.sparkSession.createDataFrame(heights, "f long, tops array<double>")
    nodes = nodes.join(F.broadcast(tops), "f").withColumn("t", F.size(F.filter("tops", lambda h: h <= F.col("d"))))
    sums = nodes.groupBy("f", "t").agg(F.sum("w").alias("w"), F.sum(F.col("w") / F.greatest("d", F.lit(LEAST))).alias("v")).collect()
    chosen = tree.chosen({(r.f, r.t): r.w for r in sums}, {(r.f, r.t): r.v for r in sums})
    first = {c: min(f for f, chain in tree.chain.items() if c in chain) for c in chosen}
    names = {c: i for i, c in enumerate(sorted(chosen, key=first.get))}
    labels = [(f, t, names[c]) for f, chain in tree.chain.items() for t, c in enumerate(chain) if c in chosen]
    labels = nodes.sparkSession.createDataFrame(labels, "f long, last int, c int")
    # a node is in its family's chosen cluster if its component was large before that ended
    found = nodes.join(F.broadcast(labels), "f").where("t <= last").select("x", "y", F.col("c"))
    found = written(found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "c"), "density-labels")
    joined = points.join(found, (points["x"] == found["_x"]) & (points["y"] == found["_y"]), "left")
    return joined.select(*[points[c] for c in points.columns], F.coalesce("c", F.lit(-1)).alias("c"))
