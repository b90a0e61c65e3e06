"""Similarity to reference sets of any size: a grid of vector blocks.

Samples are dealt into R groups and references into C, by row number, so that no value can make a group large. A
sample goes to the C cells of its row of the grid, a reference to the R cells of its column. A cell is one matrix
product, taken in strips; each sample leaves it with its partial maximum, and these are merged by a grouped
aggregate. Nothing is broadcast and nothing is collected but two
counts. With blocks of b rows, n samples and m references, n * m / b vectors each are moved, and a task holds
two blocks and one strip of products.

A mean of dot products is the dot product with the mean, so it needs no cells: one sum of all references is enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal, mean_of
from ..sources.scratch import written
from .search import MOST_REFERENCES, similarity

#: Rows of a block; at 64 dimensions in double precision 16 MB.
BLOCK = 32_768
#: Products of a cell that are in memory at a time; 8 MB.
STRIP = 1_000_000
PARTIAL = "sid long, best double"
PARTS = pa.schema([("sid", pa.int64()), ("best", pa.float64())])


def _dealt(df: DataFrame, number: str, group: str, groups: int, other: str, others: int) -> DataFrame:
    """Rows with their group, once for each group of the other side."""
    dealt = df.withColumn(group, F.pmod(F.xxhash64(number), F.lit(groups)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _numbered(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``df``, written, with a number for each row."""
    return written(df.select(*columns, F.monotonically_increasing_id().alias(name)), "tiles")


def similarity_tiled(
    samples: DataFrame, references: DataFrame, reduce: str = "max", block: int = BLOCK
) -> DataFrame:
    """Each sample's largest or mean dot product with the references, however many there are.

    ``samples`` has vec and any other columns, which are kept; ``references`` has vec. Samples or references without
    vector take no part; without references there is no result. Vectors have one length.
    """
    if reduce not in ("max", "mean"):
        raise ValueError(f"unknown reduction: {reduce}")
    keys = [c for c in samples.columns if c != "vec"]
    known = references.where("vec IS NOT NULL").select(F.col("vec").cast("array<double>").alias("vec"))
    own = samples.where("vec IS NOT NULL")
    if reduce == "mean":
        first = known.select(F.size("vec")).first()
        if first is None:
            return own.where("false").select(*keys, F.lit(None).cast("double").alias("score"))
        middle = literal(known.agg(mean_of(F.col("vec"), first[0])).first()[0])  # as many numbers as dimensions
        own = own.select(F.struct(*keys).alias("keys"), F.col("vec").cast("array<double>").alias("vec"))
        return own.select("keys.*", dot("vec", middle).alias("score"))
    known = written(known, "tiles")
    m = known.count()
    if not m:
        return own.where("false").select(*keys, F.lit(None).cast("double").alias("score"))
    own = own.select(F.struct(*keys).alias("keys"), F.col("vec").cast("array<double>").alias("vec"))
    own = _numbered(own, "sid", "keys", "vec")
    rows, columns = max(1, -(-own.count() // block)), max(1, -(-m // block))
    left = _dealt(own.select("sid", "vec"), "sid", "r", rows, "c", columns)
    right = _dealt(_numbered(known, "rid", "vec"), "rid", "c", columns, "r", rows).drop("rid")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        def matrix(rows: pa.Table) -> np.ndarray:
            return rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        if not len(a) or not len(b):
            return pa.table({"sid": [], "best": []}, schema=PARTS)
        x, y, step = matrix(a), matrix(b), max(1, STRIP // len(b))
        best = np.empty(len(x))
        for at in range(0, len(x), step):
            best[at : at + step] = (x[at : at + step] @ y.T).max(1)
        return pa.table([a["sid"], best], schema=PARTS)

    cells = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(cell, PARTIAL)
    merged = cells.groupBy("sid").agg(F.max("best").alias("score"))
    return own.select("sid", "keys").join(merged, "sid").select("keys.*", "score")


def similarity_to(samples: DataFrame, references: DataFrame, reduce: str = "max") -> DataFrame:
    """As ``similarity_tiled``; a set of references that fits in one array goes to the samples as one instead."""
    if references.limit(MOST_REFERENCES + 1).count() > MOST_REFERENCES:
        return similarity_tiled(samples, references, reduce)
    return similarity(samples, references, reduce)


NEAREST = "sid long, rid long, score double"
FOUND = pa.schema([("sid", pa.int64()), ("rid", pa.int64()), ("score", pa.float64())])


def neighbours_tiled(points: DataFrame, k: int, key: str = "item_key", block: int = BLOCK) -> DataFrame:
    """(a, b, score, place): each point's k others of largest dot product, from 1; ties go to the earlier row.

    ``points`` has a key and vec. Cells emit their own k best of each of their samples, so a sample's candidates are
    k a cell when they are merged.
    """
    own = points.where("vec IS NOT NULL").select(F.col(key).alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    own = _numbered(own, "sid", "key", "vec")
    groups = max(1, -(-own.count() // block))
    left = _dealt(own.select("sid", "vec"), "sid", "r", groups, "c", groups)
    right = _dealt(own.select(F.col("sid").alias("rid"), "vec"), "rid", "c", groups, "r", groups)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"sid": [], "rid": [], "score": []}, schema=FOUND)
        b = b.sort_by("rid")
        x, y = (t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (a, b))
        sid, rid = a["sid"].to_numpy(), b["rid"].to_numpy()
        step, out = max(1, STRIP // len(b)), []
        for at in range(0, len(x), step):
            products = x[at : at + step] @ y.T
            products[sid[at : at + step, None] == rid] = -np.inf
            best = np.argsort(-products, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(products, best, axis=1)
            here = np.repeat(sid[at : at + step], best.shape[1])
            good = score.ravel() > -np.inf
            out.append(pa.table([here[good], rid[best.ravel()][good], score.ravel()[good]], schema=FOUND))
        return pa.concat_tables(out)

    cells = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(cell, NEAREST)
    candidate = F.struct((-F.col("score")).alias("down"), "rid", "score")
    best = cells.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(candidate)), 1, k).alias("best"))
    rows = best.select("sid", F.posexplode("best").alias("i", "n")).select("sid", "n.rid", "n.score", (F.col("i") + 1).alias("place"))
    named = own.select("sid", "key")
    rows = rows.join(named.withColumnRenamed("key", "a"), "sid")
    return rows.join(named.select(F.col("sid").alias("rid"), F.col("key").alias("b")), "rid").select("a", "b", "score", "place")
