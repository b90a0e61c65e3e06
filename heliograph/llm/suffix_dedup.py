"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where the text itself selects them: at a position whose K-word hash is the smallest
of some REACH consecutive ones. Any K + REACH - 1 shared words (SPAN is more) hold a selected position in
common, so a shared passage meets itself. Suffixes whose first K words occur nowhere else are dropped early.
The rest are sorted by what follows, with the words before them at hand.

An interval of suffixes with the same first K words is compared exactly. A match extends l words to the left
and r to the right of them, and counts from l + K + r = SPAN words on. For each such pair (l, r) the interval is
sorted by those words and neighbours are compared: equal ones of different documents match. So a pair is found
however its match lies around the anchor, whatever other documents share on one side alone, and a word is
reported if and only if it stands in SPAN words that another document has too. Contexts hold just the words
that this decision needs: selected positions are so dense that longer matches chain up.

Intervals are dealt to tasks by their K-word hash. Those of more than ``hot`` suffixes (a passage may stand in a
third of all documents) are not: their SPAN-word windows are summed up by hash, in each task first, and met again
by hash. A word repeated over and over would select every position of its run; a run keeps only those near its
ends, and what matches inside a run stands for all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ngram_join import M1, M3, id_filter, mixed, word_hashes
from .shared import drop, words_of, written

K, REACH = 16, 32
SPAN = 50
SIDE = SPAN - K  # words of context on either side of the first K
EDGE = 64  # positions kept at either end of a run of one word
HOT, HOT_SHARE = 20_000, 1 << 20  # suffixes of an interval too large for a task: more than this, and than that part of all
MOST_SENT = 500_000  # shared windows of such intervals that are broadcast; more are joined by shuffle
ROWS = 20_000  # suffixes handled at once
NO_ID = np.int64(2**63 - 1)  # of rows without an id, so that they come last


def k_hashes(h: np.ndarray) -> np.ndarray:
    out = h[: len(h) - K + 1].copy()
    for j in range(1, K):
        out *= M3
        out += h[j : len(h) - K + 1 + j]
    return mixed(out)


def selected(g: np.ndarray) -> np.ndarray:
    """Positions of the window minima by the upper half of the hash, of equal ones the last.

    Which position a window selects depends on its content alone. The minimum of a window is that of the end of one
    block and the beginning of the next.
    """
    n = len(g)
    if n < REACH:
        return np.empty(0, np.int64)
    low = np.uint64(2**32 - 1)
    value = np.full(-(-n // REACH) * REACH, np.uint64(2**64 - 1))
    value[:n] = (g & ~low) | (low - np.arange(n, dtype=np.uint64))
    blocks = value.reshape(-1, REACH)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - REACH + 1], before[REACH - 1 : n])
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (low - (least & low)).astype(np.int64)


def anchors(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Word hashes of a text; K-word hash, position, and positions of its run before and behind, of each kept suffix."""
    none = np.empty(0, np.int64)
    if len(words) < SPAN:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), none, none, none
    h = word_hashes(words)
    g = k_hashes(h)
    at = selected(g)
    new = g[1:] != g[:-1]
    if new.all():
        return h, g[at], at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    place = np.arange(len(g))
    start = np.maximum.accumulate(np.where(np.concatenate(([True], new)), place, 0))
    end = np.minimum.accumulate(np.where(np.concatenate((new, [True])), place, len(g))[::-1])[::-1]
    before, after = at - start[at], end[at] - at
    keep = (before < EDGE) | (after < EDGE)
    at = at[keep]
    return h, g[at], at, before[keep], after[keep]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n): first-K-word hashes of the selected suffixes with their number in a slice."""
    for batch in batches:
        for cut in range(0, batch.num_rows, 1024):
            got = [anchors(words_of(t.as_py()))[1] for t in batch.column(0).slice(cut, 1024)]
            g, n = np.unique(np.concatenate(got), return_counts=True)
            if len(g):
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])


SUFFIX = "g long, ahead binary, behind binary, row long, doc_id long, at long, n_ahead int, n_behind int, before long, after long, hot boolean"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _blobs(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int64) * width
    if len(x) * width < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.array([r.tobytes() for r in x], pa.binary())


def _suffixes(shared):
    """The suffixes whose first K words pass the filter, with the hashed words ahead and (backwards) behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits, hot = shared.value
        row = TaskContext.get().partitionId() << 36
        steps = np.arange(SIDE)
        parts: list[tuple] = []
        n = 0

        def out() -> pa.RecordBatch:
            g, ahead, behind, rows, ids, at, n_ahead, n_behind, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
            cols = [pa.array(g), _blobs(ahead), _blobs(behind), pa.array(rows), pa.array(ids, mask=ids == NO_ID), *map(pa.array, (at, n_ahead, n_behind, before, after)), pa.array(np.isin(g, hot))]
            return pa.RecordBatch.from_arrays(cols, names=_names(SUFFIX))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                h, g, at, before, after = anchors(words_of(text.as_py()))
                g = g.view(np.int64)
                cell = g & np.int64(64 * len(bits) - 1)
                keep = np.flatnonzero((bits[cell >> 6] >> (cell & 63)) & 1)
                if not len(keep):
                    continue
                g, at, before, after = g[keep], at[keep], before[keep], after[keep]
                short = np.concatenate([np.zeros(SIDE, ">u4"), (h >> np.uint64(32)).astype(">u4"), np.zeros(SIDE, ">u4")])
                size = len(at)
                for cut in range(0, size, ROWS):
                    a = at[cut : cut + ROWS]
                    own = np.full(len(a), row), np.full(len(a), NO_ID if doc_id is None else doc_id, np.int64)
                    ends = np.minimum(SIDE, len(h) - K - a).astype(np.int32), np.minimum(SIDE, a).astype(np.int32)
                    parts.append((g[cut : cut + ROWS], short[(a + SIDE + K)[:, None] + steps], short[(a + SIDE - 1)[:, None] - steps], *own, a, *ends, before[cut : cut + ROWS], after[cut : cut + ROWS]))
                    n += len(a)
                    if n >= ROWS:
                        yield out()
                        parts, n = [], 0
        if parts:
            yield out()

    return run


class Interval:
    """Suffixes as arrays, with the hashes of all beginnings of their contexts, in the order of documents."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        col = {c: rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in ("g", "row", "at", "n_ahead", "n_behind", "before", "after")}
        ids = rows.column("doc_id").fill_null(int(NO_ID)).to_numpy()
        order = np.lexsort((col["row"], ids))
        self.ids = ids[order]
        self.g, self.row, self.at, self.n_ahead, self.n_behind, self.before, self.after = (col[c][order] for c in col)
        self.ahead, self.behind = (self._beginnings(rows.column(c), m)[order] for c, m in (("ahead", M3), ("behind", M1)))

    @staticmethod
    def _beginnings(blobs: pa.Array, by: np.uint64) -> np.ndarray:
        words = np.frombuffer(b"".join(blobs.to_pylist()), ">u4").reshape(len(blobs), SIDE).astype(np.uint64)
        out = np.zeros((len(blobs), SIDE + 1), np.uint64)
        for j in range(SIDE):
            out[:, j + 1] = out[:, j] * by + words[:, j] + np.uint64(1)
        return out

    def window(self, right: int) -> tuple[np.ndarray, ...]:
        """Suffixes with ``right`` words behind the first K and SIDE - right before them: index, hash of that window, cover.

        The cover is the window, or all of a run that the window lies in.
        """
        left = SIDE - right
        i = np.flatnonzero((self.n_ahead >= right) & (self.n_behind >= left))
        key = mixed(mixed(self.ahead[i, right] + np.uint64(right)) + self.behind[i, left] * M3 + self.g[i].view(np.uint64))
        inside = (left <= self.before[i]) & (right <= self.after[i])
        first = np.where(inside, self.at[i] - self.before[i], self.at[i] - left)
        last = np.where(inside, self.at[i] + self.after[i], self.at[i] + right) + K
        return i, key, first, last


FOUND = "row long, doc_id long, first long, last long, other long"


def compare(rows: pa.Table) -> pa.RecordBatch | None:
    """(row, doc_id, first, last, other) of the suffixes in whole intervals that match another document's: what is covered, and the id."""
    x = Interval(rows)
    n = len(x.g)
    first, last, other = np.full(n, NO_ID), np.full(n, -1), np.full(n, NO_ID)
    for right in range(SIDE + 1):
        i, key, begin, end = x.window(right)
        if not len(i):
            continue
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        lo = np.flatnonzero(new)
        size = np.diff(np.append(lo, len(i)))
        low, high = (np.repeat(i[order[y]], size) for y in (lo, lo + size - 1))
        shared = x.row[low] != x.row[high]
        own = i[order][shared]
        low, high = low[shared], high[shared]
        first[own] = np.minimum(first[own], begin[order][shared])
        last[own] = np.maximum(last[own], end[order][shared])
        other[own] = np.minimum(other[own], np.where(x.row[low] != x.row[own], x.ids[low], x.ids[high]))
    hit = np.flatnonzero(last >= 0)
    if not len(hit):
        return None
    ids = x.ids[hit]
    return pa.RecordBatch.from_arrays([pa.array(x.row[hit]), pa.array(ids, mask=ids == NO_ID), *(pa.array(y[hit]) for y in (first, last, other))], names=_names(FOUND))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the intervals of a sorted partition; the last one is held until it ends, which takes at most about ``hot`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        g = rows.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut and (got := compare(rows.slice(0, cut))) is not None:
            yield got
        held = rows.slice(cut).combine_chunks().to_batches() if cut else rows.to_batches()
        n = rows.num_rows - cut
    if n and (got := compare(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield got


WINDOW = "key long, row long, doc_id long, first long, last long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of suffixes; doc_id is NO_ID for none."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            x = Interval(batch.slice(at, 4096))
            for right in range(SIDE + 1):
                i, key, first, last = x.window(right)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key.view(np.int64), x.row[i], x.ids[i], first, last))], names=_names(WINDOW))


def _hot_spans(rows: DataFrame) -> DataFrame:
    """FOUND for the suffixes of large intervals."""
    windows = rows.mapInArrow(_windows, WINDOW)
    ends = windows.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("lo"), F.max(F.struct("doc_id", "row")).alias("hi"))
    shared = written(ends.where("lo.row <> hi.row"), "suffix-windows")
    if shared.count() <= MOST_SENT:
        shared = F.broadcast(shared)
    other = F.when(F.col("lo.row") != F.col("row"), F.col("lo.doc_id")).otherwise(F.col("hi.doc_id"))
    return windows.join(shared, "key").select("row", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "first", "last", other.alias("other"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, first_word, end_word, n_words, other_doc: maximal stretches of words in SPAN words that stand in other documents too.

    Words count from 0, the end is exclusive, case of A-Z does not matter. other_doc is the smallest id with some
    such SPAN words of the stretch (for the document of the smallest id itself the largest). Every occurrence is
    reported, the first one too; repeats within one row's text are not. Null, empty and short texts have none;
    repeated rows are documents of their own; null ids are kept and count as the largest.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = narrow.select("text").mapInArrow(_keys, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    shared = written(counted.where("n > 1"), "suffix-keys")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = [r.g for r in shared.where(F.col("n") > max(hot, total // HOT_SHARE)).select("g").collect()]  # at most HOT_SHARE
    bits = spark.sparkContext.broadcast((id_filter(shared, "g"), np.array(large, np.int64)))
    found = written(narrow.mapInArrow(_suffixes(bits), SUFFIX), "suffix-rows")
    sorted_ = found.where("not hot").repartition("g").sortWithinPartitions("g", "ahead", "behind")
    spans = sorted_.mapInArrow(_scan, FOUND)
    if large:
        spans = spans.unionByName(_hot_spans(found.where("hot")))
    drop(shared)
    along = W.partitionBy("row").orderBy("first", "last")
    reached = F.max("last").over(along.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reached.isNull() | (F.col("first") > reached), 1).otherwise(0))
    spans = spans.withColumn("stretch", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    first, last = F.min("first"), F.max("last")
    merged = spans.groupBy("row", "stretch").agg(
        F.min("doc_id").alias("doc_id"), first.alias("first_word"), last.alias("end_word"), (last - first).alias("n_words"),
        F.nullif(F.min("other"), F.lit(int(NO_ID))).alias("other_doc"),
    )
    return merged.drop("row", "stretch")
