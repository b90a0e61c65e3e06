"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order, that of a 64-bit hash. Cutting the order into fragments cuts
every document's set the same way:

* Candidates. Two sets with Jaccard similarity t or more differ in at most d = (1-t)/(1+t)*(|A|+|B|)
  n-grams. Cut into d+1 fragments, they agree on a whole fragment. Sizes fall into bands of ratio 1/t; a
  set is cut as its own band and as the next one need, and each fragment's content gives a signature.
  Whole fragments are far rarer than n-grams, so a passage shared by many documents links nothing.
  ``spare`` more fragments make agreement on empty fragments alone a rare case, which gets signatures
  of its own; nothing is lost.
* Counting. For a candidate pair the overlaps of the fragments of a coarse cut are counted separately
  and summed up per pair; that sum decides, exactly.

Documents with equal sets are one node. In a signature's group every node is first compared with one hub
(the node that shares most), so a group of copies costs as many pairs as it has members. Afterwards only
pairs of a group that are still in different components are looked at. Before any overlap is counted a
pair must pass a bound: n-grams fall into cells, each with the parity of its count, and two sets differ in
at least as many n-grams as their parities differ in cells. A map has MAP_BITS cells; sets of more n-grams
also have a wide one, with a cell for each, as a map much smaller than its set fills up and tells nothing.
What is reachable by links comes out exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .graph import components
from .shared import drop, words_of, written

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
PARTS = 8  # fragments of the counting cut
MAP_BITS, MAP_LONGS = 1024, 16  # cells of a parity map, its 64-bit values
MOST_SENT = 1_000_000  # ids that are broadcast to drop their rows (8 MB); more are joined by shuffle
MOST_BITS = 26  # of the driver's filter over document ids, as a power of two (8 MB)
ROWS = 512  # texts handled at once
KEPT_WORDS = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_word_hash: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    kept = _word_hash
    try:
        return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(kept) > KEPT_WORDS:
            kept.clear()
        kept.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in kept)
        return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(n, len(words))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= M3
        out += h[j : len(h) - k + 1 + j]
    return np.unique(mixed(out))


@lru_cache(maxsize=16)
def bands(num: int, den: int) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
    """Upper sizes of the bands for t = num/den, up to any size met, and (fragments, spare) of each.

    The spare fragments exceed the empty ones that the smallest set cut this way must expect, by so much
    that more is rare; in small cuts, where the subsets of empty fragments are few anyway, by less.
    """
    tops, cuts, lows = [], [], [1]
    while lows[-1] < 1 << 40:
        top = lows[-1] * den // num
        most = 2 * top * (den - num) // (den + num)
        spare = min(3, (most + 1) // 8)
        if most >= 32:
            for _ in range(8):
                count = most + 1 + spare
                empty = count * math.exp(-lows[max(0, len(lows) - 2)] / count)
                spare = math.ceil(empty + min(6.0, 3 + max(0.0, empty - 30) / 60) * math.sqrt(empty) + 1)
        tops.append(top)
        cuts.append((most + 1 + spare if most else 0, spare))
        lows.append(top + 1)
    return tuple(tops), tuple(cuts)


def signatures(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set, as its own band and the next one cut it."""
    tops, cuts = bands(num, den)
    level = bisect_left(tops, len(own))
    scrambled = mixed(own + M3)
    out = []
    for at in (level, level + 1):
        count, spare = cuts[at]
        if not count:  # only equal sets are similar enough
            continue
        place = ((own >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums = np.add.reduceat(scrambled, first)
        out.append(mixed(sums + mixed(np.uint64(at << 32) + place[first] + M3)))
        if count - len(first) > spare:
            full = set(place[first].tolist())
            empty = [i for i in range(count) if i not in full]
            out.append(mixed(np.array([hash((at, *c)) & (2**64 - 1) for c in combinations(empty, spare + 1)], np.uint64) ^ M2))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def node_of(own: np.ndarray) -> int:
    """Identity of a set: 64 bits over its hashes and size."""
    return int(mixed(np.add.reduce(mixed(own ^ M1), dtype=np.uint64).reshape(1) + np.uint64(len(own)))[0]) if len(own) else 0


#: Signature rows have null ids and no size, and signatures of 48 bits: what is constant costs next to nothing
#: in a compressed shuffle, and signatures that meet by chance are only candidates.
ROW = pa.schema([("node", pa.int64()), ("sig", pa.int64()), ("doc_id", pa.int64()), ("info", pa.bool_()), ("size", pa.int64()), ("map", pa.binary())])
ROW_SQL = "node long, sig long, doc_id long, info boolean, size long, map binary"
SIG_BITS = np.uint64(2**48 - 1)


def parities(own: np.ndarray) -> bytes:
    """The parity of each cell's count, a bit a cell: MAP_BITS cells, and behind them the wide map of a larger set.

    The number of a wide map's cells is the power of two from the set's size on; a map folds onto one of half
    the cells by xor of its halves.
    """
    out = b""
    for cells in [MAP_BITS, 1 << (len(own) - 1).bit_length()][: 1 + (len(own) > MAP_BITS)]:
        out += np.packbits(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()
    return out


def _info_rows(node: np.ndarray, key: np.ndarray, ids: pa.Array, size: np.ndarray, maps: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(key.view(np.int64)), ids, pa.array(np.ones(len(node), bool)), pa.array(size), pa.array(maps, pa.binary())], schema=ROW)


def _sig_rows(node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    n = len(node)
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(sig.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], schema=ROW)


def _sign(n: int, num: int, den: int):
    """Per document an info row, dealt by its node and place; per distinct (signature, node) of a slice a signature row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                nodes, sizes, maps, seen, sigs, owners = [], [], [], set(), [], []
                for text in part.column(1):
                    own = shingles(words_of(text.as_py()), n)
                    nodes.append(node_of(own))
                    sizes.append(len(own))
                    maps.append(parities(own))
                    if len(own) and nodes[-1] not in seen:
                        seen.add(nodes[-1])
                        sigs.append(signatures(own, num, den) & SIG_BITS)
                        owners.append(np.full(len(sigs[-1]), nodes[-1], np.uint64))
                node = np.array(nodes, np.uint64)
                spread = mixed(node + np.arange(at, at + len(node), dtype=np.uint64) * M3)
                yield _info_rows(node, spread, part.column(0), np.array(sizes, np.int64), maps)
                if sigs:
                    yield _sig_rows(np.concatenate(owners), np.concatenate(sigs))

    return run


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and node: info rows as they are, and distinct (signature, node) where two nodes share one.

    Only one row is held from batch to batch, with whether its group has had another.
    """
    held, open_ = np.empty((2, 0), np.int64), False
    for batch in batches:
        info = batch.column(3).to_numpy(zero_copy_only=False)
        if info.any():
            yield batch.filter(pa.array(info))
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy()[~info] for i in (1, 0)])], axis=1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))]
        after = np.concatenate(([open_ and held.shape[1] > 0], rows[0, 1:] == rows[0, :-1]))
        shared = after | np.concatenate((after[1:], [False]))
        done = rows[:, :-1][:, shared[:-1]]
        if done.shape[1]:
            yield _sig_rows(done[1], done[0])
        held, open_ = rows[:, -1:], bool(after[-1])
    if open_:
        yield _sig_rows(held[1], held[0])


def _fragments(n: int, wanted):
    """(node, part, spoke, hub, own) of documents whose hashed id passes one of two filters: the fragments of the counting
    cut, each a sorted array of n-gram hashes, and which of the filters. They let some others pass, which does no harm."""

    def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = ids & np.int64(64 * len(bits) - 1)
        return (bits[at >> 6] >> (at & 63)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column(0).to_numpy()
            spoke, hub = (passes(bits, ids) for bits in wanted.value)
            keep = np.flatnonzero(spoke | hub)
            texts = whole.column(1).take(pa.array(keep))
            for at in range(0, len(keep), ROWS):
                nodes, places, own, docs = [], [], [], []
                for i, text in enumerate(texts.slice(at, ROWS)):
                    s = shingles(words_of(text.as_py()), n)
                    if not len(s):
                        continue
                    node = np.uint64(node_of(s)).view(np.int64)
                    ends = np.searchsorted(s, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(64 - PARTS.bit_length() + 1))
                    for place, x in enumerate(np.split(s.view(np.int64), ends)):
                        if len(x):
                            nodes.append(node)
                            places.append(place)
                            own.append(x)
                            docs.append(keep[at + i])
                if nodes:
                    yield pa.record_batch(
                        [pa.array(nodes, pa.int64()), pa.array(places, pa.int32()), pa.array(spoke[docs]), pa.array(hub[docs]), pa.array(own, pa.list_(pa.int64()))],
                        names=["node", "part", "spoke", "hub", "own"],
                    )

    return run


def id_filter(ids: DataFrame, hashed: str) -> np.ndarray:
    """One bit for each hashed id, over 16 bits an id within 2**MOST_BITS; beyond that it passes more than it must."""
    power = min(MOST_BITS, max(10, (16 * ids.count()).bit_length()))
    place = F.col(hashed).bitwiseAND((1 << power) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    out = np.zeros(1 << (power - 6), np.int64)
    for cell, value in ids.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(one)).collect():
        out[cell] = value
    return out


def _count(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(a, b, common) for pairs: overlaps of each fragment, summed. Each side meets only the fragments of its own nodes."""
    left = pairs.select("a", "b").join(fragments.where("spoke").select(F.col("node").alias("a"), "part", F.col("own").alias("own_a")), "a")
    both = left.join(fragments.where("hub").select(F.col("node").alias("b"), "part", F.col("own").alias("own_b")), ["b", "part"])
    partial = both.select("a", "b", "part", F.size(F.array_intersect("own_a", "own_b")).alias("k"))
    once = partial.groupBy("a", "b", "part").agg(F.max("k").alias("k"))  # a set may come twice, by ids that pass the filter by chance
    return once.groupBy("a", "b").agg(F.sum("k").alias("common"))


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join's two tables, both written: (doc_id, n_shingles, node) and (node, root) of linked nodes.

    Two documents link when 100 * common >= percent * union over their sets of n-word shingles (A-Z lower-
    cased). Null and empty texts have the empty set, node 0, and link with nothing. Repeated rows share a
    node; null ids are kept.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = narrow.mapInArrow(_sign(n, percent, 100), ROW_SQL)
    groups = written(signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_keep_shared, ROW_SQL), "ngram-groups")
    signed_info, grouped = groups.where("info"), groups
    info = written(signed_info.select("doc_id", F.col("size").alias("n_shingles"), "node"), "ngram-info")
    groups = groups.where("not info").select("sig", "node").distinct()

    sizes = info.groupBy("node").agg(F.max("n_shingles").alias("size"))
    shares = groups.groupBy("node").agg(F.count(F.lit(1)).alias("shares")).join(sizes, "node")

    def long_at(at: Column) -> Column:
        return F.conv(F.hex(F.substring(F.col("map"), at, F.lit(8))), 16, -10).cast("long")

    packed = signed_info.join(shares.select("node"), "node", "left_semi").groupBy("node").agg(F.any_value("map").alias("map"))
    longs = F.floor(F.length("map") / 8).cast("int")
    wide = F.when(longs > MAP_LONGS, F.transform(F.sequence(F.lit(MAP_LONGS), longs - 1), lambda i: long_at(8 * i + 1)))
    maps = written(packed.select("node", *[long_at(F.lit(8 * i + 1)).alias(f"m{i}") for i in range(MAP_LONGS)], wide.alias("wide")), "ngram-maps")
    known = written(groups.join(shares, "node"), "ngram-shares")
    hub = F.max(F.struct("shares", "node", "size")).alias("h")
    hubs = known.groupBy("sig").agg(hub, F.count(F.lit(1)).alias("members")).select("sig", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), "members")
    spokes = written(known.join(hubs, "sig").where("node <> hub").select("sig", "node", "size", "hub", "hub_size", "members"), "ngram-spokes")
    drop(grouped, known)
    held_by = info.where("n_shingles > 0").groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = not held_by.where("rows > 1 or doc_id is null").isEmpty()
    ids = written(held_by.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("node", F.xxhash64("doc_id").alias("hashed")), "ngram-ids")

    def with_maps(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(maps.select(F.col("node").alias(side), *[F.col(f"m{i}").alias(f"{side}{i}") for i in range(MAP_LONGS)]), side)
        return pairs

    def may_link() -> Column:
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(MAP_LONGS)])
        sizes = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
        return sizes & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("na") + F.col("nb")))

    def also_wide(pairs: DataFrame) -> DataFrame:
        """Pairs that the wide maps do not rule out either; sizes of pairs are alike, so that one fold is enough."""
        for side in "ab":
            pairs = pairs.join(maps.where("wide is not null").select(F.col("node").alias(side), F.col("wide").alias(f"{side}w")), side, "left")
        cells = F.least(F.size("aw"), F.size("bw"))

        def folded(w: Column) -> Column:
            return F.when(F.size(w) > cells, F.zip_with(F.slice(w, F.lit(1), cells), F.slice(w, cells + 1, cells), lambda x, y: x.bitwiseXOR(y))).otherwise(w)

        both = F.zip_with(folded(F.col("aw")), folded(F.col("bw")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        differ = F.aggregate(both, F.lit(0), lambda acc, x: acc + x)
        known = F.col("aw").isNotNull() & F.col("bw").isNotNull() & (F.greatest(F.size("aw"), F.size("bw")) <= 2 * cells)
        apart = F.lit(100 + percent) * differ > F.lit(100 - percent) * (F.col("na") + F.col("nb"))
        return pairs.where(~F.when(known, apart).otherwise(False)).select("a", "b", "na", "nb")

    def linked(pairs: DataFrame) -> DataFrame:
        """Counts the overlaps of pairs, on the fragments of just their documents."""
        wanted = [written(pairs.select(F.col(side).alias("node")).distinct().join(ids, "node").select("hashed"), "ngram-wanted") for side in "ab"]
        bits = docs.sparkSession.sparkContext.broadcast([id_filter(x, "hashed") for x in wanted])
        parts = narrow.select(F.xxhash64("doc_id").alias("hashed"), "text").mapInArrow(_fragments(n, bits), "node long, part int, spoke boolean, hub boolean, own array<long>")
        parts = written(parts.dropDuplicates(["node", "part", "spoke", "hub"]) if repeated else parts, "ngram-fragments")
        enough = F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))
        out = written(pairs.join(_count(pairs, parts), ["a", "b"]).where(enough).select("a", "b"), "ngram-links")
        drop(*wanted, parts)
        return out

    fits = F.lit(100) * F.least("size", "hub_size") >= F.lit(percent) * F.greatest("size", "hub_size")
    first = spokes.where(fits).select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("size").alias("na"), F.col("hub_size").alias("nb")).distinct()
    first = written(also_wide(with_maps(first).where(may_link()).select("a", "b", "na", "nb")), "ngram-pairs")
    links = linked(first)
    roots = components(links)

    several = spokes.where("members > 2")  # in a group of two the pair has been compared
    member = several.select("sig", "node", "size").unionByName(several.select("sig", F.col("hub").alias("node"), F.col("hub_size").alias("size")).distinct())
    member = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = member.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    open_ = written(member.join(split, "sig").join(maps.drop("wide"), "node"), "ngram-open")
    x, y = (open_.select("sig", F.col("node").alias(s), F.col("size").alias(f"n{s}"), F.col("root").alias(f"root_{s}"), *[F.col(f"m{i}").alias(f"{s}{i}") for i in range(MAP_LONGS)]) for s in "ab")
    meet = (x["sig"] == y["sig"]) & (F.col("root_a") < F.col("root_b")) & may_link()
    rest = x.join(y, meet).select("a", "b", "na", "nb").distinct()
    tried = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(also_wide(rest.join(tried, ["a", "b"], "left_anti")), "ngram-pairs")
    drop(spokes, open_, maps)
    if not rest.isEmpty():
        more, former = linked(rest), roots
        roots = components(former.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        drop(more, former)
    drop(first, links, rest, ids)
    return info, roots


def classes(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to, a row's own included."""
    info, roots = join(docs, n, percent, id_col, text_col)
    per_node = info.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = per_node.groupBy("root").agg(F.min("low").alias("component_id"))
    named = per_node.join(lowest, "root").select("node", "component_id")
    return info.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _noded(n: int, text_col: str):
    """Rows with the node and size of their text's set of n-grams behind their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns = [shingles(words_of(t.as_py()), n) for t in batch.column(text_col)]
            nodes = np.array([node_of(own) for own in owns], np.uint64).view(np.int64)
            sizes = np.array([len(own) for own in owns], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes), pa.array(sizes)], names=[*batch.schema.names, "ngram_node", "ngram_size"])

    return run


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id, of repeated rows one.

    Documents without words link with nothing and all stay, as do rows with null ids. An id on several rows
    counts with each of its texts: a row goes only if another one stands for its own text's component.
    """
    info, roots = join(docs, n, percent, id_col, text_col)
    per_node = info.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = per_node.groupBy("root").agg(F.min(F.struct("low", "node")).alias("f")).select(F.col("f.low").alias("doc_id"), F.col("f.node").alias("node"), F.lit(True).alias("stays"))
    copies = info.where("doc_id is not null").join(firsts, ["doc_id", "node"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.expr("n_shingles = 0 or stays is not null")).alias("stays"))
    copies = written(copies.where("rows > 1 or not stays"), "ngram-first")
    again = copies.where("rows > 1 and stays").select(F.col("doc_id").alias("again_id"))
    gone = copies.where("not stays").select(F.col("doc_id").alias("gone_id"))
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs[id_col].cast("long") == gone["gone_id"], "left_anti")
    if again.isEmpty():
        return kept
    marked = kept.join(again, kept[id_col].cast("long") == again["again_id"], "left")
    several = marked.where("again_id is not null")
    several = several.mapInArrow(_noded(n, text_col), StructType([*several.schema.fields, StructField("ngram_node", LongType()), StructField("ngram_size", LongType())]))
    stand = firsts.select(F.col("doc_id").alias("again_id"), F.col("node").alias("ngram_node"))
    once = several.where("ngram_size > 0").join(stand, ["again_id", "ngram_node"], "left_semi").dropDuplicates(["again_id", "ngram_node"])
    parts = [marked.where("again_id is null"), several.where("ngram_size = 0"), once]
    return reduce(DataFrame.unionByName, [x.select(*docs.columns) for x in parts])
