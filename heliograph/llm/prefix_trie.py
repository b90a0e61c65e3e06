"""Prefix trie of conversations: who owns which prefix, and what the trie saves.

Conversations are rebuilt (see ``rebuilt``), and every distinct sequence of first d turns is a node. A node belongs
to its smallest member, so its identity is (conv_id, depth). A conversation's prefixes have ever fewer members
as they get longer; so once it is the smallest member of one, it is of all longer ones: what it owns is a chain
from a first depth to its end.

1. Turns are dealt in ranges of (conversation, turn), so that a conversation with a large share of all rows lies
   in many pieces. Ranks, and digests of prefixes, are running values inside a piece plus what the pieces before
   hold: two windows, none over more than a piece or a conversation's pieces.
2. A prefix digest is the XOR of two 64-bit hashes of (depth, role, text) over its turns.
3. A grouped minimum a digest gives each prefix's smallest member. Only shared prefixes are kept: a prefix that
   is not among them has one member.
4. A binary search finds each conversation's first owned depth. All searches run together; a step is one join of
   the digests at their middles with the minima. A search has its candidates with it, 63 at most: of a longer
   conversation first every 64th (4,096th, ...) depth, then those between two of them.
5. A chain hangs at the node in front of its first depth. Sums over chains go up by pointer doubling, so a tree
   of height h takes log2(h) rounds. Inside a chain, sums from a node to the end are running values as in 1.
6. Ids of the conversations that end at a node are joined in pieces of ``PIECE``; one stream a node takes in the
   pieces in order, since SHA-256 is sequential. It holds one batch of pieces.

Edge cases:

* Null roles and texts are empty; null turns stand first; rows with equal turns are ordered by the hashes of role
  and text, so equal rows may change places and the result is the same for any order of the input.
* Rows without conv_id belong to no conversation and take no part. An empty table has no nodes, not even a root.
* c % 20 has the sign of c; the head of conversation c comes from c - c % 20, which may be c itself.
* A conversation may be left without turns: it is a member of the root, and ends there.
* Two different sequences are taken as one if both their 64-bit hashes agree, possible in principle only.
* Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, word_count, written

#: Conversations c - c % FAMILY .. share a head of fewer than HEADS turns.
FAMILY, HEADS = 20, 4
#: Candidates a search has with it: one less.
FAN = 64
#: Ids in one piece of text.
PIECE = 1024
NO_ENDS = sha256(b"").hexdigest()
DIGEST = ("depth", "s1", "s2")


def _running(
    rows: DataFrame, order: list[str], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None,
    falling: bool = False,
) -> DataFrame:
    """``rows`` of (conv_id, piece, ...) with running sums and XORs along each conversation, this row included.

    Pieces follow the order of rows inside a conversation. A window goes over the rows of one piece, another one
    over the totals of a conversation's pieces.
    """
    new = {k: F.sum(v) for k, v in (sums or {}).items()} | {k: F.bit_xor(v) for k, v in (xors or {}).items()}
    old = {k: F.sum(f"all_{k}") for k in sums or {}} | {k: F.bit_xor(f"all_{k}") for k in xors or {}}
    ahead = [F.desc(c) if falling else F.asc(c) for c in order]
    inside = Window.partitionBy("conv_id", "piece").orderBy(*ahead).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("conv_id").orderBy(F.desc("piece") if falling else F.asc("piece"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv_id", "piece").agg(*[v.alias(f"all_{k}") for k, v in new.items()])
    pieces = pieces.select(
        "conv_id", "piece", *[F.coalesce(v.over(before), F.lit(0)).alias(f"old_{k}") for k, v in old.items()]
    )

    def total(name: str) -> Column:
        here, there = new[name].over(inside), F.col(f"old_{name}")
        return (here + there if name in (sums or {}) else here.bitwiseXOR(there)).alias(name)

    return rows.join(pieces, ["conv_id", "piece"]).select(*rows.columns, *[total(k) for k in new])


def _salted(depth: Column, *hashes: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), depth, h).alias(f"s{i + 1}") for i, h in enumerate(hashes)]


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, place, h1, h2, words): turns with their place from 1; ``piece`` is the range they lie in."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.xxhash64(F.lit(1), role, F.lit(""), text).alias("h1"),
        F.xxhash64(F.lit(2), text, F.lit(""), role).alias("h2"),
        word_count(text).alias("words"),
    )
    # equal rows are told apart too, so that no amount of them has to stay in one range
    keys = ["conv_id", "turn", "h1", "h2", "row"]
    dealt = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = written(dealt.withColumn("piece", F.spark_partition_id()), "trie-turns")
    placed = _running(dealt, keys[1:], {"place": F.lit(1)})
    return placed.select("conv_id", "piece", "place", "h1", "h2", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, depth, s1, s2, words): rebuilt turns, with the digest of the prefix that ends with each.

    Conversation c has h = crc32(c) % 4 first turns of c - c % 20, then its own turns after its first h. Depth 0,
    the empty prefix, is a row of every conversation.
    """
    turns = written(ranked(conversations), "trie-ranked")
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    family = sizes.select(
        "conv_id", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string")) % HEADS).cast("int").alias("h")
    )
    heads = turns.where((F.col("place") < HEADS) & (c % FAMILY == 0))
    heads = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "h1", "h2", "words"))).alias("head"))
    # a head has fewer than HEADS turns, a family at most 2 * FAMILY - 1 conversations
    family = family.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.array().cast(heads.schema["head"].dataType))
    family = written(family.select("conv_id", "h", head.alias("head")), "trie-heads")
    first = family.select("conv_id", F.explode("head").alias("x")).select(
        "conv_id", F.lit(-1).alias("piece"), F.col("x.place").alias("depth"), "x.h1", "x.h2", "x.words"
    )
    own = turns.join(family.select("conv_id", "h", F.size("head").alias("k")), "conv_id").where("place > h")
    own = own.select("conv_id", "piece", F.expr("place - h + k").alias("depth"), "h1", "h2", "words")
    salted = first.unionByName(own)
    depth = F.col("depth").cast("long")
    salted = salted.select("conv_id", "piece", depth.alias("depth"), *_salted(depth, F.col("h1"), F.col("h2")), "words")
    prefixes = _running(
        salted.withColumnsRenamed({"s1": "t1", "s2": "t2"}), ["depth"], xors={"s1": F.col("t1"), "s2": F.col("t2")}
    ).drop("t1", "t2")
    zero = F.lit(0).cast("long")
    root = family.select(
        "conv_id", F.lit(-2).alias("piece"), zero.alias("depth"), zero.alias("words"), zero.alias("s1"), zero.alias("s2")
    )
    out = written(prefixes.unionByName(root), "trie-prefixes")
    drop(turns, family)
    return out


def shared_prefixes(prefixes: DataFrame) -> DataFrame:
    """(depth, s1, s2, owner, n_convs) of the prefixes that two or more conversations start with, but the root."""
    minima = prefixes.where("depth > 0").groupBy(*DIGEST)
    return minima.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 1")


def first_owned(prefixes: DataFrame, shared: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, last, first, up): the first depth a conversation owns, last + 1 if none, and who owns the one before.

    Depth ``lo`` is owned by ``up``, ``hi`` by the conversation itself, or it is past the end. The candidates between
    are fetched for each stride, and the search among them takes one join with the minima a step.
    """
    least, longest = lengths.agg(F.min("conv_id"), F.max("last")).first()
    stride = 1
    while stride * FAN <= (longest or 0):
        stride *= FAN
    root = F.col("conv_id") == F.lit(least)
    zero = F.lit(0).cast("long")
    state = lengths.select(
        "conv_id", "last", F.when(root, -1).otherwise(0).cast("long").alias("lo"),
        F.when(root, zero).otherwise(F.col("last") + 1).alias("hi"), F.when(~root, F.lit(least)).cast("long").alias("up"),
    )
    state = written(state, "trie-search")
    keys = [f"p_{k}" for k in DIGEST]
    minima = shared.select(*[F.col(k).alias(f"p_{k}") for k in DIGEST], "owner")
    while stride:
        open_ = state.where("hi - lo > 1").select("conv_id", "lo", "hi")
        at = prefixes.select("conv_id", *DIGEST).join(open_, "conv_id")
        at = at.where((F.col("depth") > F.col("lo")) & (F.col("depth") < F.col("hi")))
        at = at.where((F.col("depth") - F.col("lo")) % stride == 0)
        pages = at.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*DIGEST))).alias("page"))
        # a and b stand for lo and hi, as places in the page
        searches = pages.select(
            "conv_id", "page", F.lit(0).alias("a"), (F.size("page") + 1).alias("b"), F.lit(None).cast("long").alias("up")
        )
        moves = F.col("b") - F.col("a") > 1
        for _ in range(min(FAN - 1, longest or 0).bit_length()):
            middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
            probes = searches.withColumn("m", F.when(moves, middle))
            # a search that has ended asks for what nobody has, each for something else
            ended = F.struct(F.lit(-1).cast("long").alias("depth"), F.col("conv_id").alias("s1"), zero.alias("s2"))
            probes = probes.withColumn("p", F.coalesce(F.expr("CASE WHEN m IS NOT NULL THEN page[m - 1] END"), ended))
            probes = probes.select("conv_id", "page", "a", "b", "m", "up", *[F.col(f"p.{k}").alias(f"p_{k}") for k in DIGEST])
            found = probes.join(minima, keys, "left")
            theirs = F.col("m").isNotNull() & (F.col("owner") != F.col("conv_id"))
            mine = F.col("m").isNotNull() & (F.col("owner").isNull() | (F.col("owner") == F.col("conv_id")))
            searches = found.select(
                "conv_id", "page", F.when(theirs, F.col("m")).otherwise(F.col("a")).alias("a"),
                F.when(mine, F.col("m")).otherwise(F.col("b")).alias("b"),
                F.when(theirs, F.col("owner")).otherwise(F.col("up")).alias("up"),
            )
        done = searches.select(
            "conv_id",
            F.expr("CASE WHEN a > 0 THEN page[a - 1].depth END").alias("new_lo"),
            F.expr("CASE WHEN b <= size(page) THEN page[b - 1].depth END").alias("new_hi"),
            F.col("up").alias("new_up"),
        )
        before, state = state, written(
            state.join(done, "conv_id", "left").select(
                "conv_id", "last", F.coalesce("new_lo", "lo").alias("lo"), F.coalesce("new_hi", "hi").alias("hi"),
                F.coalesce("new_up", "up").alias("up"),
            ),
            "trie-search",
        )
        drop(before)
        stride //= FAN
    return state.select("conv_id", "last", F.col("hi").alias("first"), "up")


def _summed_up(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) with the sums of all chains that hang below; ``chains`` has (conv_id, up, ...).

    After k rounds a chain holds the sums of those less than 2^k links below, and ``up`` is 2^k links above.
    """
    state = written(chains.select("conv_id", "up", "leaves", "saved"), "trie-sums")
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        tops = state.where("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        climbing = state.where("up IS NOT NULL").join(tops, "up").select("conv_id", "next")
        grown = state.join(below.withColumnRenamed("up", "conv_id"), "conv_id", "left").join(climbing, "conv_id", "left")
        before, state = state, written(
            grown.select(
                "conv_id", F.col("next").alias("up"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ),
            "trie-sums",
        )
        drop(before)
    return state.drop("up")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, conv_id) as texts of at most ``PIECE`` ids of one node."""
    out: list[tuple[int, int, int, str]] = []
    node, ids = None, []

    def close() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["owner", "depth", "least", "ids"]
        )

    for b in batches:
        for o, d, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (o, d) != node or len(ids) == PIECE:
                close()
                node = (o, d)
            ids.append(c)
        yield rows()
    close()
    yield rows()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, least, ids) as one SHA-256 a node, taken in piece by piece."""
    node, state = None, None

    def rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 3
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["owner", "depth", "ends_sha256"]
        )

    for b in batches:
        found = []
        for o, d, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (o, d) == node:
                state.update(b",")
            else:
                if node is not None:
                    found.append((*node, state.hexdigest()))
                node, state = (o, d), sha256()
            state.update(ids.encode())
        yield rows(found)
    if node is not None:
        yield rows([(*node, state.hexdigest())])


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, conv_id) rows."""
    keys = ["owner", "depth", "conv_id"]
    sorted_ = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = sorted_.mapInArrow(_joined_ids, "owner long, depth long, least long, ids string")
    whole = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "least")
    return whole.mapInArrow(_hashed_ids, "owner long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node; see the module's text. All columns but the hash are longs."""
    prefixes = rebuilt(conversations)
    shared = written(shared_prefixes(prefixes), "trie-shared")
    lengths = written(prefixes.groupBy("conv_id").agg(F.max("depth").alias("last")), "trie-lengths")
    convs = first_owned(prefixes, shared, lengths)
    total = lengths.count()

    # where conversations end: at a node of their own, or else at that of the owner of their whole length
    end_owner = F.when(F.col("first") > F.col("last"), F.col("up")).otherwise(F.col("conv_id"))
    ends = ends_hashed(convs.select(end_owner.alias("owner"), F.col("last").alias("depth"), "conv_id"))
    chains = convs.where("first <= last")

    # nodes are the owned prefixes
    nodes = prefixes.join(chains.select("conv_id", "first", "last", "up"), "conv_id").where("depth >= first")
    nodes = nodes.join(shared.select(*DIGEST, "n_convs"), list(DIGEST), "left")
    n_convs = F.when(F.col("depth") == 0, F.lit(total)).otherwise(F.coalesce("n_convs", F.lit(1))).cast("long")
    nodes = nodes.withColumn("n_convs", n_convs).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    nodes = written(nodes.drop("s1", "s2", "words"), "trie-nodes")

    # chains' own sums, then those of all that hangs below
    hanging = chains.where("up IS NOT NULL").select("conv_id", "up", (F.col("first") - 1).alias("at"))
    tips = hanging.select(F.col("up").alias("conv_id"), F.col("at").alias("last")).distinct()
    leaf = chains.join(tips.withColumn("inner", F.lit(True)), ["conv_id", "last"], "left")
    leaf = leaf.select("conv_id", "up", F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaves"))
    leaf = written(leaf.join(nodes.groupBy("conv_id").agg(F.sum("own").alias("saved")), "conv_id"), "trie-leaves")
    sums = _summed_up(leaf)
    hung = hanging.join(sums, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth"))
    hung = hung.agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))

    zero = F.lit(0).cast("long")
    nodes = nodes.join(hung, ["conv_id", "depth"], "left").join(leaf.select("conv_id", "leaves"), "conv_id")
    nodes = nodes.select(
        "conv_id", "piece", "depth", "first", "up", "n_convs",
        (F.coalesce("hung", zero) + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"),
        # the chain's own leaf counts where it is, at the end
        (F.coalesce("l", zero) + F.when(F.col("depth") == F.col("last"), F.col("leaves")).otherwise(0)).alias("tips"),
        (F.coalesce("s", zero) + F.col("own")).alias("kept"),
    )
    nodes = written(nodes, "trie-children")
    nodes = _running(nodes, ["depth"], {"n_leaves": F.col("tips"), "saved_tokens": F.col("kept")}, falling=True)
    nodes = nodes.join(ends.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("up"))
    return nodes.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
