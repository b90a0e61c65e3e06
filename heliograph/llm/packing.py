"""Hierarchical residual packing of token sequences.

Each partition tokenises its documents and packs the pieces by best fit, longest first. Bins that are
nearly full are done; the others are handed up a tree of merge rounds, in which whole bins are the items
of a further best fit. Only (bin, fill) pairs travel in those rounds, never tokens. A merge task gets a
bounded number of bins: the tree stops narrowing once that number would be passed, where more merging
gains nothing.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: What a byte-level tokenizer splits text by before merging (a fixed value of that format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE whose merges stand in the order of ids; None for other tokenizers."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in spec["added_tokens"]}
    merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
    ids = [model["vocab"][x] for x in merged]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or len(merged) + 256 != sum(x not in special for x in model["vocab"]):
        return None
    return {bytes(letter[c] for c in x): i for x, i in model["vocab"].items() if x not in special}


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for a file, as little-endian 32-bit bytes.

    Where the file allows it the merges run in tiktoken, which gives the same ids several times faster;
    texts with the name of a special token go through tokenizers itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        ranks = byte_ranks(spec)
        self.fast = ranks and tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: Sequence[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, largest first: bin and offset of each size (all in 1..capacity), and the fill of each bin.

    Open bins are kept by room left, and a bit set over rooms finds the tightest one that fits.
    """
    bins, offsets, fill = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, fill


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


def cut_and_pack(capacity: int, path: str, end: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first round: a partition's (doc_id, text) into pieces with local bins."""

    def run(batches):
        from pyspark import TaskContext

        encode, width = encoder(path), 4 * capacity
        cols: tuple[list, ...] = ([], [], [], [], [])
        tokens: list[bytes] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end.to_bytes(4, "little")
                first = len(ids) % width or width
                for n, at in enumerate([0, *range(first, len(ids), width)]):
                    part = ids[at : first if n == 0 else at + width]
                    for col, x in zip(cols, (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
                    if with_ids:
                        tokens.append(part)
        if not cols[0]:
            return
        bins, offsets, fill = best_fit(cols[3], capacity)
        base = TaskContext.get().partitionId() << 32
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array([base | b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array([fill[b] for b in bins], pa.int64())]
        if with_ids:
            arrays.append(pa.array(tokens, pa.binary()))
        whole = pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    return run


def merge_round(under: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Best fit of (bin, fill) within each group of neighbouring partitions: bin, root, shift, root_fill."""

    def run(key, rows):
        rows = rows.sort_by("bin")
        ids, fills = rows.column("bin").to_pylist(), rows.column("fill").to_pylist()
        bins, shifts, fill = best_fit(fills, capacity)
        roots: dict[int, int] = {b: i for b, s, i in zip(bins, shifts, ids, strict=True) if s == 0}
        return pa.table({"bin": ids, "root": [roots[b] for b in bins], "shift": shifts, "root_fill": [fill[b] for b in bins]}, schema=pa.schema([(c, pa.int64()) for c in ("bin", "root", "shift", "root_fill")]))

    return under.withColumn("grp", F.pmod(F.shiftright("bin", 32), F.lit(groups))).groupBy("grp").applyInArrow(run, "bin long, root long, shift long, root_fill long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end: int = 0, slack: int = 8, fan_in: int = 16, most_bins: int = 100_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids as bytes).

    A document's ids get ``end`` behind them; one longer than ``capacity`` is cut into pieces of that
    length, the first one shorter if need be. Null and empty texts are the end id alone. Repeated rows
    and null ids are packed like any other row. An empty table gives an empty one. ``tokenizer`` is a
    file of the tokenizers library with a byte-level BPE that every executor can read. ``slack``: bins
    with at most so much room are not handed on.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(narrow.mapInArrow(cut_and_pack(capacity, tokenizer, end, with_ids), PIECES + ", ids binary" * with_ids), "pack-pieces")
    bins = pieces.where("place = 0").select("bin", "fill")
    under = bins.where(F.col("fill") < capacity - slack)
    count, parts = under.agg(F.count(F.lit(1)), F.countDistinct(F.shiftright("bin", 32))).first()
    groups, links = max(1, parts), None
    while groups > 1:
        fewer = max(math.ceil(groups / fan_in), math.ceil(count / most_bins))
        if fewer >= groups:
            break
        groups = fewer
        step = written(merge_round(under, groups, capacity), "pack-round")
        if links is None:
            links = step.select("bin", "root", "shift")
        else:
            up = step.select(F.col("bin").alias("mid"), F.col("root").alias("top"), F.col("shift").alias("more"))
            links = links.join(up, links.root == up.mid, "left").select("bin", F.coalesce("top", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        roots = step.where("shift = 0").select("bin", F.col("root_fill").alias("fill"))
        under = roots.where(F.col("fill") < capacity - slack)
        count = under.count()
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    if links is None:
        return pieces.withColumnsRenamed({"bin": "sequence_id", "place": "offset"}).select(*out)
    placed = pieces.join(links, "bin", "left")
    return placed.withColumns({"sequence_id": F.coalesce("root", "bin"), "offset": F.col("place") + F.coalesce("shift", F.lit(0))}).select(*out)
