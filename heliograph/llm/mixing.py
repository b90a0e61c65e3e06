"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies: its source's target over the
source's size. Documents of a source stand in one order (by size class, then by a hash of the id); the
running sum of expected copies plus one offset per source crosses an integer boundary as often as the
document is emitted. Neighbours in that order are of like size, so the words taken stay within about
one document of the target.

The running sum needs a document's rank in its source. A source may hold a third of all rows, so the
rank is made in levels: counts per (source, size class) and per hash slot in such a class are summed up in
order, and rows are only ranked inside a slot. No window ever spans a source's documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import word_count, written

SLOTS = 1024


def _digest(*parts: Column) -> Column:
    """32 bits of an md5 over the parts, null ones left out, as a double."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of (has, source, source_size): weights by code point of the source, null last, repeating.

    Shares of the whole size by weight stop at ``cap`` times a source's size; the excess is dealt again
    by weight until none is above. That is min(cap * size, level * weight) for one level: sorted by
    cap * size / weight, a source is capped if its ratio is below the level that those before it leave.
    Sizes of 0 get target 0. The table has a row per source.
    """
    turn = F.row_number().over(W.orderBy(F.desc("has"), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.desc("has"), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    spare = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("capped", F.col("most") / F.col("weight") <= left / spare)
    level = (F.sum("source_size").over(whole) - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(whole)) / F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(whole)
    return rows.select("has", "source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def copies(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Adds source_size, target and copies to rows that have ``mix_id``, ``mix_source`` and ``mix_size``.

    ``rows`` is read twice and should be a written table. A null source is a source of its own; null ids
    and repeated rows are ordered with the rest, each row being sampled for itself. An empty table gives
    an empty one.
    """
    hashed = _digest(F.lit(seed), F.col("mix_id"))
    keyed = rows.withColumns({
        "has": F.col("mix_source").isNotNull(), "source": F.coalesce("mix_source", F.lit("")), "mix_hash": hashed,
        "grade": F.floor(F.log2(F.col("mix_size") + F.lit(1.0)) * 8).cast("int"), "slot": F.floor(hashed * SLOTS / 2**32).cast("int"),
    })
    key = ["has", "source", "grade", "slot"]
    slots = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("part_size"))
    per_source = slots.groupBy("has", "source").agg(F.sum("part_size").alias("source_size"))
    by_grade = W.partitionBy("has", "source").orderBy("grade").rowsBetween(W.unboundedPreceding, -1)
    grades = slots.groupBy("has", "source", "grade").agg(F.sum("n").alias("n")).select("has", "source", "grade", F.coalesce(F.sum("n").over(by_grade), F.lit(0)).alias("lower"))
    by_slot = W.partitionBy("has", "source", "grade").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slots.withColumn("before", F.coalesce(F.sum("n").over(by_slot), F.lit(0))).select(*key, "before").join(grades, ["has", "source", "grade"])
    offsets = offsets.join(source_targets(per_source, weights, cap), ["has", "source"]).withColumn("before", F.col("before") + F.col("lower"))
    in_slot = W.partitionBy(*key).orderBy("mix_hash", "mix_id", "mix_size")
    ranked = keyed.join(offsets, key).withColumn("place", F.col("before") + F.row_number().over(in_slot))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = _digest(F.lit(seed), F.when(F.col("has"), F.col("source"))) / (2**32 + 2**16)
    crossed = F.floor(F.col("place") * rate + start) - F.floor((F.col("place") - 1) * rate + start)
    return ranked.withColumn("copies", F.least(crossed, F.ceil(F.lit(float(cap)))).cast("long")).drop("has", "source", "mix_hash", "grade", "slot", "before", "lower", "place")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``; other columns are not looked at.

    Null texts have size 0 and are never above their share.
    """
    narrow = docs.select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), word_count(F.col(text_col)).alias("mix_size"))
    out = copies(written(narrow, "mix-sizes"), weights, cap)
    return out.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with the columns it came with."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), word_count(F.col(text_col)).alias("mix_size"))
    out = copies(written(kept, "mix-rows"), weights, cap).where("copies > 0")
    again = out.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"))
    return again.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns])
