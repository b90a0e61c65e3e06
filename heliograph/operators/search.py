"""Similarity search over sample vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, minus_scaled, unit
from .places import numbered


def asof(points: DataFrame, samples: DataFrame, key: str = "item_key", point_id: str = "point_id") -> DataFrame:
    """Nearest sample in time of each point (point_id, key, at): ties go to the earlier one; keys without samples drop.

    Samples of the points' items and the points stand in one order of time, in which the last sample before and the
    next one behind are carried along; no point meets all samples of its item.
    """
    values = [c for c in samples.columns if c != key]
    asked = points.select(point_id, key, "at").where(F.col(key).isNotNull()).distinct()
    own = samples.join(asked.select(key).distinct(), key, "left_semi")
    nothing = {f: F.lit(None).cast(t) for f, t in asked.select(point_id, "at").dtypes}
    rows = own.select(key, F.col("t").alias("_time"), F.lit(0).alias("_kind"), F.struct(*values).alias("_s"), *[c.alias(f) for f, c in nothing.items()])
    marks = asked.select(key, F.col("at").alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_s"].dataType).alias("_s"), point_id, "at")
    both = rows.unionByName(marks)
    forth = W.partitionBy(key).orderBy("_time", "_kind").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(key).orderBy(F.desc("_time"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("_a", F.last("_s", ignorenulls=True).over(forth)).withColumn("_b", F.last("_s", ignorenulls=True).over(back)).where("_kind = 1")
    first = F.col("_b").isNull() | (F.col("at") - F.col("_a.t") <= F.col("_b.t") - F.col("at"))
    best = F.when(F.col("_a").isNotNull() & first, F.col("_a")).otherwise(F.col("_b"))
    return near.select(point_id, key, "at", best.alias("s")).where("s is not null").select(point_id, key, "at", "s.*")


def vector_at(samples: DataFrame, item_key, at: float) -> DataFrame:
    """One row (query): the vector of an item's sample nearest in time; the key filter reaches the scan."""
    own = samples.where(F.col("item_key") == item_key)
    return own.agg(F.min_by("vec", F.struct(F.abs(F.col("t") - at), F.col("t"))).alias("query"))


def scored(samples: DataFrame, query: DataFrame, into: str = "score") -> DataFrame:
    """Samples with their dot product with the one row of ``query``."""
    return samples.crossJoin(F.broadcast(query)).withColumn(into, dot("vec", "query")).drop("query")


def best_first(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("item_key"), F.asc("t")]


def capped(hits: DataFrame, per: str, most: int, score: str = "score") -> DataFrame:
    """The best ``most`` rows of each ``per`` (null is one group); ranks prune before the shuffle."""
    rank = F.row_number().over(W.partitionBy(per).orderBy(*best_first(score)))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def search(samples: DataFrame, query: DataFrame, top_k: int | None = 60, per_item: int | None = None, per: str = "item_key", exclude_key=None, min_score: float | None = None) -> DataFrame:
    """Exact search: score, exclude, floor, cap per item, then the best ``top_k`` (all, if None)."""
    rows = samples if exclude_key is None else samples.where(F.col("item_key") != exclude_key)
    hits = scored(rows, query)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    if per_item is not None:
        hits = capped(hits, per, per_item)
    return hits if top_k is None else hits.orderBy(*best_first()).limit(top_k)


def search_by_sample(samples: DataFrame, item_key, at: float, top_k: int | None = 60, per_item: int = 3, min_score: float | None = None) -> DataFrame:
    return search(samples, vector_at(samples, item_key, at), top_k, per_item, exclude_key=item_key, min_score=min_score)


def posneg_query(terms: DataFrame, positive: str, negative: str | None, weight: float = 1.0) -> DataFrame:
    """One row (query) from (term, vec): unit(positive - weight * unit(negative))."""
    pos = terms.where(F.col("term") == positive).select(unit(F.col("vec")).alias("query"))
    if not negative:
        return pos
    neg = terms.where(F.col("term") == negative).select(unit(F.col("vec")).alias("neg"))
    return pos.crossJoin(F.broadcast(neg)).select(unit(minus_scaled(F.col("query"), F.col("neg"), weight)).alias("query"))


def duplicates(samples: DataFrame, item_key, at: float, floor: float = 0.9, top_k: int = 40) -> DataFrame:
    return search(samples, vector_at(samples, item_key, at), top_k, 1, exclude_key=item_key, min_score=floor)


def timeline(samples: DataFrame, item_key, query: DataFrame) -> DataFrame:
    own = scored(samples.where(F.col("item_key") == item_key), query)
    return own.select("item_key", F.round("t", 2).alias("t"), F.round("score", 4).alias("score"))


MOST_REFERENCES = 10_000


def similarity(samples: DataFrame, references: DataFrame, reduce: str = "max") -> DataFrame:
    """Each sample's largest or mean dot product with a small set of references, which is sent to all samples as one array.

    A set of more than MOST_REFERENCES is an error; see ``similarity_blocked``.
    """
    if references.limit(MOST_REFERENCES + 1).count() > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    whole = references.agg(F.collect_list("vec").alias("_refs"))
    each = F.transform("_refs", lambda r: dot(F.col("vec"), r))
    folded = F.array_max(each) if reduce == "max" else F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / F.size("_refs")
    keys = [c for c in samples.columns if c != "vec"]
    return samples.crossJoin(F.broadcast(whole)).where(F.size("_refs") > 0).select(*keys, folded.alias("score"))


def similarity_blocked(samples: DataFrame, references: DataFrame, reduce: str = "max") -> DataFrame:
    """As ``similarity`` for reference sets of up to some thousands: one matrix product an Arrow batch.

    The set is collected; more than MOST_REFERENCES are an error.
    """
    import numpy as np

    matrix = np.array([r[0] for r in references.select("vec").limit(MOST_REFERENCES + 1).collect()], float)
    if len(matrix) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    at = samples.columns.index("vec")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ matrix.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x.max(axis=1) if reduce == "max" else x.mean(axis=1))], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in samples.dtypes)
    return samples.mapInArrow(run, f"{fields}, score double")


MOST_TERMS = 10_000


def top_terms(rows: DataFrame, vocabulary: DataFrame, keys: list[str], k: int, floor: float | None = None) -> DataFrame:
    """The k best vocabulary terms of each row's vector (or, over several rows of a key, by their largest score).

    A vocabulary of up to MOST_TERMS terms goes to all rows as one array, and a row leaves with its own k best: what is
    among the best of a key is among the best of the row that its largest score is from. A larger one is joined.
    """
    if vocabulary.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        pairs = rows.crossJoin(vocabulary.select("term", F.col("vec").alias("term_vec")))
        best = pairs.select(*keys, "term", dot("vec", "term_vec").alias("score"))
    else:
        whole = vocabulary.agg(F.collect_list(F.struct("term", "vec")).alias("_terms"))
        each = F.transform("_terms", lambda t: F.struct((-dot(F.col("vec"), t["vec"])).alias("down"), t["term"].alias("term")))
        own = rows.crossJoin(F.broadcast(whole)).select(*keys, F.explode(F.slice(F.array_sort(each), 1, k)).alias("_t"))
        best = own.select(*keys, F.col("_t.term").alias("term"), (-F.col("_t.down")).alias("score"))
    best = best.groupBy(*keys, "term").agg(F.max("score").alias("score"))
    if floor is not None:
        best = best.where(F.col("score") >= floor)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "term"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def best_places(hits: DataFrame, key: str = "item_key", score: str = "score") -> DataFrame:
    """(item_key, place): items numbered from 1 by their largest score to six decimals, ties by key."""
    best = hits.groupBy(key).agg(F.round(F.max(score), 6).alias("_s"))
    return numbered(best, F.desc("_s"), key).drop("_s")


def enrich(hits: DataFrame, details: DataFrame, on: str, most: int = 300) -> DataFrame:
    """The first ``most`` hits with details joined on after the limit; missing details stay null."""
    return hits.orderBy(*best_first()).limit(most).join(details, on, "left")
