"""Distribution of a score over all samples and over items' best samples (item_key, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

LEVELS = (50, 75, 90, 95, 99)


#: Relative accuracy, as one part in so many, of the sketch that says where a quantile lies.
ACCURACY = 10_000


def quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): exact quantiles of a column, interpolated between neighbours; nulls do not count.

    A sketch of all values bounds each quantile from both sides. A second pass counts what lies below the bounds,
    and puts in order only what lies between them: some 8 / ACCURACY of the rows, or all if they are no more than
    ACCURACY. Rows of one value are counted, not kept. Values and bounds are written: both may come out otherwise when
    computed again, sums by their last digits and a sketch by the order it is merged in, and then the counts below a bound
    and above it would not fit together.
    """
    x = written(rows.select(F.col(column).cast("double").alias("x")).where("x is not null"), "quantiles")
    margin, last = 4 / ACCURACY, len(shares) - 1
    low, high = ([min(1.0, max(0.0, float(s) + d)) for s in shares] for d in (-margin, margin))
    ends = x.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.percentile_approx("x", low, ACCURACY).alias("los"), F.percentile_approx("x", high, ACCURACY).alias("his"),
    )

    def bound(whole: str, sketched: str) -> Column:
        return F.when(F.col("n") <= ACCURACY, F.array_repeat(whole, len(shares))).otherwise(F.col(sketched)).alias(sketched)

    ends = written(ends.select("n", bound("lo", "los"), bound("hi", "his")), "quantiles")
    placed = x.crossJoin(F.broadcast(ends))
    within = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda j: (F.col("x") >= F.col("los")[j]) & (F.col("x") <= F.col("his")[j]))
    hits = placed.select("x", F.explode(within).alias("j")).groupBy("j", "x").agg(F.count(F.lit(1)).alias("m"))
    hits = hits.withColumn("upto", F.sum("m").over(W.partitionBy("j").orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    below = placed.agg(F.max("n").alias("n"), *[F.count_if(F.col("x") < F.col("los")[j]).alias(f"b{j}") for j in range(last + 1)])
    asked = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(s)).alias("share"), F.col(f"b{j}").alias("before")) for j, s in enumerate(shares)])
    asked = below.where("n > 0").select("n", F.explode(asked).alias("a")).select("n", "a.*")
    asked = asked.withColumn("at", F.col("share") * (F.col("n") - 1))
    asked = asked.withColumn("k", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).drop("n")
    rank = F.col("k") - F.col("before")
    found = hits.join(F.broadcast(asked), "j").where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("m")))
    part = F.max("at") - F.floor(F.max("at"))
    return found.groupBy("share").agg((F.min("x") + (F.max("x") - F.min("x")) * part).alias("value"))


def percentiles(scores: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(pct, cutoff): exact, interpolated between neighbours."""
    return quantiles(scores, "score", [p / 100 for p in levels]).select(F.round(F.col("share") * 100).cast("int").alias("pct"), F.col("value").alias("cutoff"))


def counts_above(scores: DataFrame, cuts: DataFrame, cut: str = "cutoff") -> DataFrame:
    """``cuts`` (a few rows) with the samples, and the items by their best sample, at or above each cut.

    Every sample meets every cut in the partial sums only.
    """
    best = scores.groupBy("item_key").agg(F.max("score").alias("score"))
    keys = cuts.columns
    moments = scores.select("score").crossJoin(F.broadcast(cuts)).groupBy(*keys).agg(F.count_if(F.col("score") >= F.col(cut)).alias("moments"))
    items = best.select("score").crossJoin(F.broadcast(cuts)).groupBy(*keys).agg(F.count_if(F.col("score") >= F.col(cut)).alias("items"))
    return moments.join(items, keys)


def bands(scores: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(pct, cutoff, moments, items); cut-offs are rounded for show only."""
    scores = written(scores.select("item_key", "score"), "scores")  # read four times
    out = counts_above(scores, percentiles(scores, levels))
    return out.select("pct", F.round("cutoff", 4).alias("cutoff"), "moments", "items")


def histogram(scores: DataFrame, bins: int = 24) -> DataFrame:
    """(bin, lo, hi, n) of equal widths; the maximum is in the last bin; a single value gets a range of one around it."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1))
    counts = scores.select("score").crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def survival(scores: DataFrame, steps: int = 100) -> DataFrame:
    """(step, cutoff, moments, items) at steps + 1 cuts from the smallest to the largest score; one cut if they are equal."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    last = F.when(F.col("lo") == F.col("hi"), 0).otherwise(steps)
    cut = F.when(F.col("step") == steps, F.col("hi")).otherwise(F.col("lo") + F.col("step") * (F.col("hi") - F.col("lo")) / steps)
    cuts = ends.withColumn("step", F.explode(F.sequence(F.lit(0), last))).select("step", cut.alias("cutoff"))
    return counts_above(scores, cuts)


def threshold_report(scores: DataFrame, value: float) -> DataFrame:
    """One row: samples and items at or above a value, and the percentage of samples below it."""
    best = scores.groupBy("item_key").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= value).alias("above"), F.count_if(F.col("score") < value).alias("below"))
    return best.agg(F.lit(value).alias("value"), F.sum("above").alias("moments"), F.count_if(F.col("best") >= value).alias("items"), F.round(F.sum("below") / F.sum("n") * 100, 1).alias("percentile"))


def spread(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min("score").alias("low"), F.avg("score").alias("mean"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n"))


def calibration(scores: DataFrame, high: float, levels: Sequence[int] = (50, 90, 97, 99)) -> DataFrame:
    """One row: percentiles p50... and the part of samples at or above ``high``."""
    cuts = percentiles(scores, levels).agg(*[F.max(F.when(F.col("pct") == p, F.col("cutoff"))).alias(f"p{p}") for p in levels])
    return cuts.crossJoin(F.broadcast(scores.agg(F.avg((F.col("score") >= high).cast("double")).alias("above"))))


def at_cut(cdf: DataFrame, value: float) -> DataFrame:
    """One row of ``survival`` with the percentage of samples below its cut: the last cut up to a value, else the first."""
    ends = cdf.agg(
        F.max(F.when(F.col("cutoff") <= value, F.struct("cutoff", "moments", "items"))).alias("at"),
        F.min(F.struct("cutoff", "moments", "items")).alias("first"),
    )
    row = ends.select(F.coalesce("at", "first").alias("at"), F.col("first.moments").alias("all")).where("at is not null")
    below = F.floor((1 - F.col("at.moments") / F.greatest(F.col("all"), F.lit(1))) * 100 + 0.5)
    return row.select("at.cutoff", "at.moments", "at.items", below.cast("int").alias("percentile"))


def band_class(scores: DataFrame, cuts: DataFrame, score: str = "score") -> DataFrame:
    """``scores`` with ``band``: 'top' and the percentile of the highest band reached, else 'low'; '' if there are no bands.

    ``cuts`` (pct, cutoff) are a few rows and travel as one array. A null score reaches no band.
    """
    held = cuts.agg(F.sort_array(F.collect_list(F.struct("cutoff", "pct")), asc=False).alias("_cuts"))
    reached = F.try_element_at(F.filter("_cuts", lambda c: F.col(score) >= c["cutoff"]), F.lit(1))
    name = F.when(F.size("_cuts") == 0, "").otherwise(F.coalesce(F.concat(F.lit("top"), reached["pct"]), F.lit("low")))
    return scores.crossJoin(F.broadcast(held)).withColumn("band", name).drop("_cuts")


def heat_strip(scores: DataFrame, tie: str) -> DataFrame:
    """``scores`` (item_key, t, score) with ``until``, the item's next time, and ``heat`` from 0 to 1 between its extremes.

    Equal times go by ``tie``; the last ``until`` of an item is null, where its end is not known. Items of fewer than two
    samples have no strip. Equal scores are all cold. The extremes are a grouped aggregate; times are ordered per item.
    """
    from ..functions.scalars import heat_color

    ends = scores.groupBy("item_key").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    both = scores.join(ends.where("_n > 1"), "item_key")
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    heat = both.withColumn("until", F.lead("t").over(W.partitionBy("item_key").orderBy("t", tie))).withColumn("heat", (F.col("score") - F.col("_lo")) / span)
    return heat.withColumn("color", heat_color(F.col("heat"))).drop("_lo", "_hi", "_n")
