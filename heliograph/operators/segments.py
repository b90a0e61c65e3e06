"""From per-item score series to time segments: normalise, smooth, hysteresis, merge, drop, split, pad.

Series are (item_key, t, score). Windows run per item; the merge of neighbouring segments is a fold over
an item's segments, of which there are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_item():
    return W.partitionBy("item_key")


def order_of(series: DataFrame):
    """Order within an item: by time, then by event_id if there is one."""
    return by_item().orderBy(*[c for c in ("t", "event_id") if c in series.columns])


def zscore(series: DataFrame, value: str = "score", into: str = "z") -> DataFrame:
    """(x - mean) / population deviation per item; 0 where the deviation is below 1e-8.

    Sums run in order of time: a smoothed value that is zero but for rounding stands on one side of a threshold for good,
    and not on that which the order of a shuffle gives it.
    """
    whole = order_of(series).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mean, dev = F.avg(value).over(whole), F.stddev_pop(value).over(whole)
    return series.withColumn(into, F.when(dev < 1e-8, 0.0).otherwise((F.col(value) - mean) / dev))


def smooth(series: DataFrame, window: int, value: str = "score", into: str = "smooth") -> DataFrame:
    """Centred moving average with reflected edges; windows wider than the series shrink to it, even ones lean left.

    Rows near an edge are doubled at their mirrored place, so each average is a plain sum of neighbours.
    """
    if window <= 1:
        return series.withColumn(into, F.col(value))
    kept = series.columns
    placed = series.withColumn("_i", F.row_number().over(order_of(series)) - 1).withColumn("_n", F.count(F.lit(1)).over(by_item()))
    placed = placed.withColumn("_w", F.least(F.lit(window), F.col("_n"))).withColumn("_l", F.floor(F.col("_w") / 2).cast("int"))
    i, n, left = F.col("_i"), F.col("_n"), F.col("_l")
    right = F.col("_w") - 1 - left
    mirrored = F.filter(F.array(i, F.when(i.between(1, left), -i), F.when((n - 1 - i).between(1, right), 2 * (n - 1) - i)), lambda x: x.isNotNull())
    wide = placed.withColumn("_at", F.explode(mirrored))
    along = W.partitionBy("item_key").orderBy("_at")
    terms = []
    for k in range(-(window // 2), window - window // 2):
        x = F.lag(value, -k).over(along) if k < 0 else F.lead(value, k).over(along)
        terms.append(F.when((F.lit(k) >= -left) & (F.lit(k) <= right), x).otherwise(0.0))
    return wide.withColumn(into, reduce(Column.__add__, terms) / F.col("_w")).where("_at = _i").select(*kept, into)


def hysteresis(series: DataFrame, high: float, low: float | None = None, value: str = "score") -> DataFrame:
    """Adds ``active``: on from a value >= high, off from a value < low; NaN changes nothing."""
    low = high if low is None else low
    if low > high:
        raise ValueError("low must not exceed high")
    x = F.col(value)
    switch = F.when(F.isnan(x), None).when(x >= high, 1).when(x < low, 0)
    state = F.last(switch, ignorenulls=True).over(order_of(series).rowsBetween(W.unboundedPreceding, 0))
    return series.withColumn("active", F.coalesce(state, F.lit(0)))


def runs(series: DataFrame, value: str = "score") -> DataFrame:
    """(item_key, start, end, peak, mean, n): maximal runs of active samples."""
    order = order_of(series)
    within = W.partitionBy("item_key", "active").orderBy(*[c for c in ("t", "event_id") if c in series.columns])
    island = F.row_number().over(order) - F.row_number().over(within)
    on = series.withColumn("_island", island).where("active = 1")
    out = on.groupBy("item_key", "_island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max(value).alias("peak"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.drop("_island")


def _fold(segments: DataFrame) -> DataFrame:
    """Joins the segments of each (item_key, _grp) in order; means are weighted by spans, gaps included once joined."""
    seg = F.col("segs")
    first = F.element_at(seg, 1)

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["end"] - acc["start"], x["end"] - x["start"]
        mean = F.when(a + b > 0, (acc["mean"] * a + x["mean"] * b) / (a + b)).otherwise((acc["mean"] + x["mean"]) / 2)
        return F.struct(acc["start"].alias("start"), F.greatest(acc["end"], x["end"]).alias("end"), F.greatest(acc["peak"], x["peak"]).alias("peak"), mean.alias("mean"))

    grouped = segments.groupBy("item_key", "_grp").agg(F.sort_array(F.collect_list(F.struct("start", "end", "peak", "mean"))).alias("segs"))
    return grouped.select("item_key", F.aggregate(F.slice(seg, F.lit(2), F.size(seg)), first, step).alias("s")).select("item_key", "s.*")


def merge(segments: DataFrame, gap: float) -> DataFrame:
    """Joins neighbours at most ``gap`` apart."""
    order = by_item().orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") - reached <= gap, 0).otherwise(1)
    marked = segments.withColumn("_new", new)
    return _fold(marked.withColumn("_grp", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))))


def split(segments: DataFrame, longest: float) -> DataFrame:
    """Cuts longer segments into pieces of ``longest`` from the start; pieces keep peak and mean."""
    count = F.greatest(F.ceil((F.col("end") - F.col("start")) / longest).cast("int"), F.lit(1))
    cut = segments.withColumn("_k", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("start") + F.col("_k") * longest
    return cut.select("item_key", start.alias("start"), F.least(start + longest, F.col("end")).alias("end"), "peak", "mean")


def pad(segments: DataFrame, series: DataFrame, by: float) -> DataFrame:
    """Widens both ends within the item's times, then joins what touches."""
    ends = series.groupBy("item_key").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    wide = segments.join(ends, "item_key").select("item_key", F.greatest(F.col("start") - by, F.col("_lo")).alias("start"), F.least(F.col("end") + by, F.col("_hi")).alias("end"), "peak", "mean")
    return merge(wide, 0.0)


def extract(series: DataFrame, high: float, low: float | None = None, min_duration: float = 3.0, merge_gap: float = 2.0, max_duration: float | None = None, padding: float = 0.0, value: str = "score") -> DataFrame:
    """(item_key, start, end, peak, mean, duration, midpoint): merge first, then drop short ones, split, pad."""
    segs = merge(runs(hysteresis(series, high, low, value), value), merge_gap).where(F.col("end") - F.col("start") >= min_duration)
    if max_duration:
        segs = split(segs, max_duration)
    if padding > 0:
        segs = pad(segs, series, padding)
    return segs.withColumn("duration", F.col("end") - F.col("start")).withColumn("midpoint", (F.col("start") + F.col("end")) / 2)


#: Seconds of a stretch of time, and stretches that an interval may cover before it is joined by its item alone.
STRETCH, MOST_STRETCHES = 600.0, 64


def without_existing(segments: DataFrame, markers: DataFrame) -> DataFrame:
    """Segments that no marker (item_key, start, end) of the item overlaps; ends count, a point marker ends where it starts."""
    spans = ["item_key", "start", "end"]
    own = segments.select(*spans).distinct()
    m = markers.select("item_key", F.col("start").alias("_ms"), F.coalesce("end", "start").alias("_me"))
    m = m.where("_ms IS NOT NULL AND _me >= _ms")

    def cut(rows: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
        """Rows of at most MOST_STRETCHES stretches of time, once for each of them, and the longer ones."""
        first, last = F.floor(F.col(start) / STRETCH), F.floor(F.col(end) / STRETCH)
        long = last - first >= MOST_STRETCHES
        return rows.where(~long).withColumn("_b", F.explode(F.sequence(first, last))), rows.where(long)

    (own_cut, own_long), (m_cut, m_long) = cut(own.where("end >= start"), "start", "end"), cut(m, "_ms", "_me")
    met = own_cut.join(m_cut, ["item_key", "_b"]).unionByName(own.join(m_long, "item_key"), allowMissingColumns=True)
    met = met.unionByName(own_long.join(m, "item_key"), allowMissingColumns=True)
    hit = met.where((F.col("start") <= F.col("_me")) & (F.col("end") >= F.col("_ms"))).select(*spans).distinct()
    return segments.join(hit, spans, "left_anti")
