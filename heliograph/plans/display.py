"""Queries of what a screen shows: heat strips, bands, stars, name filters, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics
from ..sources.tables import samples, series, table
from .registry import ORACLES, query
from .search import preferred

CHANNELS = " || ',' || ".join(f"floor({a} + {b - a} * heat + 0.5)::INT" for a, b in zip(scalars.COLD, scalars.HOT, strict=True))


@query(
    f"""
    WITH x AS (
        SELECT event_id, item_key, t, lead(t) OVER (PARTITION BY item_key ORDER BY t, event_id) AS until,
            count(*) OVER (PARTITION BY item_key) AS n, min(score) OVER (PARTITION BY item_key) AS lo,
            max(score) OVER (PARTITION BY item_key) AS hi, score
        FROM e
    ), h AS (
        SELECT event_id, item_key, t, until, (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END AS heat
        FROM x WHERE n > 1
    )
    SELECT event_id, item_key, round(t, 3) AS t, round(until, 3) AS until, round(heat, 4) AS heat,
        'rgb(' || {CHANNELS} || ')' AS color
    FROM h
    """,
    "e",
)
def heat_strip(spark, folder):
    strip = metrics.heat_strip(series(spark, folder), "event_id")
    rounded = [F.round("t", 3).alias("t"), F.round("until", 3).alias("until"), F.round("heat", 4).alias("heat")]
    return strip.select("event_id", "item_key", *rounded, "color")


LEVELS = list(metrics.LEVELS)
SHARES = [pct / 100 for pct in LEVELS]


@query(
    f"""
    WITH c AS (SELECT unnest({LEVELS}) AS pct, unnest(quantile_cont(score, {SHARES})) AS cutoff FROM p)
    SELECT vec_id, coalesce('top' || (SELECT max(pct) FROM c WHERE p.score >= cutoff)::VARCHAR, 'low') AS band FROM p
    """,
    "p",
)
def score_band_class(spark, folder):
    scores = preferred(spark, folder)
    return metrics.band_class(scores, metrics.percentiles(scores)).select("vec_id", "band")


@query(
    f"""
    WITH c AS ({ORACLES["metrics_cdf"]}),
    r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN cutoff <= 0.1 THEN -step ELSE 1 END, step) AS n FROM c)
    SELECT cutoff, moments, items,
        floor((1 - moments::DOUBLE / (SELECT max(moments) FROM c)) * 100 + 0.5)::INT AS percentile
    FROM r WHERE n = 1
    """
)
def cdf_percentile(spark, folder):
    """A threshold read off the survival curve."""
    row = metrics.at_cut(metrics.survival(preferred(spark, folder)), 0.1)
    return row.select(F.round("cutoff", 6).alias("cutoff"), "moments", "items", "percentile")


@query("SELECT p_partkey, least(5, floor(p_size * 2 / 20.0::DOUBLE + 0.5))::INT AS stars FROM part")
def star_ratings(spark, folder):
    return table(spark, folder, "part").select("p_partkey", scalars.stars(F.col("p_size") * 2).alias("stars"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'omer#0000000')")
def name_filter(spark, folder):
    return table(spark, folder, "customer").where(scalars.has_name(F.col("c_name"), " oMer#0000000 ")).select("c_custkey", "c_name")


@query("SELECT vec_id, printf('/items/%d/stream?start=%.3f', item_key, t) AS address FROM s", "s")
def stream_addresses(spark, folder):
    address = scalars.link("/items/", F.col("item_key"), F.lit("stream"), start=F.col("t"))
    return samples(spark, folder).select("vec_id", address.alias("address"))
