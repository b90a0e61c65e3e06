"""Numbers along an order of any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(rows: DataFrame, *order: Column | str, into: str = "place") -> DataFrame:
    """``rows`` with their number from 1 in an order; rows that are equal in it may stand either way.

    They are dealt into ranges, which are written and counted, and numbered inside each: no task sees more than a
    range, whatever the values are, since rows that are equal in the order are told apart as well. ``rows`` is
    computed twice, once to find the ranges.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    own = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = written(own.repartitionByRange(*keys, F.col("_row")).withColumn("_part", F.spark_partition_id()), "places")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*keys, "_row"))
    placed = dealt.withColumn("_i", inside).join(F.broadcast(sizes), "_part")
    return placed.select(*rows.columns, (F.col("_i") + F.col("_before")).alias(into))
