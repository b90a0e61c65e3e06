"""The analytic tables and the engine's views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64
#: Rows of a task where a table is dealt by a key.
TASK_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, item_key, t, grp, vec): ten samples an item, eight seconds apart."""
    at = F.col("vec_id")
    return table(spark, folder, "embeddings").select("vec_id", F.floor(at / 10).cast("long").alias("item_key"), ((at % 10) * 8).cast("double").alias("t"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("vec"))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def series(spark: SparkSession, folder: str) -> DataFrame:
    """(item_key, t, event_id, score): the events of a user as a score over time."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("item_key"), seconds(F.col("ts")).alias("t"), "event_id", F.col("value").alias("score"))


def markers(spark: SparkSession, folder: str, kind: str = "purchase") -> DataFrame:
    """(marker_id, item_key, start, end, title): point markers, their end half an hour later on even ids."""
    e = table(spark, folder, "events").where(F.col("event_type") == kind)
    t = seconds(F.col("ts"))
    return e.select(F.col("event_id").alias("marker_id"), F.col("user_id").alias("item_key"), t.alias("start"), F.when(F.col("event_id") % 2 == 0, t + 1800.0).alias("end"), F.format_string("%s %.3f", "event_type", "value").alias("title"))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, item_key, t, label, profile): judgements under the profiles quality and toxic."""
    rows = table(spark, folder, "labels")
    both = rows.select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("profile", "label"))
    d = F.col("doc_id")
    return both.select(d.alias("seq"), F.floor(d / 10).cast("long").alias("item_key"), ((d % 10) * 8).cast("double").alias("t"), "label", "profile")


def by_item(spark: SparkSession, folder: str, rows: DataFrame, key: str) -> DataFrame:
    """Order lines or orders dealt by order, into as many parts as all order lines need, so that tasks stay of one size and joins by item move nothing."""
    lines = table(spark, folder, "lineitem").count()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-lines // TASK_ROWS)), key)


def bridge(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, item_key): suppliers as entities of items, through order lines."""
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("item_key"))
    return by_item(spark, folder, lines, "item_key").distinct()
