"""What the training-data operators share: written intermediate tables, tokens, column checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return;
#: ``bytes.split()`` cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True) if now else files.deleteOnExit(folder)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_at, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage without relying on any executor staying alive, and what is used more than once
    is computed once. The files go with ``drop``, or else when the application's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/heliograph/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, False)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8."""
    return text.encode().lower().split() if text else []
