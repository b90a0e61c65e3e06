"""The folder for intermediate files, and tables kept there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; in local mode, if unset, a folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (at or "file://" + os.path.join(tempfile.gettempdir(), f"heliograph-{os.getpid()}")).rstrip("/")


def own_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/heliograph/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str, now: bool = True) -> None:
    """Delete a folder, at once or when the application's JVM ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True) if now else files.deleteOnExit(folder)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read any more."""
    for df in tables:
        delete(df.sparkSession, df.written_at)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage without relying on any executor staying alive, and what is used more than once
    is computed once. The files go with ``drop``, or else when the application's JVM ends.
    """
    spark = df.sparkSession
    path = own_folder(spark, what)
    df.write.parquet(path)
    delete(spark, path, now=False)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out
