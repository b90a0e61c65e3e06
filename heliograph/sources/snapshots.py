"""Versions of an index behind a manifest: readers keep the version they have, builders switch in one step."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .scratch import delete

ENTRY = "version long, path string, keys long, rows long"


class Version(NamedTuple):
    version: int
    path: str
    keys: int
    rows: int


class Manifest:
    """Numbered entries of a folder, one small JSON file each.

    An entry is made by an exclusive create, so of two writers of one number only one succeeds. A file without its
    whole line is an entry that is being written, or whose writer died: it is not there for readers.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str = ENTRY):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def add(self, number: int, **entry) -> bool:
        """Make entry ``number``; False if there is one."""
        path, files = self._at(f"{number:012d}.json")
        try:
            out = files.create(path, False)
        except Exception as e:  # a Java error; what matters is whether somebody else has made the file
            if getattr(e, "java_exception", None) is None or not files.exists(path):
                raise
            return False
        try:
            out.write(bytearray((json.dumps({"version": number} | entry) + "\n").encode()))
        finally:
            out.close()
        return True

    def numbers(self) -> list[int]:
        """Numbers that are taken, whole or not."""
        path, files = self._at("")
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def remove(self, number: int) -> None:
        path, files = self._at(f"{number:012d}.json")
        files.delete(path, False)

    def entries(self) -> DataFrame:
        """All whole entries."""
        try:
            rows = self.spark.read.schema(self.schema).json(f"{self.folder}/*.json")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], self.schema)
        return rows.where("version IS NOT NULL")


class Snapshots:
    """An index of unit vectors over a growing cache of samples, as numbered versions under ``root``.

    A version is a folder of Parquet files that never changes, laid out by item, and an entry of the manifest with
    the number of items it was made from. It can be read as soon as the entry is there, and until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, f"{self.root}/manifest")

    def versions(self) -> DataFrame:
        return self.manifest.entries()

    def current(self) -> Version | None:
        last = self.versions().orderBy(F.desc("version")).first()
        return None if last is None else Version(*last)

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, by default the current one; what is published later does not change them."""
        at = version or self.current()
        if at is None:
            raise FileNotFoundError(f"no version under {self.root}")
        return self.spark.read.parquet(at.path)

    def publish(self, samples: DataFrame, keys: int) -> Version:
        """Write a version and switch to it. Of two builders at a time both get a version; the later entry counts."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        vectors = samples.where("vec IS NOT NULL").withColumn("vec", unit(F.col("vec").cast("array<double>")))
        vectors.repartition("item_key").sortWithinPartitions("item_key", "t").write.parquet(path)
        rows = self.spark.read.parquet(path).count()
        number = max(self.manifest.numbers(), default=0) + 1
        while not self.manifest.add(number, path=path, keys=keys, rows=rows):
            number += 1
        return Version(number, path, keys, rows)

    def index(self, samples: DataFrame, refresh: bool = False) -> tuple[Version, bool]:
        """The version to search in, and whether it was built now.

        It is built if there is none or the last one is empty; with ``refresh`` also if the number of items in
        ``samples`` is no longer that of the version.
        """
        now = self.current()
        if now is not None and now.rows and not refresh:
            return now, False
        keys = samples.select("item_key").distinct().count()
        if now is not None and now.rows and keys == now.keys:
            return now, False
        return self.publish(samples, keys), True

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions, entries first; returns how many went.

        Readers of a version that goes lose its files, so ``keep`` has to cover the longest read.
        """
        old = self.versions().orderBy(F.desc("version")).offset(max(1, keep)).collect()
        for r in old:
            self.manifest.remove(r.version)
            delete(self.spark, r.path)
        return len(old)
