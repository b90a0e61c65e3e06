"""A paged catalog service as a data source of Spark, in batch and as a stream.

    spark.dataSource.register(CatalogSource)
    spark.read.format("catalog").option("client", "heliograph.sources.catalog_source:HttpClient") \\
        .option("address", "http://host/items").load().where("path LIKE '/films/%'")

Every partition is a run of pages, fetched by the task that reads it. Conditions on path, tags and the time of the
last change that the service can answer are pushed to it (with ``spark.sql.python.filterPushdown.enabled``), so pages
without a match are not fetched. As a stream the source follows a catalog that grows in the order of ids; its
offset is the number of items seen.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass
from importlib import import_module
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition,
    StringStartsWith,
)

from .stores import patient

ITEM = "id string, title string, path string, duration double, tag string, updated double"
COLUMNS = tuple(f.split()[0] for f in ITEM.split(", "))
#: Pages of one partition of a batch read, unless there are more than ``MOST_PARTITIONS`` such runs.
RUN, MOST_PARTITIONS = 1, 512


@dataclass(frozen=True)
class Asked:
    """What the service filters by; None is no condition."""

    prefix: str | None = None
    tag: str | None = None
    since: float | None = None


class Client(Protocol):
    """A catalog in the order of ids: how many items match, and page ``n`` (from 1) of ``size`` of them, as dicts."""

    def count(self, asked: Asked) -> int: ...

    def page(self, n: int, size: int, asked: Asked) -> list[dict]: ...


class HttpClient:
    """POSTs {page, size, prefix, tag, since} as JSON and reads {count, items}; transient failures are tried again."""

    def __init__(self, options: dict[str, str]):
        self.address, self.key = options["address"], options.get("key", "")
        self.sleeps = tuple(float(s) for s in options.get("sleeps", "1,4,10").split(",") if s)

    def _ask(self, body: dict) -> dict:
        def once() -> dict:
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
            request = urllib.request.Request(self.address, json.dumps(body).encode(), headers)
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429:
                    raise
                raise ConnectionError(f"HTTP {e.code}") from e
            except urllib.error.URLError as e:
                raise ConnectionError(str(e.reason)) from e

        return patient(once, self.sleeps)

    def count(self, asked: Asked) -> int:
        return int(self._ask({"page": 1, "size": 0} | asdict(asked))["count"])

    def page(self, n: int, size: int, asked: Asked) -> list[dict]:
        return self._ask({"page": n, "size": size} | asdict(asked))["items"]


def client_of(options: dict[str, str]) -> Client:
    module, _, name = options.get("client", f"{__name__}:HttpClient").partition(":")
    return getattr(import_module(module), name)(dict(options))


@dataclass
class Pages(InputPartition):
    """Items ``first`` to ``end`` (not included) of those that match."""

    first: int
    end: int


def _rows(options: dict[str, str], size: int, part: Pages, asked: Asked) -> Iterator[tuple]:
    """One page in memory at a time."""
    client, at = client_of(options), part.first
    while at < part.end:
        page = client.page(at // size + 1, size, asked)
        found = page[at % size : at % size + part.end - at]
        if not found:  # the catalog has shrunk meanwhile
            return
        for item in found:
            yield tuple(item.get(c) for c in COLUMNS)
        at += len(found)
        if len(page) < size:
            return


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.size, self.asked = options, int(options.get("pagesize", 100)), Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes one condition of each kind that the service knows; the others are left to Spark."""
        took: dict[str, object] = {}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if isinstance(f, StringStartsWith) and name == "path" and "prefix" not in took:
                took["prefix"] = f.value
            elif isinstance(f, EqualTo) and name == "tag" and "tag" not in took:
                took["tag"] = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "updated":
                took["since"] = max(float(f.value), took.get("since", float(f.value)))
                if isinstance(f, GreaterThan):  # the service includes the time itself
                    yield f
            else:
                yield f
        self.asked = Asked(**took)

    def partitions(self) -> Sequence[InputPartition]:
        count = client_of(self.options).count(self.asked)
        pages = -(-count // self.size)
        run = max(RUN, -(-pages // MOST_PARTITIONS)) * self.size
        return [Pages(at, min(at + run, count)) for at in range(0, count, run)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.options, self.size, partition, self.asked)


class CatalogStreamReader(DataSourceStreamReader):
    """Items in the order of ids; what is added has larger ids. Changes of items seen before are not seen."""

    def __init__(self, options: dict[str, str]):
        self.options, self.size = options, int(options.get("pagesize", 100))

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        return {"seen": client_of(self.options).count(Asked())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = start["seen"], end["seen"]
        run = max(RUN, -(-(last - first) // self.size // MOST_PARTITIONS)) * self.size
        cuts = [first, *range(first - first % run + run, last, run), last]
        return [Pages(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.options, self.size, partition, Asked())


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(dict(self.options))

    def streamReader(self, schema) -> CatalogStreamReader:
        return CatalogStreamReader(dict(self.options))


def catalog(spark: SparkSession, address: str, page_size: int = 100, stream: bool = False, **options: str) -> DataFrame:
    """The catalog at an address; conditions on it reach the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)
    start = spark.readStream if stream else spark.read
    return start.format("catalog").options(address=address, pagesize=str(page_size), **options).load()
