"""Stores: the sample cache, verdicts, failures, collections, vocabularies, images, landed catalogs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import fingerprint_key, safe_name, under_path

SAMPLES = "model string, item_key string, item_id string, path string, t double, vec array<float>, signature double"
VERDICTS = "item_key string, t double, label int, profile string, item_id string, ts double"
FAILURES = "item_key string, item_id string, path string, error string, mode string, hwaccel string, pipeline string, model string, ts double"
CATALOG = (
    "id string, title string, files array<struct<path:string,duration:double,width:int,height:int,frame_rate:double,video_codec:string,size:bigint,fingerprints:map<string,string>>>,"
    " markers array<struct<id:string,seconds:double,end_seconds:double,title:string,primary_tag:struct<id:string,name:string>>>"
)


def write_samples(samples: DataFrame, path: str) -> None:
    """Write samples by model; each model written replaces that model's former samples, atomically per job."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_samples(spark: SparkSession, path: str, model: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """Samples, pruned to a model's folder; ``items`` (item_key) restricts by semi-join. Corrupt files are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    if model is not None:
        rows = rows.where(F.col("model") == model)
    return rows if items is None else rows.join(items, "item_key", "left_semi")


#: Keys of a list that are compared in the scan itself; longer lists are joined.
LISTED = 1_000


def with_keys(rows: DataFrame, keys: Sequence, key: str = "item_key") -> DataFrame:
    """The rows with one of the keys. A short list reaches the scan as a filter, a long one is a semi-join."""
    wanted = sorted({k for k in keys if k is not None})
    if len(wanted) <= LISTED:
        return rows.where(F.col(key).isin(wanted))
    listed = rows.sparkSession.createDataFrame([(k,) for k in wanted], T.StructType([T.StructField(key, rows.schema[key].dataType)]))
    return rows.join(listed, key, "left_semi")


def sample_models(spark: SparkSession, path: str) -> list[str]:
    """Names of the models in the cache, from its folders alone."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted(unescape(n.removeprefix("model=")) for n in names if n.startswith("model="))


def unreadable(spark: SparkSession, path: str) -> int:
    """How many of the cache's files cannot be opened as Parquet; ``read_samples`` skips these."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    # a Parquet file begins with its mark, and ends with it behind the length of its footer
    mark = F.lit("PAR1")
    whole = (F.length("content") >= 12) & (F.substring("content", 1, 4).cast("string") == mark) & (F.substring("content", -4, 4).cast("string") == mark)
    return files.where(~whole).count()


PLAYLIST = "item_key string, start double, end double, duration double, title string, url string, score double"


def write_playlist(clips: DataFrame, folder: str, tag: str) -> int:
    """Clips as JSON lines under ``clips``, and (tag, count) under ``about``, written last; returns the count."""
    clips.write.mode("overwrite").json(f"{folder}/clips")
    count = clips.sparkSession.read.schema(PLAYLIST).json(f"{folder}/clips").count()
    about = clips.sparkSession.createDataFrame([(tag, count)], "tag string, count long")
    about.coalesce(1).write.mode("overwrite").json(f"{folder}/about")
    return count


def read_playlist(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The tag and the clips; an error if the clips are not as many as was said when they were written."""
    about = spark.read.schema("tag string, count long").json(f"{folder}/about").first()
    clips = spark.read.schema(PLAYLIST).json(f"{folder}/clips")
    if clips.count() != about["count"]:
        raise ValueError(f"{folder} is not whole")
    return about.tag, clips


def sample_counts(samples: DataFrame) -> DataFrame:
    """(item_key, n) from the keys alone; vectors are not read."""
    return samples.groupBy("item_key").agg(F.count(F.lit(1)).alias("n"))


def up_to_date(samples: DataFrame, signature: float) -> DataFrame:
    """Keys whose samples were taken as ``signature`` says (within 1e-6); unknown signatures are stale."""
    return samples.groupBy("item_key").agg(F.min("signature").alias("s"), F.max("signature").alias("e"), F.count("signature").alias("n"), F.count(F.lit(1)).alias("all")).where((F.col("n") == F.col("all")) & (F.abs(F.col("s") - signature) < 1e-6) & (F.abs(F.col("e") - signature) < 1e-6)).select("item_key")


def read_json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines; what cannot be read counts as empty."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term): lines of a text file, trimmed, without blank ones and comments."""
    term = F.trim("value")
    return spark.read.text(path).select(term.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#"))


def reference_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "bmp")) -> DataFrame:
    """(path, content) of the images that stand directly in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return files.select("path", "content")


def stream_frames(blobs: DataFrame, start: bytes = b"\xff\xd8", end: bytes = b"\xff\xd9") -> DataFrame:
    """(path, n, frame): pictures of a concatenated stream, cut at start and end marks; a partial tail is dropped."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, at, frames = content.as_py() or b"", 0, []
                while (s := raw.find(start, at)) >= 0 and (e := raw.find(end, s + 2)) >= 0:
                    frames.append(raw[s : e + 2])
                    at = e + 2
                yield pa.record_batch([pa.array([path] * len(frames)), pa.array(range(len(frames)), pa.int32()), pa.array(frames, pa.binary())], names=["path", "n", "frame"])

    return blobs.select("path", "content").mapInArrow(run, "path string, n int, frame binary")


def fixed_chunks(blobs: DataFrame, size: int) -> DataFrame:
    """(path, n, chunk): chunks of ``size`` bytes; a partial tail is dropped."""
    count = F.floor(F.length("content") / size).cast("int")
    cut = blobs.where(count > 0).select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("n"))
    return cut.select("path", "n", F.substring("content", F.col("n") * size + 1, F.lit(size)).alias("chunk"))


def landed_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a landed catalog: JSON pages, one file a page, in id order within each."""
    return spark.read.schema(CATALOG).json(folder)


def patient(call: Callable, sleeps: Sequence[float] = (1.0, 4.0, 10.0), transient: tuple[type, ...] = (ConnectionError, TimeoutError)):
    """The result of ``call``, tried again after each of ``sleeps`` seconds on a transient error; others are raised at once."""
    for pause in sleeps:
        try:
            return call()
        except transient:
            time.sleep(pause)
    return call()


def paged_catalog(spark: SparkSession, fetch: Callable, schema: str = CATALOG, size: int = 100, tasks: int = 64, sleeps: Sequence[float] = (1.0, 4.0, 10.0), transient: tuple[type, ...] = (ConnectionError, TimeoutError)) -> DataFrame:
    """Rows of a service that gives (rows, count) for ``fetch(page, size)``, pages from 1, rows as dicts in a fixed order.

    The count of the first page says how many pages there are; tasks read them side by side, a page in memory at a time, and
    a lost task reads its own again. The last page is followed by further ones until one is not full, so rows that a
    service gains meanwhile at its end are read; where it loses rows meanwhile, pages shift and rows may be missed.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    count = patient(lambda: fetch(1, size), sleeps, transient)[1]
    pages = max(-(-count // size), 1)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def read(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                while True:
                    rows = patient(lambda: fetch(page, size), sleeps, transient)[0]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    if page < pages or len(rows) < size:
                        break
                    page += 1

    return spark.range(1, pages + 1, 1, min(pages, tasks)).mapInArrow(read, schema)


def catalog_items(catalog: DataFrame, base: str | None = None) -> DataFrame:
    """(item_id, title, item_key, path, duration) by an item's first file; nulls without one. ``base`` keeps a folder's items."""
    first = catalog.select(F.col("id").alias("item_id"), "title", F.try_element_at("files", F.lit(1)).alias("f"))
    key = F.when(F.col("f").isNotNull(), fingerprint_key(F.col("f.fingerprints"), F.col("f.path")))
    items = first.select("item_id", "title", key.alias("item_key"), F.col("f.path").alias("path"), F.col("f.duration").alias("duration"))
    return items if base is None else items.where(under_path(F.col("path"), base))


def catalog_markers(catalog: DataFrame) -> DataFrame:
    """(item_id, marker_id, start, end, title, primary_tag); an end of 0 is none."""
    m = catalog.select(F.col("id").alias("item_id"), F.explode("markers").alias("m"))
    return m.select("item_id", F.col("m.id").alias("marker_id"), F.col("m.seconds").alias("start"), F.when(F.col("m.end_seconds") != 0, F.col("m.end_seconds")).alias("end"), F.col("m.title").alias("title"), F.col("m.primary_tag.name").alias("primary_tag"))


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _stem(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(safe_name(F.lit(name))).first()[0]


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """The label store as JSON lines, one verdict a key, the last; it replaces the former one when all is written."""
    from ..operators.preference import keep_latest

    spark = verdicts.sparkSession
    keep_latest(verdicts, "ts").write.mode("overwrite").json(f"{path}.new")
    (old, files), (new, _) = _files(spark, path), _files(spark, f"{path}.new")
    files.delete(old, True)
    files.rename(new, old)


#: Moments of one collection, which is one document; longer lists of clips are playlists.
MOST_MOMENTS = 100_000
COLLECTION = "name string, count int, query string, moments array<struct<item_key:string,start:double,end:double,score:double>>"


def write_collection(moments: DataFrame, folder: str, name: str, query: str | None = None) -> str:
    """One JSON document (name, count, query, moments) under a file-safe form of the name, which is returned."""
    if moments.limit(MOST_MOMENTS + 1).count() > MOST_MOMENTS:
        raise ValueError(f"more than {MOST_MOMENTS} moments; write a playlist")
    stem = _stem(moments.sparkSession, name)
    whole = moments.agg(F.sort_array(F.collect_list(F.struct(*moments.columns))).alias("moments"))
    whole = whole.select(F.lit(name).alias("name"), F.size("moments").alias("count"), F.lit(query).cast(T.StringType()).alias("query"), "moments")
    whole.coalesce(1).write.mode("overwrite").json(f"{folder}/{stem}")
    return stem


def list_collections(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, name, count), by stem; documents that cannot be read are left out."""
    at, files = _files(spark, folder)
    if not files.exists(at) or not len(files.listStatus(at)):
        return spark.createDataFrame([], "stem string, name string, count int")
    rows = spark.read.schema(COLLECTION).json(f"{folder}/*")
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("stem"), "name", "count").where("name is not null").orderBy("stem")


def load_collection(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The collection's one row, or None without one."""
    at, files = _files(spark, f"{folder}/{_stem(spark, name)}")
    return spark.read.schema(COLLECTION).json(f"{folder}/{_stem(spark, name)}") if files.exists(at) else None


def delete_collection(spark: SparkSession, folder: str, name: str) -> bool:
    at, files = _files(spark, f"{folder}/{_stem(spark, name)}")
    return bool(files.exists(at) and files.delete(at, True))


def rename_collection(spark: SparkSession, folder: str, name: str, new_name: str) -> str:
    """Changes the name that is shown; the document stays where it is. Returns its stem."""
    stem = _stem(spark, name)
    rows = load_collection(spark, folder, name)
    if not new_name.strip() or rows is None:
        raise ValueError("the new name is empty" if rows is not None else f"no collection {name}")
    rows.withColumn("name", F.lit(new_name.strip())).coalesce(1).write.mode("overwrite").json(f"{folder}/.{stem}.new")
    (old, files), (new, _) = _files(spark, f"{folder}/{stem}"), _files(spark, f"{folder}/.{stem}.new")
    files.delete(old, True)
    files.rename(new, old)
    return stem


def list_reels(spark: SparkSession, folder: str, suffix: str = "mp4") -> DataFrame:
    """(name, bytes) of the exported files, newest first, then by name; none without the folder. Contents are not read."""
    at, files = _files(spark, folder)
    if not files.exists(at):
        return spark.createDataFrame([], "name string, bytes long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "modificationTime")
    return rows.orderBy(F.desc("modificationTime"), "name").select("name", "bytes")


def write_map(points: DataFrame, path: str) -> None:
    """Keep the points of maps by ``space``; each space written replaces its former points, others stay."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("space").parquet(path)


def read_map(spark: SparkSession, path: str, space: str) -> DataFrame | None:
    """The points kept for a space, or None without any; only its folder is read."""
    at, files = _files(spark, path)
    rows = spark.read.parquet(path).where(F.col("space") == space) if files.exists(at) else None
    return rows if rows is not None and not rows.isEmpty() else None
