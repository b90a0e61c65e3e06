"""Incremental passes over growing inputs, with checkpoints that make them resumable."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.snapshots import Manifest
from .jobs import stoppable
from .stateful import started


class _First(StatefulProcessor):
    """The first row of each key; what has been seen is one flag a key in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = not self.seen.exists(), None
        for part in rows:
            if new and first is None and len(part):
                first = part.head(1)
        if first is not None:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


COMMIT = "version long, path string, rows long"


def landed(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batches that ``pass_over`` has committed, or None without any; ``before`` a batch's number."""
    batches = Manifest(spark, f"{target}/commits", COMMIT).entries().where("rows > 0")
    if before is not None:
        batches = batches.where(F.col("version") < before)
    paths = [r.path for r in batches.select("path").collect()]
    return spark.read.parquet(*paths) if paths else None


def pass_over(
    source: DataFrame, target: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = ("item_key",), every: str | None = None,
    after: Callable[[DataFrame, int], None] | None = None, stopped: Callable[[], bool] = lambda: False,
) -> StreamingQuery:
    """Embeds what ``target`` does not have yet; one pass, or again and again ``every`` interval.

    Which keys have been seen is kept in the state store, by hash of the key, so a batch costs what it brings and
    not what the target holds. The first start without a checkpoint reads the target's keys once, so nothing is done
    twice after the loss of a checkpoint either. Of several rows of a new key one is taken.

    A batch is written to a folder of its own number and then entered in the target's commit log, which ``landed``
    reads by. A batch that comes again after a crash overwrites its folder and finds its entry, or makes it. ``after``
    is called with the batch's rows and number when they are committed, again if the batch comes again. ``stopped``
    is asked before each batch; a stop ends the stream with ``jobs.Stopped``, and the next start goes on with that batch.
    """
    spark = source.sparkSession
    log = Manifest(spark, f"{target}/commits", COMMIT)
    first = max(log.numbers(), default=-1) + 1 if not _has_offsets(spark, checkpoint) else None
    base = _base(spark, checkpoint, first)
    done = landed(spark, target, before=base)
    known = None if done is None else done.select(*keys).distinct().groupBy(*keys)
    fresh = source.groupBy(*keys).transformWithStateInPandas(_First(), source.schema, "Append", "None", known)

    def one(batch: DataFrame, number: int) -> None:
        at = base + number
        path = f"{target}/batch={at}"
        embed(batch).write.mode("overwrite").parquet(path)
        rows = batch.sparkSession.read.parquet(path)
        log.add(at, path=path, rows=rows.count())
        if after is not None:
            after(rows, at)

    writer = fresh.writeStream.foreachBatch(stoppable(one, stopped)).option("checkpointLocation", checkpoint)
    return started(writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True), fresh)


def _has_offsets(spark: SparkSession, checkpoint: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _base(spark: SparkSession, checkpoint: str, first: int | None) -> int:
    """What is added to a checkpoint's batch numbers so that those of a later checkpoint do not meet earlier ones."""
    kept = Manifest(spark, f"{checkpoint}/base", "version long, base long")
    if first is not None:
        kept.add(0, base=first)
    return kept.entries().first().base


COUNTS = ("embedded", "skipped", "failed", "frames")


def observed(results: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """The rows (status, frames, seconds), one an item, and an observation that counts them as they pass.

    Once an action has run, ``run_stats`` reads it; no second job is needed.
    """
    seen = Observation(name) if name else Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in COUNTS[:3]]
    took = F.coalesce(F.sum(F.when(F.col("status") == "embedded", F.col("seconds"))), F.lit(0.0)).alias("seconds")
    return results.observe(seen, *counts, F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), took), seen


def run_stats(seen: Observation) -> dict:
    """The counts of a pass, and the mean seconds of an embedded item if there is one."""
    found = seen.get
    stats = {k: found[k] for k in COUNTS}
    return stats | ({"seconds_per_item": round(found["seconds"] / found["embedded"], 2)} if found["embedded"] else {})


def queue(passes: Iterable[tuple[str, Callable[[], dict]]], stopped: Callable[[], bool] = lambda: False) -> dict:
    """Runs passes (name, function that returns its counts) one after another; their sums and each one's counts under ``passes``.

    A stop takes effect between passes.
    """
    each: dict[str, dict] = {}
    for name, run in passes:
        if stopped():
            break
        each[name] = run()
    return {k: sum(x.get(k, 0) for x in each.values()) for k in COUNTS} | {"passes": each}


RUN = "item_key long, start double, end double, peak double, mean double, n long"


def online_runs(events: DataFrame, high: float, low: float, watermark: str = "1 hour", idle: float = 3600.0) -> DataFrame:
    """Hysteresis runs of a stream (item_key, ts, t, score), each emitted when it closes.

    State per item: whether a run is open, its bounds, peak, sum and count, and events held back until the
    watermark passes them, so late ones still fall in place. A run left open closes when the watermark is
    ``idle`` seconds past its item's last event.
    """
    state = "held array<struct<t:double,score:double>>, start double, end double, peak double, total double, n long"

    def step(key, batches: Iterator, st: GroupState):
        import pandas as pd

        held, start, end, peak, total, n = st.get if st.exists else ([], None, None, None, 0.0, 0)
        held = [(x["t"], x["score"]) if not isinstance(x, tuple) else x for x in (held or [])]
        out = []

        def close():
            out.append((key[0], start, end, peak, total / n, n))

        for pdf in batches:
            held += list(zip(pdf["t"].astype(float), pdf["score"].astype(float), strict=True))
        mark = st.getCurrentWatermarkMs() / 1000
        held.sort()
        ready, held = [x for x in held if x[0] <= mark], [x for x in held if x[0] > mark]
        for t, x in ready:
            if start is None and x >= high:
                start, end, peak, total, n = t, t, x, x, 1
            elif start is not None and x < low:
                close()
                start, end, peak, total, n = None, None, None, 0.0, 0
            elif start is not None:
                end, peak, total, n = t, max(peak, x if x == x else peak), total + x, n + 1
        if start is not None and not held and mark >= end + idle:
            close()
            start = None
        if held or start is not None:
            st.update(([{"t": t, "score": x} for t, x in held], start, end, peak, total, n))
            st.setTimeoutTimestamp(max(st.getCurrentWatermarkMs(), int(1000 * (held[0][0] if held else end + idle))) + 1)
        elif st.exists:
            st.remove()
        yield pd.DataFrame(out, columns=["item_key", "start", "end", "peak", "mean", "n"])

    marked = events.withWatermark("ts", watermark)
    return marked.groupBy("item_key").applyInPandasWithState(step, RUN, state, "append", GroupStateTimeout.EventTimeTimeout)


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def late_free(events: DataFrame, every: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Windowed score summary of a stream, late events beyond the watermark dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", every), "item_key").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.max("score").alias("peak"))
