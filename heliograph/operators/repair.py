"""Failed items tried again by a ladder of ways, each stage over what the ones before left."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Manifest
from .catalog import record_failures, resolve_failures

#: (mode, hwaccel, pipeline), from cheap to tolerant: single pictures without hardware, then the whole stream.
LADDER = (("sparse", "", "raw"), ("interval", "", "jpeg"))
EXHAUSTED, NO_WAY = "fix-exhausted", "all fallback strategies failed"
STAGE = "version long, path string"

#: Tries items (the failure log's columns) in one way and returns (item_key, ok boolean, error string, ...).
Attempt = Callable[[DataFrame, str, str, str], DataFrame]


@dataclass(frozen=True)
class Repair:
    """The failure log after the run, what was made, and how many items there were of each kind.

    ``left`` were not decided because the run was stopped before their last stage.
    """

    log: DataFrame
    made: DataFrame | None
    total: int
    fixed: int
    failed: int
    left: int


def to_retry(log: DataFrame, limit: int = 0) -> DataFrame:
    """Entries of the failure log, the oldest ``limit`` (0: all)."""
    return log.orderBy("ts", "item_key").limit(limit) if limit else log


def repair(
    log: DataFrame, there: DataFrame, attempt: Attempt, folder: str, now: float, limit: int = 0,
    ladder: Sequence[tuple[str, str, str]] = LADDER, stopped: Callable[[], bool] = lambda: False, model: str = "",
) -> Repair:
    """Tries the log's items (item_key, item_id, path, error, mode, hwaccel, pipeline, model, ts) way by way.

    Items whose path is not in ``there`` (path) count as failed and keep their entry. What a stage made is written
    to ``folder`` and entered there when it is whole; a run that finds a stage's entry takes its results, so a run
    that broke or was stopped goes on with the next stage. ``folder`` belongs to one run over one log. Items that
    worked leave the log; those that no way was good for get a new entry with their last error, at ``now``.
    ``stopped`` is asked before each stage.
    """
    spark = log.sparkSession
    done = Manifest(spark, f"{folder}/stages", STAGE)
    items = to_retry(log, limit)
    present = items.join(there.select("path").distinct(), "path", "left_semi")
    open_, made, fixed, halted = present, [], 0, False
    for n, (mode, hwaccel, pipeline) in enumerate(ladder):
        entry = done.entries().where(F.col("version") == n).first()
        if entry is None:
            if stopped():
                halted = True
                break
            path = f"{folder}/stage-{n}"
            attempt(open_, mode, hwaccel, pipeline).write.mode("overwrite").parquet(path)
            done.add(n, path=path)
        else:
            path = entry.path
        tried = spark.read.parquet(path)
        worked = tried.where("ok")
        made.append(worked.withColumns({"mode": F.lit(mode), "hwaccel": F.lit(hwaccel), "pipeline": F.lit(pipeline)}))
        fixed += worked.select("item_key").distinct().count()
        open_ = open_.join(worked, "item_key", "left_anti")
        errors = tried.where("NOT ok").groupBy("item_key").agg(F.max("error").alias("last"))
    total, undecided = items.count(), open_.count()
    whole = None
    for part in made:
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    after = log if whole is None else resolve_failures(log, whole.select("item_key").distinct())
    if not halted and made:
        again = open_.join(errors, "item_key", "left").select(
            "item_key", "item_id", "path", F.coalesce(F.nullif(F.col("last"), F.lit("")), F.lit(NO_WAY)).alias("error"),
            F.lit(EXHAUSTED).alias("mode"), F.lit("").alias("hwaccel"), F.lit("").alias("pipeline"),
            F.lit(model).alias("model"), F.lit(now).alias("ts"),
        )
        after = record_failures(after, again.select(*log.columns))
    failed = total - fixed - (undecided if halted else 0)
    return Repair(after, whole, total, fixed, failed, undecided if halted else 0)
