"""Streams as jobs: their states and progress as tables, and a stop that takes effect between batches."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

STOPPED = "stopped between batches"
JOBS = "id string, name string, state string, batches long, rows long, started double, ended double, error string"
PROGRESS = "id string, batch long, rows long, seconds double, rows_per_second double, at string"


class Stopped(Exception):
    """Raised at the start of a batch that is not to begin; nothing of it has happened, so a restart begins with it."""

    def __init__(self) -> None:
        super().__init__(STOPPED)


def stoppable(
    work: Callable[[DataFrame, int], None], stopped: Callable[[], bool]
) -> Callable[[DataFrame, int], None]:
    """A batch function that first asks whether to go on."""

    def one(batch: DataFrame, number: int) -> None:
        if stopped():
            raise Stopped
        work(batch, number)

    return one


@dataclass
class Job:
    id: str
    name: str
    query: StreamingQuery | None = None
    started: float = field(default_factory=time.time)
    ended: float | None = None
    error: str | None = None
    asked_to_stop: threading.Event = field(default_factory=threading.Event)

    def stopped(self) -> bool:
        return self.asked_to_stop.is_set()

    def wait(self, seconds: float | None = None) -> str:
        """The state after at most so many seconds."""
        try:
            if seconds is None:
                self.query.awaitTermination()
            else:
                self.query.awaitTermination(seconds)
        except StreamingQueryException:
            pass
        return self.state()

    def state(self) -> str:
        if self.query.isActive:
            return "stopping" if self.stopped() else "running"
        self.ended = self.ended or time.time()
        problem = self.query.exception()
        if problem is None:
            return "stopped" if self.stopped() and self.error is None else "done"
        if STOPPED in str(problem):
            return "stopped"
        said = re.findall(r"^\w[\w.]*(?:Error|Exception)\b.*", str(problem), re.MULTILINE)
        self.error = (said[-1] if said else str(problem))[:500]
        return "failed"

    def stop(self) -> None:
        """Let the batch that runs come to its end, and begin no other. A stream that waits for input ends at once."""
        self.asked_to_stop.set()
        if self.query.isActive and not self.query.status["isTriggerActive"]:
            self.query.stop()


class Jobs:
    """The jobs of a session, in memory of the driver: one entry a job, and the last batches that Spark keeps of each."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def start(self, name: str, run: Callable[[Job], StreamingQuery]) -> Job:
        """``run(job)`` starts the stream; its batches have to ask ``job.stopped`` (``stoppable``, ``pass_over``)."""
        job = Job(uuid.uuid4().hex, name)
        job.query = run(job)
        self.jobs[job.id] = job
        return job

    def table(self) -> DataFrame:
        """All jobs, the newest first."""
        rows = []
        for job in self.jobs.values():
            state, done = job.state(), job.query.recentProgress
            batches = 1 + max((p["batchId"] for p in done), default=-1)
            rows.append((job.id, job.name, state, batches, sum(p["numInputRows"] for p in done), job.started, job.ended, job.error))
        return self.spark.createDataFrame(rows, JOBS).orderBy(F.desc("started"), "id")

    def progress(self) -> DataFrame:
        """Batches, by job and number."""
        rows = [
            (job.id, p["batchId"], p["numInputRows"], p["batchDuration"] / 1000.0, float(p["processedRowsPerSecond"] or 0.0), p["timestamp"])
            for job in self.jobs.values()
            for p in job.query.recentProgress
        ]
        return self.spark.createDataFrame(rows, PROGRESS).orderBy("id", "batch")
