"""Stateful streams: a session's feed that does not repeat, and training whenever enough verdicts have come.

Both keep their state in the state store, one small entry a session, shown item or profile, so that a restarted
stream goes on where it was. They need the RocksDB store, which ``started`` sets for the query it starts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import md5

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import learning, preference
from ..sources.snapshots import Manifest

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FEED = "session long, request long, asked double, cycle long, slot int, place long"
ANSWER = "session long, request long, asked double, cycle long, places array<long>"


def started(writer: DataStreamWriter, df: DataFrame) -> StreamingQuery:
    """Starts a stream whose state is in RocksDB; other queries of the session keep their store."""
    conf = df.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        return writer.start()
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)


class _Feed(StatefulProcessor):
    """Places of a ranked library that a session has not seen: the best first, all anew when none is left.

    Without ``ttl`` what has been shown is all before the next place, so only what was shown before the stream is
    entries of the state, and a batch asks the state a few times a session instead of several times a place.
    """

    def __init__(self, size: int, ttl: float | None):
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getMapState("shown", "place long", "asked double")
        self.at = handle.getValueState("at", "next long, cycle long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.shown.updateValue((initialState.place,), (None,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        next_, cycle = self.at.get() if self.at.exists() else (1, 0)
        self.some = self.shown.exists()
        for r in sorted(rows, key=lambda r: (r.asked, r.request)):
            if not self.size:
                break
            found, next_ = self._unseen(next_ if self.ttl is None else 1, r)
            if not found:
                if self.some:
                    self.shown.clear()
                    self.some = False
                cycle += 1
                found, next_ = self._unseen(1, r)
            if self.ttl is not None:
                for place in found:
                    self.shown.updateValue((place,), (r.asked,))
                self.some = True
            yield Row(session=key[0], request=r.request, asked=r.asked, cycle=cycle, places=found)
        self.at.update((next_, cycle))

    def _unseen(self, first: int, r: Row) -> tuple[list[int], int]:
        """The next places from ``first`` on, and where to look next; all before it have been shown."""
        found = []
        while len(found) < r["count"] and first <= self.size:
            if self._forgotten(first, r.asked):
                found.append(first)
            first += 1
        return found, first

    def _forgotten(self, place: int, now: float) -> bool:
        if not self.some or not self.shown.containsKey((place,)):
            return True
        if self.ttl is None:
            return False
        asked = self.shown.getValue((place,))[0]
        return asked is not None and now - asked > self.ttl

    def close(self) -> None:
        pass


def session_feed(
    requests: DataFrame, size: int, shown: DataFrame | None = None, ttl: float | None = None
) -> DataFrame:
    """Answers to a stream of requests (session, request, asked, count): the places of a library of ``size`` items.

    A request gets the first ``count`` places that its session has not been shown, fewer if fewer are left. When
    none is left the session's memory is cleared, its cycle goes up, and it starts with place 1 again. Requests of
    a session are answered in order of ``asked`` and ``request`` within a batch of the stream, and a batch after
    the other. ``shown`` (session, place) is what sessions have seen before this stream's first start, for example
    in an earlier version of the library. Requests for no item, or without a time, get no answer.

    With ``ttl`` a place counts as not shown when it was shown more than so many seconds before, by the requests'
    own times, so answers do not depend on when the stream runs. Each request then looks at all places from 1 on;
    without it, only at those that are left.

    The state knows places only: items are joined to the answers by place, so a library is neither broadcast nor
    held in a task.
    """
    own = requests.where("session IS NOT NULL AND asked IS NOT NULL AND count > 0").select(
        F.col("session").cast("long"), F.col("request").cast("long"), F.col("asked").cast("double"), F.col("count").cast("int")
    )
    before = None if shown is None else shown.select(F.col("session").cast("long"), F.col("place").cast("long"))
    answers = own.groupBy("session").transformWithState(
        _Feed(size, ttl), ANSWER, "Append", "None",
        None if before is None else before.where("session IS NOT NULL").distinct().groupBy("session"),
    )
    shown_ = answers.select("session", "request", "asked", "cycle", F.posexplode("places").alias("slot", "place"))
    return shown_.withColumn("slot", F.col("slot") + 1)


def feed_like_a_loop(
    requests: Iterable[tuple[int, int, float, int]], size: int, shown: Iterable[tuple[int, int]] = (),
    ttl: float = math.inf,
) -> list[tuple]:
    """What ``session_feed`` answers, one request after another: the definition it is tested against."""
    seen: dict[int, dict[int, float]] = {}
    for session, place in shown:
        seen.setdefault(session, {})[place] = math.inf
    cycles: dict[int, int] = {}
    out = []
    for session, request, asked, count in sorted(requests, key=lambda r: (r[2], r[1])):
        if count <= 0 or not size:
            continue
        mine = seen.setdefault(session, {})
        left = [p for p in range(1, size + 1) if p not in mine or asked - mine[p] > ttl]
        if not left:
            mine.clear()
            cycles[session] = cycles.get(session, 0) + 1
            left = list(range(1, size + 1))
        for slot, place in enumerate(left[:count], 1):
            mine[place] = asked
            out.append((session, request, asked, cycles.get(session, 0), slot, place))
    return out


PLAYED = "session long, request long, asked double, cycle long, slot int, item_key long, clip long"
#: Clips of a pool that sessions play; the order of what is left is state of each session.
MOST_CLIPS = 10_000
#: A session does not play an item among its last RECENT ones if one of the next AHEAD clips is of another item.
RECENT, AHEAD = 8, 6
LEAST_SCORE = 0.05


def shuffled(pool: Sequence[tuple[int, int, float]], seed: str) -> list[int]:
    """Places of the pool's (clip, item_key, score) in an order in which those of higher score tend to come early."""

    def chance(clip: int) -> float:
        return (int(md5(f"{clip}{seed}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    drawn = [(chance(clip) ** (1.0 / max(score, LEAST_SCORE)), clip, i) for i, (clip, _, score) in enumerate(pool)]
    return [i for _, _, i in sorted(drawn, key=lambda d: (-d[0], d[1]))]


def next_clip(queue: list[int], recent: list[int], pool: Sequence[tuple[int, int, float]]) -> int:
    """Takes the next place off the queue, and notes its item among the recent ones."""
    for i, place in enumerate(queue[:AHEAD]):
        if pool[place][1] not in recent:
            recent.append(pool[place][1])
            del recent[:-RECENT]
            return queue.pop(i)
    return queue.pop(0)


class _Queue(StatefulProcessor):
    """Every clip once before any comes again, in a new order each time."""

    def __init__(self, pool: list[tuple[int, int, float]], seed: str):
        self.pool, self.seed = pool, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "queue array<int>, recent array<long>, cycle long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        queue, recent, cycle = self.left.get() if self.left.exists() else ([], [], -1)
        queue, recent = list(queue), list(recent)
        for r in sorted(rows, key=lambda r: (r.asked, r.request)):
            for slot in range(1, r["count"] + 1):
                if not queue:
                    cycle += 1
                    queue = shuffled(self.pool, f"{self.seed}-{key[0]}-{cycle}")
                clip, item, _ = self.pool[next_clip(queue, recent, self.pool)]
                yield Row(session=key[0], request=r.request, asked=r.asked, cycle=cycle, slot=slot, item_key=item, clip=clip)
        self.left.update((queue, recent, cycle))

    def close(self) -> None:
        pass


def play_queue(requests: DataFrame, pool: DataFrame, seed: str = "") -> DataFrame:
    """Answers to a stream of requests (session, request, asked, count) from a pool (clip, item_key, score) of clips.

    Each session plays all clips before one comes again, by a draw weighted by score (null counts as 1), and does not
    play an item again soon if it can be helped. The pool is sent to the tasks; more than MOST_CLIPS are an error, for
    which ``session_feed`` is there.
    """
    rows = pool.select(F.col("clip").cast("long"), F.col("item_key").cast("long"), F.coalesce(F.col("score").cast("double"), F.lit(1.0)))
    clips = sorted(map(tuple, rows.where("clip IS NOT NULL").limit(MOST_CLIPS + 1).collect()))
    if len(clips) > MOST_CLIPS:
        raise ValueError(f"more than {MOST_CLIPS} clips")
    own = requests.where("session IS NOT NULL AND asked IS NOT NULL AND count > 0").select(
        F.col("session").cast("long"), F.col("request").cast("long"), F.col("asked").cast("double"), F.col("count").cast("int")
    )
    return (own if clips else own.where("false")).groupBy("session").transformWithState(_Queue(clips, seed), PLAYED, "Append", "None")


DUE = "profile string, version long, seq long, verdicts long, positive long, negative long"


class _Due(StatefulProcessor):
    """Counts a profile's verdicts and says when the next version of its model is due."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "since long, pos long, neg long, version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        since, pos, neg, version = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        for r in sorted(rows, key=lambda r: (r.seq, r.label)):
            since, pos, neg = since + 1, pos + (r.label == 1), neg + (r.label == 0)
            if since >= self.every and pos and neg:
                since, version = 0, version + 1
                yield Row(
                    profile=key[0], version=version, seq=r.seq, verdicts=pos + neg, positive=pos, negative=neg
                )
        self.counts.update((since, pos, neg, version))

    def close(self) -> None:
        pass


def due_points(verdicts: DataFrame, every: int = 25) -> DataFrame:
    """A stream of verdicts (profile, seq, label 0 or 1) as the points at which a profile's model is to be trained.

    That is when ``every`` verdicts have come since the last point and both classes have been seen; a point that
    waits for its second class comes with it. Nothing is ever due if ``every`` is 0. Verdicts are counted in order
    of ``seq`` within a batch. Points carry the version (1, 2, ...) and the counts so far.
    """
    own = verdicts.where("profile IS NOT NULL AND label IN (0, 1)").select(
        F.col("profile").cast("string"), F.col("seq").cast("long"), F.col("label").cast("long")
    )
    if every <= 0:
        return own.where("false").selectExpr(*[f"CAST(NULL AS {t}) AS {n}" for n, t in (f.split() for f in DUE.split(", "))])
    return own.groupBy("profile").transformWithState(_Due(every), DUE, "Append", "None")


def trained(
    points: DataFrame, train: Callable[[str, int, int], None], published: Callable[[str], int], checkpoint: str
) -> StreamingQuery:
    """Trains at due points until the stream's end: ``train(profile, version, seq)`` has to publish what it makes.

    Of several points of a profile in one batch the last one counts, since its model replaces the others at once.
    ``published(profile)`` is the latest version that is out (0: none); a point that is not above it is left alone, so
    a batch that comes again after a crash trains nothing twice. The driver sees one row a profile and batch.
    """

    def one(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("profile").agg(F.max(F.struct("version", "seq")).alias("p"))
        for r in last.select("profile", "p.version", "p.seq").orderBy("profile").toLocalIterator():
            if r.version > published(r.profile):
                train(r.profile, r.version, r.seq)

    writer = points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return started(writer, points)


MODEL = "version long, path string, seq long"


def latest_model(spark: SparkSession, root: str, profile: str, dim: int):
    """The newest published model of a profile, or None."""
    found = _versions(spark, root, profile).entries().orderBy(F.desc("version")).first()
    return None if found is None else learning.load(spark, found.path, profile, dim)


def _versions(spark: SparkSession, root: str, profile: str) -> Manifest:
    return Manifest(spark, f"{root}/{profile}/versions", MODEL)


def autotrain(
    stream: DataFrame, verdicts: Callable[[], DataFrame], samples: DataFrame, root: str, checkpoint: str, dim: int,
    every: int = 25,
) -> StreamingQuery:
    """Trains and publishes a profile's model whenever it is due by the stream of verdicts (profile, seq, label).

    A model is trained on the store's latest verdicts (``verdicts()``: seq, item_key, t, label, profile) up to the one
    that made it due, written to a folder of its version, and entered among the profile's versions. The entry is what
    counts: a version whose writer died before it is made again, one that is there is not.
    """
    spark = samples.sparkSession

    def train(profile: str, version: int, seq: int) -> None:
        known = verdicts().where((F.col("profile") == profile) & (F.col("seq") <= seq))
        model = learning.fit_logistic(preference.training_set(preference.keep_latest(known), samples))
        path = f"{root}/{profile}/model-{version}"
        learning.save(model, path, profile, dim, "logistic")
        _versions(spark, root, profile).add(version, path=path, seq=seq)

    def published(profile: str) -> int:
        return _versions(spark, root, profile).entries().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    return trained(due_points(stream, every), train, published, checkpoint)
