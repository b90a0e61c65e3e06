"""One object over a library's tables: the operations an application calls, as DataFrames.

A ``Library`` holds lazily read tables and a cache of derived ones. Nothing runs until a result is used,
except where a model is fitted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, entities, learning, metrics, preference, sampling, search, segments
from .operators.tiled import similarity_to

#: A scorer makes a score column from the vector column.
Scorer = Callable[[Column], Column]


@dataclass(frozen=True)
class Settings:
    """Numeric knobs, with the defaults of the operators."""

    dim: int = 64
    top_k: int = 60
    per_item: int = 3
    high: float = 0.9
    low: float | None = None
    min_duration: float = 3.0
    merge_gap: float = 2.0
    max_duration: float = 30.0
    padding: float = 0.5
    smooth_window: int = 3
    normalise: str = "item-z"
    duplicate_floor: float = 0.9
    autotrain_every: int = 25
    halflife_days: float = 90.0
    modes: int = 24
    diversity: float = 0.3

    def changed(self, **values) -> Settings:
        return replace(self, **{k: v for k, v in values.items() if v is not None})


@dataclass
class Library:
    """samples (item_key, item_id, t, vec, vec_id), verdicts, markers, bridge (entity, item_key), details, vocabulary (term, vec)."""

    samples: DataFrame
    verdicts: DataFrame | None = None
    markers: DataFrame | None = None
    bridge: DataFrame | None = None
    details: DataFrame | None = None
    vocabulary: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    kept: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.samples.sparkSession

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, persisted until ``forget``; partitions that do not fit go to disk."""
        if name not in self.kept:
            self.kept[name] = make().persist()
        return self.kept[name]

    def forget(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()

    @contextmanager
    def job(self, label: str) -> Iterator[str]:
        """Runs what is inside as one job group that ``cancel`` can stop from another thread."""
        group = f"{label}-{uuid.uuid4().hex[:8]}"
        self.spark.sparkContext.setJobGroup(group, label, interruptOnCancel=True)
        try:
            yield group
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self, group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(group)

    # search

    def similar(self, item_key, at: float, min_score: float | None = None) -> DataFrame:
        """Nearest samples of other items; with a floor (above 0) all of them."""
        s = self.settings
        floor = min_score or None
        return search.search_by_sample(self.samples, item_key, at, None if floor else s.top_k, s.per_item, floor)

    def text(self, positive: str, negative: str | None = None, min_score: float | None = None) -> DataFrame:
        q = search.posneg_query(self.vocabulary, positive, negative)
        return search.search(self.samples, q, None if min_score else self.settings.top_k, self.settings.per_item, min_score=min_score or None)

    def duplicates(self, item_key, at: float) -> DataFrame:
        return search.duplicates(self.samples, item_key, at, self.settings.duplicate_floor)

    def timeline(self, item_key, term: str) -> DataFrame:
        return search.timeline(self.samples, item_key, search.posneg_query(self.vocabulary, term, None))

    def tags(self, k: int = 5, floor: float | None = None) -> DataFrame:
        return search.top_terms(self.samples.select("item_key", "vec"), self.vocabulary, ["item_key"], k, floor)

    # scoring

    def scores(self, references: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
        """(.., score) by a scorer, by likeness to references, or else by preference."""
        if scorer is not None:
            return self.samples.withColumn("score", scorer(F.col("vec")))
        return similarity_to(self.samples, references) if references is not None else self.preference()

    def segments(self, scores: DataFrame) -> DataFrame:
        s = self.settings
        rows = scores.select("item_key", "t", "score")
        if s.normalise == "item-z":
            rows = segments.zscore(rows, into="score")
        elif s.normalise != "none":
            raise ValueError(f"unknown normalisation: {s.normalise}")
        found = segments.extract(segments.smooth(rows, s.smooth_window, into="score"), s.high, s.low, s.min_duration, s.merge_gap, s.max_duration or None, s.padding)
        return found if self.markers is None else segments.without_existing(found, self.markers)

    # preference

    def sources(self) -> DataFrame:
        return self.keep("sources", lambda: preference.loved_sources(self.markers, preference.keep_latest(self.verdicts), self.samples))

    def preference(self) -> DataFrame:
        """Samples with their likeness to what was liked."""
        return self.keep("preference", lambda: preference.mode_scores(self.samples, self.sources(), self.settings.modes, self.settings.dim))

    def train(self, auto: bool = True):
        rows = preference.training_set(preference.keep_latest(self.verdicts), self.samples)
        return learning.fit_auto(rows) if auto else learning.fit_logistic(rows)

    def recommend(self, k: int, seed: str, seen: DataFrame | None = None, min_score: float | None = None, model=None) -> DataFrame:
        """(vec_id, place): the feed; a trained ``model`` reorders the pool."""
        rerank = None if model is None else lambda rows: learning.predict(model, rows, "liking")
        rows = self.preference()
        rows = rows if "vec" in rows.columns else rows.join(self.samples.select("vec_id", "vec"), "vec_id")
        return preference.recommend(rows, k, seed, self.settings.diversity, seen, min_score, rerank, self.settings.per_item)

    def board(self, count: int, seed: str, per_item: int = 4, floor: float | None = None, seen: DataFrame | None = None) -> DataFrame:
        """(vec_id, ...): with a floor a uniform draw above it, else a draw by rank, spread if ``diversity`` is set."""
        rows = preference.universe(self.preference(), per_item)
        rows = rows if floor is None else rows.where(F.col("score") >= floor)
        rows = rows if seen is None else preference.unseen(rows, seen)
        if floor is not None:
            return sampling.uniform_sample(rows, "vec_id", count, seed)
        rows = rows if "vec" in rows.columns else rows.join(self.samples.select("vec_id", "vec"), "vec_id")
        return sampling.diverse_board(preference.ranked_widely(rows), count, self.settings.diversity, seed)

    def next_batch(self, seen: DataFrame, count: int = 30) -> DataFrame:
        """The next moments of a stream that does not repeat items until all were shown."""
        return preference.next_batch(search.capped(self.preference(), "item_key", 1), seen, count)

    def delete_taste(self, profile: str, now: float, minutes: float | None = None):
        """Drops a profile's verdicts (of the last minutes, or all) and what was derived from them; returns a model trained on
        the rest, or None if the rest does not hold both classes."""
        self.verdicts = preference.delete_recent(self.verdicts, now, minutes, profile)
        self.forget()
        try:
            return self.train(auto=False)
        except ValueError:
            return None

    def taste(self, model=None) -> tuple[DataFrame, str]:
        """Samples with their score and what it is from: a trained model's probability, or else the nearest liked mode."""
        if model is None:
            return self.preference(), "modes"
        return learning.predict(model, self.samples, "score"), "classifier"

    def next_to_label(self, model=None, pool: int = 800, seed: str = "") -> DataFrame:
        """The least certain sample of a random pool: by a model, by likeness if anything is liked, or else any."""
        if model is not None:
            return preference.next_uncertain(learning.predict(model, self.samples), self.verdicts, pool, seed, p="p")
        if self.sources().isEmpty():
            return preference.next_uncertain(self.samples, self.verdicts, pool, seed)
        return preference.next_uncertain(self.preference(), self.verdicts, pool, seed, likeness="score")

    def candidates(self, top: int, random: int, limit: int, seed: str) -> DataFrame:
        return sampling.top_and_random(self.preference(), self.verdicts, top, random, limit, seed)

    # reports

    def bands(self) -> DataFrame:
        return metrics.bands(self.preference())

    def survival(self) -> DataFrame:
        return metrics.survival(self.preference())

    def at_threshold(self, value: float) -> DataFrame:
        return metrics.threshold_report(self.preference(), value)

    def leaderboard(self, by: str = "affinity") -> DataFrame:
        return entities.ordered(entities.leaderboard(self.bridge, self.preference(), self.details), by)

    def hall_of_fame(self, top: int = 10, each: int = 2) -> DataFrame:
        return entities.hall_of_fame(self.leaderboard(), entities.best_moments(self.bridge, self.preference()), top, each)

    def similar_entities(self, entity, k: int = 10) -> DataFrame:
        return entities.similar(entities.centroids(self.bridge, self.samples, self.settings.dim), entity, k)

    def map(self) -> DataFrame:
        return learning.cluster(learning.project(entities.item_centroids(self.samples, self.settings.dim)))

    def statistics(self, items: DataFrame) -> DataFrame:
        return catalog.library_stats(items)
