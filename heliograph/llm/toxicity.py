"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades run from 0 (clean) to GRADES - 1. The model has one weight a feature, shared by all grades, and one ordered
threshold between grades: p(grade <= j) = sigmoid(t_j - w.x). Its output is the expected grade. A label stands for a
set of grades, and the likelihood is that of the set: 0 is grade 0, and where labels are only 0 or 1, 1 is any grade
above 0; where there are higher ones, a label is its grade. Labels of two values tell nothing about the upper
thresholds; those are then set so that the toxic training documents spread evenly over the grades above 0.

Features are words and their four- to six-letter beginnings, hashed; a document's value for a feature is
log(1 + count), which does not thin out with length. Which features count is decided by an L1 penalty on weights of
features scaled to unit mean square, at the universal level sqrt(2 log F) times the noise of a gradient, F being the
number of features: a feature without bearing on the label stays out, however many there are. The penalty is
met exactly: gradients of all features are summed over the sample, those beyond the penalty join the fit, until
none is left. The weights of the chosen features are then fitted again with a ridge only, as L1 shrinks them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logistic import balanced_sample, sigmoid
from .shared import drop, words_of, written

GRADES = 4
SAMPLE = 4000  # toxic labelled rows that the model is fitted on; five times as many clean ones
JOINING = 50_000  # features that join the fit in one round; there are rounds until none is left to join
RIDGE = 1e-4
EDGE = b".,;:!?()[]\"'*&%#$-"
KEPT_WORDS = 500_000


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    w = word.strip(EDGE)
    if not w:
        return ()
    return tuple(xxhash.xxh3_64_intdigest(x) >> 1 for x in [b"w" + w, *(b"p" + w[:n] for n in (4, 5, 6) if len(w) > n)])


_memo: dict[bytes, tuple[int, ...]] = {}


def document_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words_of(text)).items():
        f = _memo.get(w)
        if f is None:
            if len(_memo) > KEPT_WORDS:
                _memo.clear()
            f = _memo[w] = word_features(w)
        for x in f:
            out[x] += n
    return out


class Model:
    """Feature places, shared weights, ordered thresholds."""

    def __init__(self, places: dict[int, int], weights: np.ndarray, thresholds: np.ndarray):
        self.places, self.weights, self.thresholds = places, weights, thresholds
        self.words: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> tuple:
        return self.places, self.weights, self.thresholds

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def strength(self, text: str | None) -> float:
        """w.x of a text."""
        words, places, hits = self.words, self.places, Counter()
        for w in words_of(text):
            f = words.get(w)
            if f is None:
                if len(words) > KEPT_WORDS:
                    words.clear()
                f = words[w] = tuple(places[x] for x in word_features(w) if x in places)
            if f:
                hits.update(f)
        return sum(self.weights[i] * math.log1p(n) for i, n in hits.items())

    def at_least(self, strength: np.ndarray) -> np.ndarray:
        """p(grade >= j) for j = 1 .. GRADES - 1, a column each."""
        return sigmoid(strength[:, None] - self.thresholds[None, :])


def _slope(strength: np.ndarray, thresholds: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Probability of each document's grades low .. high, and the densities at its upper and lower threshold."""
    cut = np.concatenate(([-np.inf], thresholds, [np.inf]))
    up, down = sigmoid(cut[high + 1] - strength), sigmoid(cut[low] - strength)
    # 1 - sigmoid where both are near 1, so that nothing is lost
    prob = np.where(low > 0, sigmoid(strength - cut[low]) - sigmoid(strength - cut[high + 1]), up)
    return np.maximum(prob, 1e-300), up * (1 - up), down * (1 - down)


def _gradients(model: Model, low_high, whole: float):
    """(f, g, square): sums over a partition of weight * (loss slope) * value and of weight * value ** 2, of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: dict[int, list[float]] = {}
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            y, weight = b.column(0).to_numpy(), 1 / b.column(1).to_numpy() / whole
            prob, up, down = _slope(np.array([model.strength(t) for t in texts]), model.thresholds, *low_high(y))
            slope = weight * (up - down) / prob
            for t, s, w in zip(texts, slope.tolist(), weight.tolist(), strict=True):
                for f, n in document_features(t).items():
                    x = math.log1p(n)
                    sums = g.get(f)
                    if sums is None:
                        g[f] = [s * x, w * x * x]
                    else:
                        sums[0] += s * x
                        sums[1] += w * x * x
        f = list(g)
        for at in range(0, len(f), 50_000):
            part = f[at : at + 50_000]
            yield pa.record_batch([pa.array(part, pa.int64()), *(pa.array([g[x][i] for x in part], pa.float64()) for i in (0, 1))], names=["f", "g", "square"])

    return run


def _hits(places: dict[int, int]):
    """(y, share, place, n) of the chosen features of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [{places[x]: k for x, k in document_features(t.as_py()).items() if x in places} for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([list(g) for g in got], pa.list_(pa.int64())), pa.array([list(g.values()) for g in got], pa.list_(pa.int64()))], names=["y", "share", "place", "n"])

    return run


class Sample:
    """Sparse rows with sets of grades and weights that sum to 1."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray], low: np.ndarray, high: np.ndarray, weight: np.ndarray, features: int):
        self.doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.val = np.concatenate(values).astype(float) if values else np.empty(0)
        self.low, self.high, self.weight, self.features = low, high, weight / weight.sum(), features

    def __call__(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient in (weights, first threshold, logs of the gaps between thresholds)."""
        w, raw = p[: self.features], p[self.features :]
        gaps = np.exp(raw[1:])
        t = np.concatenate(([raw[0]], raw[0] + np.cumsum(gaps)))
        strength = np.bincount(self.doc, weights=w[self.col] * self.val, minlength=len(self.low))
        prob, up, down = _slope(strength, t, self.low, self.high)
        share = self.weight / prob
        to_w = np.bincount(self.col, weights=(share * (up - down))[self.doc] * self.val, minlength=self.features)
        to_t = np.bincount(self.low, weights=share * down, minlength=GRADES + 1) - np.bincount(self.high + 1, weights=share * up, minlength=GRADES + 1)
        to_t = to_t[1:GRADES]
        above = np.cumsum(to_t[::-1])[::-1]
        return -float(self.weight @ np.log(prob)), np.concatenate([to_w, above[:1], above[1:] * gaps])


def minimise(of, p: np.ndarray, steps: int = 300, memory: int = 12, close: float = 1e-7) -> np.ndarray:
    """A minimum of a smooth function (value, gradient) from ``p`` on, by limited-memory quasi-Newton steps with backtracking."""
    value, g = of(p)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < close:
            break
        q, factors = g.copy(), []
        for s, y in reversed(kept):
            a = (s @ q) / (s @ y)
            q -= a * y
            factors.append(a)
        if kept:
            s, y = kept[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(kept, reversed(factors), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        rate = 1.0 if kept else min(1.0, 1.0 / np.abs(g).sum())
        while rate > 1e-12:
            there, (new, new_g) = p - rate * q, of(p - rate * q)
            if new <= value - 1e-4 * rate * (g @ q):
                break
            rate /= 2
        else:
            break
        if (s := there - p) @ (y := new_g - g) > 1e-14:
            kept = [*kept[1 - memory :], (s, y)]
        p, value, g = there, new, new_g
    return p


def fit_ordinal(sample: Sample, ridge: float = RIDGE, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, first threshold and log gaps that minimise the mean loss plus ridge / 2 * their squares (not the first threshold's)."""
    n = sample.features
    pull = np.concatenate([np.full(n, ridge), [0.0], np.full(GRADES - 2, ridge)])

    def of(p: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = sample(p)
        return loss + 0.5 * float(pull @ (p * p)), g + pull * p

    return minimise(of, np.zeros(n + GRADES - 1) if start is None else start)


def fit_lasso(sample: Sample, penalty: np.ndarray, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """As ``fit_ordinal`` with ``penalty`` times the weights' sizes in place of the ridge, by accelerated proximal steps."""
    n = sample.features
    scale = np.concatenate([1 / np.maximum(penalty, 1e-12), np.ones(GRADES - 1)])  # so that one step size fits all
    scale[:n] *= penalty.max() if n else 1.0
    level = penalty.max() if n else 0.0
    p, ahead, momentum, rate = start / scale, start / scale, 1.0, 4.0
    for _ in range(steps):
        loss, g = sample(ahead * scale)
        g = g * scale
        while True:
            there = ahead - rate * g
            there[:n] = np.sign(there[:n]) * np.maximum(np.abs(there[:n]) - rate * level, 0)
            step = there - ahead
            if rate < 1e-9 or sample(there * scale)[0] <= loss + g @ step + step @ step / (2 * rate) + 1e-12:
                break
            rate /= 2
        grown = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        if (ahead - there) @ (there - p) > 0:  # it runs uphill: start the momentum anew
            grown = 1.0
        ahead = there + (momentum - 1) / grown * (there - p) if grown > 1 else there.copy()
        moved, p, momentum = np.abs(there - p).max(), there, grown
        if moved < 1e-7:
            break
    return p * scale


def spread_thresholds(strength: np.ndarray, first: float, weight: np.ndarray) -> np.ndarray:
    """Thresholds above ``first`` by which documents known to lie above grade 0 spread evenly over the grades above."""
    out = [first]
    for j in range(1, GRADES - 1):
        low, high = out[-1], first + 60 + np.abs(strength).max(initial=0.0)
        for _ in range(100):
            middle = (low + high) / 2
            share = float(weight @ (sigmoid(strength - middle) / sigmoid(strength - first))) / weight.sum()
            low, high = (middle, high) if share > 1 - j / (GRADES - 1) else (low, middle)
        out.append(high)
    return np.array(out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> Model:
    """Model from at most about ``most`` toxic and five times as many clean labelled rows.

    Without toxic or without clean ones everything is clean. Labels below 0 count as 0, those above the last grade as that.
    """
    grade = F.least(F.greatest(F.col(label_col).cast("int"), F.lit(0)), F.lit(GRADES - 1))
    rows = labels.select(F.col(id_col).alias("doc_id"), grade.alias("y")).where("doc_id is not null and y is not null").withColumn("bad", F.col("y") > 0)
    toxic_rows = balanced_sample(rows.where("bad"), "bad", F.col("doc_id"), most)
    clean_rows = balanced_sample(rows.where("not bad"), "bad", F.col("doc_id"), 5 * most)
    sample = written(toxic_rows.unionByName(clean_rows), "toxicity-ids")
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # about 6 * most rows
    got = written(got.select("y", "share", "text"), "toxicity-sample")
    sizes = {r[0]: r[1:] for r in got.groupBy("y").agg(F.count(F.lit(1)), F.sum(1 / F.col("share")), F.sum(1 / (F.col("share") * F.col("share")))).collect()}
    whole, squares = (sum(x[i] for x in sizes.values()) for i in (1, 2))
    nothing = Model({}, np.zeros(0), 10.0 + np.arange(GRADES - 1))
    if 0 not in sizes or len(sizes) < 2:
        return nothing
    binary = max(sizes) == 1

    def low_high(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return y, np.where((y > 0) & binary, GRADES - 1, y)

    clean = sizes[0][1] / whole
    none = Sample([], [], *low_high(np.array(sorted(sizes))), np.array([sizes[y][1] for y in sorted(sizes)]), 0)
    p = fit_ordinal(none, start=np.concatenate(([math.log(clean / (1 - clean))], np.zeros(GRADES - 2))))
    places: dict[int, int] = {}
    squared: list[float] = []
    noise: float | None = None
    while True:
        raw = p[len(places) :]
        model = Model(places, p[: len(places)], np.concatenate(([raw[0]], raw[0] + np.cumsum(np.exp(raw[1:])))))
        summed = got.mapInArrow(_gradients(model, low_high, whole), "f long, g double, square double").groupBy("f").agg(F.sum("g").alias("g"), F.sum("square").alias("square"))
        summed = written(summed, "toxicity-gradients")
        if noise is None:
            noise = math.sqrt(2 * math.log(max(2, summed.count())) * clean * (1 - clean) * squares) / whole
        beyond = summed.where(F.abs("g") > F.sqrt("square") * noise * (1 + 1e-3)).orderBy(F.desc(F.abs(F.col("g")) / F.sqrt("square")), "f").limit(JOINING + len(places)).collect()
        joining = [r for r in beyond if r.f not in places][:JOINING]
        drop(summed)
        if not joining:
            break
        p = np.concatenate([p[: len(places)], np.zeros(len(joining)), raw])
        for r in joining:
            places[r.f] = len(places)
            squared.append(r.square)
        made = got.mapInArrow(_hits(places), "y int, share double, place array<long>, n array<long>").toArrow().to_pydict()
        y, weight = np.array(made["y"]), 1 / np.array(made["share"])
        cols, vals = [np.array(x, np.int64) for x in made["place"]], [np.log1p(np.array(x, float)) for x in made["n"]]
        own = Sample(cols, vals, *low_high(y), weight, len(places))
        p = fit_lasso(own, noise * np.sqrt(squared), p)
    if not places:
        return nothing
    stays = np.flatnonzero(p[: len(places)])
    new = np.full(len(places), -1)
    new[stays] = np.arange(len(stays))
    keep = [new[x] >= 0 for x in cols]
    own = Sample([new[x[k]] for x, k in zip(cols, keep, strict=True)], [x[k] for x, k in zip(vals, keep, strict=True)], *low_high(y), weight, len(stays))
    p = fit_ordinal(own, start=np.concatenate([p[stays], p[len(places) :]]))
    weights, raw = p[: len(stays)], p[len(stays) :]
    thresholds = np.concatenate(([raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))))
    if binary:
        strength = np.bincount(own.doc, weights=weights[own.col] * own.val, minlength=len(y))
        thresholds = spread_thresholds(strength[y > 0], raw[0], weight[y > 0])
    return Model({f: int(new[i]) for f, i in places.items() if new[i] >= 0}, weights, thresholds)


SCORED = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic, toxic for every row of ``docs``.

    grade is the median one: the highest that is reached with a probability of one half or more. Null and empty
    texts have no features and get the base severity. Equal texts get equal scores; repeated rows stay. toxic:
    p(grade >= 1) reaches ``threshold``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                up = model.at_least(np.array([model.strength(t.as_py()) for t in batch.column(1)]))
                grade = (up >= 0.5).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(up.sum(axis=1)), pa.array(grade), pa.array(up[:, 0]), pa.array(up[:, 0] >= threshold)], names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)
