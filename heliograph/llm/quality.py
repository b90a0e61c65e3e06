"""Quality by hierarchical empirical Bayes.

A logistic classifier gives each document's evidence from the shape of its text. Evidence is gathered per
host and per path of a host with grouped sums. A host's rate of good documents is shrunk to the global
one, a path's to its host's, the more so the fewer documents it has; how strongly follows from how far
hosts (and paths within hosts) spread beyond what chance explains. A document's posterior log-odds are
its own plus those of its path above the global ones, leaving its own evidence out of the path's rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logistic import balanced_sample, fit_logistic, sigmoid
from .shared import written

SAMPLE = 3000  # labelled rows of each class that the classifier is fitted on
FEATURES = 12
MOST_SENT = 100_000  # paths whose rates are broadcast; more are joined by shuffle


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL column."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)?", 1)


def shape(text: str | None) -> list[float]:
    """Shape of a text: repetition of words, neighbours, lines and short phrases, and shares of kinds of characters.

    Null and empty texts have all zeros but the first.
    """
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (FEATURES - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = max(counts.values())
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b"&*%#$!|=<>{}[]\\/@^~_`"))
    stops = len(raw) - len(raw.translate(None, b".?!"))
    same = sum(map(bytes.__eq__, words, words[1:]))
    size = len(raw)
    return [
        0.0, len(counts) / n ** 0.9, same / n, top / n, 1 - len(set(lines)) / len(lines), upper / size, digits / size, marks / size,
        min(4.0, 10 * stops / n), min(3.0, sum(map(len, words)) / n / 10), np.log1p(n) / 10, min(1.0, max(map(len, words)) / 100),
    ]


def _shapes(texts: Iterator[str | None]) -> np.ndarray:
    return np.array([shape(t) for t in texts]).reshape(-1, FEATURES)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE) -> np.ndarray:
    """Classifier weights from at most about ``most`` labelled rows of each class; without both classes all is good."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    sample = written(balanced_sample(rows, "y", F.col("doc_id"), most), "quality-ids")
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # about 2 * most rows
    made = got.select("y", "share", "text").mapInArrow(_sampled, "y int, share double, x array<double>").toPandas()
    if made["y"].nunique() < 2:
        return np.append(np.zeros(2 * FEATURES), 5.0)
    return fit_logistic(_squares(np.stack(made["x"])), made["y"].to_numpy(float), 1 / made["share"].to_numpy())


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([shape(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))], names=["y", "share", "x"])


def with_evidence(docs: DataFrame, weights: np.ndarray, text_col: str, into: str) -> DataFrame:
    """All columns of ``docs`` and the classifier's probability of a good document."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 1024):
                part = batch.slice(cut, 1024)
                z = _squares(_shapes(t.as_py() for t in part.column(at))) @ weights[:-1] + weights[-1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(sigmoid(z), 1e-6, 1 - 1e-6))], names=[*part.schema.names, into])

    fields = [*docs.schema.fields]
    out = docs.schema.__class__(fields).add(into, "double")
    return docs.mapInArrow(run, out)


def _strength(groups: DataFrame, rate: Column, floor: float = 1.0, ceiling: float = 1e6) -> float:
    """Prior strength (pseudo-documents) by moments: how far group means spread beyond the spread within groups."""
    mean = F.col("total") / F.col("n")
    within = F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")
    m, between, noise, n = groups.agg(F.avg(rate), F.avg((mean - rate) * (mean - rate)), F.avg(within), F.count(F.lit(1))).first()
    if not n or n < 2:
        return ceiling
    spread = between - noise
    return min(ceiling, max(floor, m * (1 - m) / spread - 1)) if spread > 1e-9 else ceiling


def site_rates(evidence: DataFrame) -> DataFrame:
    """(host, path, n, total, mid, weight, global_rate) from rows of (host, path, p), none of them null.

    ``mid`` is the host's shrunk rate and ``weight`` the strength with which a path is drawn to it. One row
    per path; rows are summed before they are shuffled, so a large host is no large group.
    """
    paths = written(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    total, n = hosts.agg(F.sum("total"), F.sum("n")).first()
    rate = min(1 - 1e-6, max(1e-6, (total / n) if n else 0.5))
    alpha = _strength(hosts, F.lit(rate))
    hosts = hosts.select("host", ((F.col("total") + alpha * rate) / (F.col("n") + alpha)).alias("mid"))
    both = written(paths.join(hosts, "host"), "quality-sites")
    beta = _strength(both, F.col("mid"))
    return both.select("host", "path", "n", "total", "mid", F.lit(beta).alias("weight"), F.lit(rate).alias("global_rate"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


ADDED = ("hb_evidence", "hb_site_rate", "hb_posterior", "hb_keep")


def judge(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """Every row of ``docs`` with its columns, then hb_evidence, hb_site_rate, hb_posterior, hb_keep; columns of these names
    that were there before are replaced.

    ``host`` and ``path`` default to the columns source and lang; null ones are sites of their own. Null
    and empty texts are judged like others, by shape. Repeated rows count each. Without labels of both
    classes the evidence is one constant. Rows are kept if the posterior reaches ``threshold``.
    """
    docs = docs.drop(*ADDED)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    weights = fit(docs, labels, id_col, text_col, label_col)
    site = (F.coalesce(host.cast("string"), F.lit("\0")), F.coalesce(path.cast("string"), F.lit("\0")))
    narrow = docs.select(F.col(text_col).alias("text"), site[0].alias("host"), site[1].alias("path"))
    rates = written(site_rates(with_evidence(narrow, weights, "text", "p").select("host", "path", "p")), "quality-rates")
    rates = rates.select(*[F.col(c).alias(f"hb_{c}") for c in rates.columns])
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("hb_row"), F.col(text_col).alias("hb_text"), site[0].alias("hb_host"), site[1].alias("hb_path"))
    if rates.count() <= MOST_SENT:
        rates = F.broadcast(rates)
    judged = with_evidence(kept, weights, "hb_text", "hb_evidence").drop("hb_text").join(rates, ["hb_host", "hb_path"])
    others = (F.col("hb_total") - F.col("hb_evidence") + F.col("hb_weight") * F.col("hb_mid")) / (F.col("hb_n") - 1 + F.col("hb_weight"))
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    judged = judged.withColumn("hb_site_rate", others)
    posterior = 1 / (1 + F.exp(-(_logit(F.col("hb_evidence")) + _logit(F.col("hb_site_rate")) - _logit(F.col("hb_global_rate")))))
    judged = judged.withColumn("hb_posterior", posterior)
    return judged.select(*[F.col("hb_row").getField(c).alias(c) for c in docs.columns], "hb_evidence", "hb_site_rate", "hb_posterior", (F.col("hb_posterior") >= threshold).alias("hb_keep"))
