"""Scalar column functions: seeded uniforms, text queries, names, timestamps, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on key and seed only, whatever the partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(seed)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))


def race(u: Column, weight: Column) -> Column:
    """Exponential race: ascending order samples without replacement in proportion to weight."""
    return -F.log(u) / weight


def query_terms(text: Column) -> Column:
    """struct<positive, negative>: '-word' is negative, '+word' and others positive; all-negative text is taken literally."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    negative = F.transform(F.filter(tokens, lambda w: (F.length(w) > 1) & w.startswith("-")), lambda w: F.substring(w, F.lit(2), F.length(w)))
    rest = F.filter(tokens, lambda w: ~((F.length(w) > 1) & w.startswith("-")))
    positive = F.transform(rest, lambda w: F.when((F.length(w) > 1) & w.startswith("+"), F.substring(w, F.lit(2), F.length(w))).otherwise(w))
    literal = (F.size(positive) == 0) & (F.size(negative) > 0)
    return F.struct(
        F.when(literal, F.trim(text)).otherwise(F.array_join(positive, " ")).alias("positive"),
        F.when(literal, F.lit("")).otherwise(F.array_join(negative, " ")).alias("negative"),
    )


def title_score(title: Column) -> Column:
    """The number behind the last space of a title, or null."""
    return F.regexp_extract(title, r"^(.*) ([^ ]*)$", 2).try_cast("double")


def score_title(tag: Column, peak: Column) -> Column:
    return F.format_string("%s %.3f", tag, peak)


def safe_tag(text: Column) -> Column:
    """Anything but letters, digits, '-' and '_' becomes '_'."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def safe_name(text: Column, most: int = 120) -> Column:
    """Letters, digits and '-_.' stay, runs of others become '-'; cut to ``most``; never empty."""
    name = F.left(F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "-"), F.lit("-.")), F.lit(most))
    return F.when(name == "", "reel").otherwise(name)


def path_key(path: Column) -> Column:
    return F.concat(F.lit("path-"), F.left(F.sha1(path), F.lit(16)))


def fingerprint_key(fingerprints: Column, path: Column, order: tuple[str, ...] = ("oshash", "md5", "phash")) -> Column:
    """The preferred fingerprint, else any, else a key of the path."""
    wanted = [F.try_element_at(fingerprints, F.lit(k)) for k in order]
    return F.coalesce(*wanted, F.try_element_at(F.map_values(fingerprints), F.lit(1)), path_key(path))


def under_path(path: Column, base: str) -> Column:
    """The folder itself or anything in it, not a sibling that begins alike."""
    base = base.rstrip("/")
    return (path == base) | path.startswith(base + "/")


def clip_end(start: Column, end: Column, default: float = 20.0) -> Column:
    """A clip's end: ``default`` seconds long if it has none, or ends before it starts."""
    return F.when(end.isNull() | (end <= start), start + default).otherwise(end)


def recency_weight(ts: Column, now: Column, oldest: Column, halflife_days: float, floor: float = 0.05) -> Column:
    """0.5 ** (age / half-life), at least ``floor``; unknown times (0 or null) count as the oldest known."""
    known = F.when(ts.isNull() | (ts <= 0), oldest).otherwise(ts)
    return F.greatest(F.pow(F.lit(0.5), (now - known) / F.lit(86400.0 * halflife_days)), F.lit(floor))


def interval_signature(mode: Column, interval: Column) -> Column:
    """One number for how samples were taken: key frames -1, sparse -(100 + interval), else the interval."""
    return F.when(mode == "keyframes", -1.0).when(mode == "sparse", -(100.0 + interval)).otherwise(interval)


def plan_timestamps(duration: Column, interval: float, offset: float = 0.0) -> Column:
    """Array of times from offset on, every interval, before the end; empty for durations that hold none."""
    count = F.ceil((duration - offset) / interval).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.round(i * interval + offset, 3))
    return F.when((duration > 0) & (F.lit(interval) > 0) & (count > 0), F.filter(grid, lambda t: t < duration)).otherwise(F.array().cast("array<double>"))


def logged_times(text: Column) -> Column:
    """All pts_time values of a decoder log."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"pts_time:\s*([0-9.]+)"), 1), lambda x: x.try_cast("double"))


def uncertainty(p: Column) -> Column:
    return -F.abs(p - 0.5)


def hash_numbers(key: Column, dim: int) -> Column:
    """``dim`` numbers in 0 .. 2**32 - 1 that depend on the key alone."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", key, i.cast("string")), 256), 1, 8), 16, 10).cast("double"))


def stand_in_embedding(key: Column, dim: int) -> Column:
    """A unit vector that depends on the key alone: stands in for an embedding model in tests."""
    from .vectors import unit

    return unit(F.transform(hash_numbers(key, dim), lambda x: x / F.lit(2.0**31) - 1))


def stars(rating: Column) -> Column:
    """0 to 5 stars of a rating from 0 to 100; unrated has none, ratings outside count as the nearer end."""
    return F.least(F.greatest(F.floor(F.coalesce(rating, F.lit(0)) / 20 + 0.5), F.lit(0)), F.lit(5)).cast("int")


#: The two ends of the colour scale of heat strips, as red, green, blue.
COLD, HOT = (34, 34, 42), (200, 162, 74)


def heat_color(heat: Column) -> Column:
    """rgb(r,g,b) between COLD and HOT for a heat from 0 to 1; what lies outside counts as the nearer end."""
    x = F.least(F.greatest(heat, F.lit(0.0)), F.lit(1.0))
    parts = [F.floor(F.lit(float(a)) + F.lit(float(b - a)) * x + 0.5).cast("string") for a, b in zip(COLD, HOT, strict=True)]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))


def has_name(name: Column, asked: str) -> Column:
    """Whether a name contains the words asked for, in any case; asking for nothing finds every row, null names too."""
    wanted = asked.strip().lower()
    return F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(wanted)) if wanted else F.lit(True)


def link(base: str, *parts: Column, start: Column | None = None) -> Column:
    """An address under ``base``, from ``start`` seconds on if given and not null. It carries no key: whoever serves it adds that."""
    address = F.concat_ws("/", F.lit(base.rstrip("/")), *[p.cast("string") for p in parts])
    return address if start is None else F.concat(address, F.when(start.isNull(), "").otherwise(F.format_string("?start=%.3f", start.cast("double"))))
