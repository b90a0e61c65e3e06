"""Settings kept as one JSON document, checked when they are written and when they are read."""

from __future__ import annotations

import json
import math
import typing
from dataclasses import asdict, fields
from types import UnionType

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..service import Settings

#: (smallest, largest) values that make sense; settings without an entry are not limited.
RANGES = {
    "dim": (1, 65_536), "top_k": (1, 1_000_000), "per_item": (1, 10_000), "min_duration": (0.0, math.inf), "merge_gap": (0.0, math.inf),
    "max_duration": (0.0, math.inf), "padding": (0.0, math.inf), "smooth_window": (1, 10_001), "duplicate_floor": (-1.0, 1.0),
    "autotrain_every": (0, 1_000_000), "halflife_days": (0.0, math.inf), "modes": (1, 10_000), "diversity": (0.0, 1.0),
}
CHOICES = {"normalise": ("item-z", "none")}


def checked(values: dict) -> dict:
    """``values`` with numbers of the settings' own types; ValueError names all that is wrong."""
    kinds, wrong, out = typing.get_type_hints(Settings), [], {}
    for name, value in values.items():
        if name not in kinds:
            wrong.append(f"{name} is not a setting")
            continue
        allowed = typing.get_args(kinds[name]) if isinstance(kinds[name], UnionType) else (kinds[name],)
        if value is None and type(None) in allowed:
            out[name] = None
        elif isinstance(value, bool) or not isinstance(value, (int, float) if float in allowed else allowed):
            wrong.append(f"{name} has the wrong type")
        elif isinstance(value, float) and not math.isfinite(value):
            wrong.append(f"{name} is not a finite number")
        elif name in RANGES and not RANGES[name][0] <= value <= RANGES[name][1]:
            wrong.append(f"{name} is not within {RANGES[name][0]} and {RANGES[name][1]}")
        elif name in CHOICES and value not in CHOICES[name]:
            wrong.append(f"{name} is none of {', '.join(CHOICES[name])}")
        else:
            out[name] = float(value) if float in allowed else value
    high, low = out.get("high", Settings.high), out.get("low", Settings.low)
    if low is not None and low > high:
        wrong.append("low is above high")
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def save_settings(spark: SparkSession, folder: str, settings: Settings) -> None:
    """Keep what differs from the defaults, in one step: the document is written beside and then put in place."""
    own = checked({f.name: getattr(settings, f.name) for f in fields(settings) if getattr(settings, f.name) != f.default})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}") for name in ("settings.json", ".settings.new"))
    files = at.getFileSystem(conf)
    out = files.create(new, True)
    try:
        out.write(bytearray(json.dumps(own, indent=1, sort_keys=True).encode()))
    finally:
        out.close()
    files.delete(at, False)
    files.rename(new, at)


def load_settings(spark: SparkSession, folder: str) -> Settings:
    """The settings kept in a folder over the defaults; without a document, or with one that is not JSON, the defaults.

    A document whose values are out of range or unknown is an error: somebody has written it by hand.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/settings.json")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return Settings()
    text = spark.read.text(f"{folder}/settings.json", wholetext=True).agg(F.max("value")).first()[0]
    try:
        own = json.loads(text or "{}")
    except ValueError:
        return Settings()
    return Settings(**checked(own)) if isinstance(own, dict) else Settings()


def as_rows(spark: SparkSession, settings: Settings):
    """(name, value, kept): every setting, and whether it differs from its default."""
    plain = asdict(Settings())
    rows = [(k, None if v is None else str(v), v != plain[k]) for k, v in asdict(settings).items()]
    return spark.createDataFrame(rows, "name string, value string, kept boolean")
