"""Command line: ``python -m heliograph [--data FOLDER] COMMAND ...``.

The folder has the application's tables as Parquet: ``samples`` (item_key, item_id, t, vec, vec_id), and, as far as
the command needs them, ``verdicts``, ``markers``, ``bridge``, ``details``, ``vocabulary`` and ``items``. Settings come
from the document kept in the folder, if there is one. Results are printed, or written as Parquet with ``--out``.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import learning
from .service import Library
from .sources import stores
from .sources.settings import as_rows, checked, load_settings, save_settings

TABLES = ("verdicts", "markers", "bridge", "details", "vocabulary")
SHOWN = 50


def library(spark: SparkSession, folder: str) -> Library:
    """The folder's tables as a library; those that are not there are None."""
    there = {n: spark.read.parquet(f"{folder}/{n}") for n in TABLES if _exists(spark, f"{folder}/{n}")}
    return Library(spark.read.parquet(f"{folder}/samples"), **there, settings=load_settings(spark, folder))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _key(text: str, samples: DataFrame):
    """An item's key as the samples have it."""
    return int(text) if dict(samples.dtypes)["item_key"] in ("bigint", "int") else text


def _similar(lib: Library, a) -> DataFrame:
    return lib.similar(_key(a.item, lib.samples), a.at, a.min_score)


def _duplicates(lib: Library, a) -> DataFrame:
    return lib.duplicates(_key(a.item, lib.samples), a.at)


def _segments(lib: Library, a) -> DataFrame:
    references = lib.samples.where(lib.samples.item_key == _key(a.like, lib.samples)) if a.like is not None else None
    return lib.segments(lib.scores(references))


def _train(lib: Library, a) -> DataFrame:
    model = lib.train(auto=not a.logistic)
    kind = "logistic" if hasattr(model, "coefficients") else "perceptron"
    learning.save(model, f"{a.data}/models/{a.profile}", a.profile, lib.settings.dim, kind)
    return learning.saved(lib.spark, f"{a.data}/models")


def _set(lib: Library, a) -> DataFrame:
    given = {k: json.loads(v) for k, _, v in (p.partition("=") for p in a.values)}
    lib.settings = lib.settings.changed(**checked(given))
    save_settings(lib.spark, a.data, lib.settings)
    return as_rows(lib.spark, lib.settings)


def _playlist(lib: Library, a) -> DataFrame:
    from .operators.catalog import playlist

    clips = playlist(lib.markers, a.tags, limit=a.limit or None)
    stores.write_playlist(clips, f"{a.data}/playlists/{a.name}", ", ".join(a.tags))
    return stores.read_playlist(lib.spark, f"{a.data}/playlists/{a.name}")[1]


def _statistics(lib: Library, a) -> DataFrame:
    return lib.statistics(lib.spark.read.parquet(f"{a.data}/items"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heliograph", description=__doc__.splitlines()[0])
    p.add_argument("--data", default=".", help="folder of the tables")
    p.add_argument("--out", help="write the result there instead of printing it")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, run: Callable[[Library, argparse.Namespace], DataFrame], *args: tuple) -> None:
        c = sub.add_parser(name, help=help_)
        for flags, options in args:
            c.add_argument(*flags.split(), **options)
        c.set_defaults(run=run)

    item, at = ("item", {}), ("--at", {"type": float, "default": 0.0})
    floor, seed = ("--min-score", {"type": float}), ("--seed", {"default": ""})
    count = ("--count", {"type": int, "default": 30})
    command("similar", "samples like one", _similar, item, at, floor)
    command("text", "samples by vocabulary terms", lambda lib, a: lib.text(a.positive, a.negative, a.min_score), ("positive", {}), ("--negative", {}), floor)
    command("duplicates", "near copies of a sample in other items", _duplicates, item, at)
    command("timeline", "an item's samples against a term", lambda lib, a: lib.timeline(_key(a.item, lib.samples), a.term), item, ("term", {}))
    command("tags", "items by their best terms", lambda lib, a: lib.tags(a.count, a.min_score), count, floor)
    command("segments", "stretches that score high", _segments, ("--like", {"help": "score by likeness to this item"}))
    command("bands", "score cut-offs", lambda lib, a: lib.bands())
    command("survival", "share of samples above each score", lambda lib, a: lib.survival())
    command("threshold", "what a cut-off keeps", lambda lib, a: lib.at_threshold(a.value), ("value", {"type": float}))
    command("board", "a draw of good moments", lambda lib, a: lib.board(a.count, a.seed, floor=a.min_score), count, seed, floor)
    command("recommend", "the feed", lambda lib, a: lib.recommend(a.count, a.seed, min_score=a.min_score), count, seed, floor)
    command("next", "the sample to label next", lambda lib, a: lib.next_to_label(seed=a.seed), seed)
    command("leaderboard", "entities by preference", lambda lib, a: lib.leaderboard(a.by), ("--by", {"default": "affinity"}))
    command("map", "items in the plane, with clusters", lambda lib, a: lib.map())
    command("stats", "counts of the library", _statistics)
    command("train", "train and keep a model", _train, ("--profile", {"default": "default"}), ("--logistic", {"action": "store_true"}))
    command("models", "models kept", lambda lib, a: learning.saved(lib.spark, f"{a.data}/models"))
    command("settings", "show settings", lambda lib, a: as_rows(lib.spark, lib.settings))
    command("set", "change settings: NAME=JSON ...", _set, ("values", {"nargs": "+"}))
    command("playlist", "clips of markers by tag", _playlist, ("name", {}), ("tags", {"nargs": "+"}), ("--limit", {"type": int, "default": 0}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("heliograph").getOrCreate()
    try:
        result = args.run(library(spark, args.data), args)
        if args.out:
            result.write.mode("overwrite").parquet(args.out)
        else:
            result.show(SHOWN, truncate=False)
    except ValueError as e:
        print(f"heliograph: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
