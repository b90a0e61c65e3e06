"""Settings, playlists, listings and the command line."""

import json
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.__main__ import main
from heliograph.service import Settings
from heliograph.sources import stores
from heliograph.sources.settings import as_rows, checked, load_settings, save_settings


def test_settings_come_back(spark, tmp_path):
    at = str(tmp_path)
    assert load_settings(spark, at) == Settings()
    mine = Settings(top_k=7, high=0.5, low=0.25, normalise="none", max_duration=0.0)
    save_settings(spark, at, mine)
    assert load_settings(spark, at) == mine
    assert set(json.loads((tmp_path / "settings.json").read_text())) == {"top_k", "high", "low", "normalise", "max_duration"}
    kept = {r.name for r in as_rows(spark, mine).collect() if r.kept}
    assert kept == {"top_k", "high", "low", "normalise", "max_duration"}
    save_settings(spark, at, replace(mine, top_k=8))
    assert load_settings(spark, at).top_k == 8


def test_damaged_settings(spark, tmp_path):
    for text in ("{", "", "[1]", "not json"):
        (tmp_path / "settings.json").write_text(text)
        assert load_settings(spark, str(tmp_path)) == Settings()
    (tmp_path / "settings.json").write_text('{"top_k": 0, "colour": 1}')
    with pytest.raises(ValueError, match="colour is not a setting") as e:
        load_settings(spark, str(tmp_path))
    assert "top_k is not within" in str(e.value)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from([*Settings.__dataclass_fields__, "other"]), st.one_of(st.integers(-5, 50), st.floats(), st.booleans(), st.none(), st.text(max_size=3), st.sampled_from(["none", "item-z"])), max_size=4))
def test_checked_settings_make_settings(values):
    try:
        good = checked(values)
    except ValueError:
        return
    assert set(good) == set(values)
    made = Settings(**good)
    assert isinstance(made.top_k, int) and isinstance(made.high, float) and (made.low is None or made.low <= made.high)


def test_playlist_documents(spark, tmp_path):
    clips = spark.createDataFrame([("a", 1.0, 21.0, 20.0, "x 0.5", "u", 0.5), ("b", 2.0, 9.0, 7.0, "é", None, None)], stores.PLAYLIST)
    assert stores.write_playlist(clips, str(tmp_path / "p"), "x, y") == 2
    tag, back = stores.read_playlist(spark, str(tmp_path / "p"))
    assert tag == "x, y" and sorted(map(tuple, back.collect())) == sorted(map(tuple, clips.collect()))
    clips.limit(1).write.mode("overwrite").json(str(tmp_path / "p" / "clips"))
    with pytest.raises(ValueError, match="not whole"):
        stores.read_playlist(spark, str(tmp_path / "p"))


def test_models_keys_and_broken_files_of_the_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    assert stores.sample_models(spark, at) == []
    rows = [(m, f"k{i}", "i", "p", float(i), [1.0], 8.0) for m in ("clip", "d/ino 2") for i in range(5)]
    stores.write_samples(spark.createDataFrame(rows, stores.SAMPLES), at)
    assert stores.sample_models(spark, at) == ["clip", "d/ino 2"]
    cached = stores.read_samples(spark, at, "clip")
    for keys in (["k1", "k3", None, "k1", "gone"], ["k1", "k3", *map(str, range(1500))]):
        found = stores.with_keys(cached, keys)
        assert sorted(r.item_key for r in found.collect()) == ["k1", "k3"]
    plan = stores.with_keys(cached, ["k1", "k3"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(item_key, [k1,k3])" in plan
    assert stores.unreadable(spark, at) == 0
    (tmp_path / "cache" / "model=clip" / "part-broken.parquet").write_bytes(b"PAR1 was cut off")
    assert stores.unreadable(spark, at) == 1 and stores.read_samples(spark, at, "clip").count() == 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("library")
    rows = [(k, f"i{k}", float(8 * t), [float((k + t) % 5), 1.0, float(k % 3)], 10 * k + t) for k in range(12) for t in range(6)]
    frame = spark.createDataFrame(rows, "item_key long, item_id string, t double, vec array<double>, vec_id long")
    frame.write.parquet(f"{at}/samples")
    said = [(n, k, 8.0 * (n % 6), int(k % 3 == 2), "default", float(n)) for n, k in enumerate(list(range(12)) * 2)]
    spark.createDataFrame(said, "seq long, item_key long, t double, label int, profile string, ts double").write.parquet(f"{at}/verdicts")
    spark.createDataFrame([("sea", [1.0, 0.0, 0.0]), ("hill", [0.0, 0.0, 1.0])], "term string, vec array<double>").write.parquet(f"{at}/vocabulary")
    marks = spark.createDataFrame([(1, 3, 8.0, None, "sea 0.9")], "marker_id long, item_key long, start double, end double, title string")
    marks.selectExpr("*", "'sea' AS tag").write.parquet(f"{at}/markers")
    spark.createDataFrame([(60.0, 1)], "duration double, markers int").write.parquet(f"{at}/items")
    return str(at)


def run(spark, folder, tmp_path, *args):
    assert main(["--data", folder, "--out", str(tmp_path / "out"), *args], spark) == 0
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize(("args", "columns"), [
    (["similar", "3", "--at", "9"], {"item_key", "score"}), (["text", "sea", "--negative", "hill"], {"score"}), (["duplicates", "3"], {"score"}),
    (["timeline", "3", "sea"], {"t", "score"}), (["tags", "--count", "1"], {"term"}), (["bands"], {"pct", "cutoff"}), (["survival"], {"cutoff"}),
    (["threshold", "0.5"], set()), (["board", "--count", "5", "--seed", "a"], {"vec_id"}), (["next", "--seed", "b"], {"vec_id"}),
    (["stats"], {"hours"}), (["settings"], {"name", "value"}), (["segments", "--like", "2"], {"start", "end"}),
])
def test_commands(spark, folder, tmp_path, args, columns):
    found = run(spark, folder, tmp_path, *args)
    assert columns <= set(found.columns)
    if args[0] in ("similar", "text", "timeline", "tags", "bands", "survival", "board", "stats", "settings"):
        assert not found.isEmpty()
    if args[0] == "similar":
        assert not found.where("item_key = 3").count()
    if args[0] == "board":
        assert found.count() == 5


def test_commands_that_keep_something(spark, folder, tmp_path, capsys):
    assert run(spark, folder, tmp_path, "train", "--logistic").select("profile", "kind").first() == ("default", "logistic")
    assert run(spark, folder, tmp_path, "models").count() == 1
    assert run(spark, folder, tmp_path, "playlist", "mine", "sea").first().start == 8.0
    run(spark, folder, tmp_path, "set", "top_k=3", 'normalise="none"')
    assert load_settings(spark, folder) == Settings(top_k=3, normalise="none")
    assert run(spark, folder, tmp_path, "similar", "3").count() <= 3
    assert main(["--data", folder, "set", "top_k=-1"], spark) == 2 and "top_k" in capsys.readouterr().err
    assert main(["--data", folder, "settings"], spark) == 0 and "normalise" in capsys.readouterr().out
