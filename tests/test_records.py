"""Guards, re-keyed predictions, window tables, paired recordings, configurations, reports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import __main__ as command
from assayer import drivers
from assayer.operators import intervals, models
from assayer.sources import config, records
from assayer.sources.files import BadSource


def test_provenance_guard(spark):
    df = spark.createDataFrame([(1, False, "a"), (2, True, "z")], "k int, derived boolean, tier string")
    assert records.require_primary(df.where("k = 1"), "a band").count() == 1
    with pytest.raises(BadSource, match="1 are derived \\(z\\)"):
        records.require_primary(df, "a band")
    with pytest.raises(BadSource, match="derived"):
        records.require_primary(df.drop("derived"), "a band")
    with pytest.raises(BadSource, match="protocol"):
        records.require_columns(df, ["protocol", "tier"], "a table of results")


def test_predictions_fit_their_rows(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 1)], "id string, w int, y int")
    saved = rows.withColumn("margin", F.lit(0.5))
    keys = ["id", "w"]
    assert records.with_predictions(rows, saved, keys, ["y"]).columns == ["id", "w", "y", "margin"]
    for bad in (saved.where("id = 'a'"), saved.union(saved.limit(1)), saved.withColumn("y", 1 - F.col("y")), saved.withColumn("w", F.col("w") + 1)):
        with pytest.raises(BadSource):
            records.with_predictions(rows, bad, keys, ["y"])


def test_windows_are_sealed(spark, tmp_path):
    df = spark.createDataFrame([("a", k, "train" if k < 3 else "dev", [float(k)] * k) for k in range(6)], "id string, w int, split string, x array<double>")
    path, keys = str(tmp_path / "windows"), ["id", "w"]
    records.write_windows(df, path, keys)
    assert {r.w: r.x for r in records.read_windows(spark, path, keys, df).collect()} == {k: [float(k)] * k for k in range(6)}
    with pytest.raises(BadSource):
        records.read_windows(spark, path, keys, df.limit(2))
    spark.read.parquet(path).withColumn("x", F.array(F.lit(9.0))).write.parquet(str(tmp_path / "changed"))
    with pytest.raises(BadSource, match="changed"):
        records.read_windows(spark, str(tmp_path / "changed"), keys)


def test_paired_recordings(spark):
    one, two = [0.0, 0.5, 0.25, 0.0], [0.0, 0.4, 0.25, 0.0]
    def group(name, ref, other, duration=4 / 8, path="/root/x.wav"):
        return [(name, "real", "/root/r.wav", 4 / 8, ref), (name, "copy", path, duration, other)]
    rows = group("fine", one, two) + group("same", one, one) + group("short", one, two[:3], 3 / 8) + group("record", one, two, 0.6) + group("nan", one, two, math.nan) + group("out", one, two, path="/root/../etc/x.wav")
    df = spark.createDataFrame(rows, "g string, c string, path string, duration double, samples array<double>")
    out = {r.g: r.problem for r in records.paired_problems(df, "g", "c", "real", 8, "/root").collect()}
    assert out == {"fine": None, "same": "a member identical to the reference", "short": "members of different lengths", "record": "duration unlike the recording", "nan": "no usable duration", "out": "path outside the root"}


def test_log_without_progress(spark):
    text = "start\nreal:  3%|#  | 1/24\rreal:  38%|###   | 9/24\n 10/24 |\nfirst\rlast  \n\nend"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(records.without_progress(F.col("t"))).first()[0] == "start\nlast\nend"


def test_configurations(spark, tmp_path):
    path = tmp_path / "run.yaml"
    path.write_text("# a run\nlength: 64\nhop: 16   # samples\nsmoothing: 3\n")
    assert config.read_config(spark, str(path), config.Windowing) == config.Windowing(64, 16, 3)
    path.write_text("length: 64\nhop: 16\nhops: 1\n")
    with pytest.raises(BadSource, match="hops"):
        config.read_config(spark, str(path), config.Windowing)
    for bad in ({"length": True, "hop": 1}, {"length": 4, "hop": 5}, {"length": 4, "hop": 1, "smoothing": 2}):
        with pytest.raises(ValueError):
            config.Windowing(**bad)
    with pytest.raises(ValueError):
        config.Edits(10, 5, 0.5)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "marker.txt").write_text("x")
    assert config.find_folder(spark, str(tmp_path), "marker.txt").endswith("/a/b")
    with pytest.raises(BadSource):
        config.find_folder(spark, str(tmp_path), "nothing.txt", 2)


def test_models_are_saved_whole(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([((rng.standard_normal(3) + k * 2).tolist(), k) for k in (0, 1, 2) for _ in range(40)], "x array<double>, y int")
    many = models.logistic(df, "x", "y")
    assert many.score(df, "x").where("predicted = y").count() > 90
    models.save_model(spark, many, str(tmp_path / "m"))
    assert models.load_model(spark, str(tmp_path / "m")) == many
    spark.read.parquet(str(tmp_path / "m")).withColumn("body", F.regexp_replace("body", "0", "1")).write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError):
        models.load_model(spark, str(tmp_path / "n"))
    two = df.where("y < 2")
    frozen = models.Scaling([0.0] * 3, [1.0] * 3)
    assert models.logistic(two, "x", "y", scaling=frozen).scaling == frozen
    weighted = models.logistic(two.withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(1.0)), "x", "y", weight="w")
    repeated = models.logistic(two.union(two.where("y = 1")).union(two.where("y = 1")), "x", "y", scaling=weighted.scaling)
    assert weighted.weights[0] == pytest.approx(repeated.weights[0], abs=1e-3)


def test_gate_lies_below_the_first_rejected(spark):
    gate = lambda x, b: models.genuine_gate(spark.createDataFrame([(v,) for v in x], "m double"), "m", b).first().gate
    assert gate([0.0, 1.0, 2.0, 3.0], 0.25) == np.nextafter(1.0, 0) and gate([0.0, 0.0, 2.0, 3.0], 0.25) < 0
    cut = lambda x, b: models.confidence_cutoff(spark.createDataFrame([(v,) for v in x], "m double"), "m", b).first().cutoff
    assert cut([0.0, 0.0, 1.0, 2.0], 0.25) == 0 and cut([0.0, 1.0, 2.0, 3.0], 0.25) == 1


def test_overlaps_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(intervals, "STRETCH", 7)
    rng = np.random.default_rng(5)
    def some(n):
        a = rng.integers(0, 100, n)
        return [(int(k % 2), int(x), int(x + d)) for k, (x, d) in enumerate(zip(a, rng.integers(0, 40, n)))]
    left, right = some(40), some(40)
    a, b = spark.createDataFrame(left, "k int, a int, b int"), spark.createDataFrame(right, "k int, c int, d int")
    found = sorted((r.k, r.a, r.b, r.c, r.d) for r in intervals.overlaps(a, b, ["k"], ("a", "b"), ("c", "d")).collect())
    assert found == sorted((k, x, y, u, v) for k, x, y in left for j, u, v in right if k == j and x < y and u < v and x < v and u < y)


def test_guarded_core_is_never_empty(spark):
    df = spark.createDataFrame([(8, 30, 3)], "a int, b int, f int")
    assert tuple(intervals.guarded_core(df, "a", "b", "f", 2).select("core_start", "core_end").first()) == (14, 25)
    with pytest.raises(Exception, match="core"):
        intervals.guarded_core(df, "a", "b", "f", 9).collect()


def test_reports(spark, tmp_path):
    rng = np.random.default_rng(6)
    scores = [(c, float(rng.normal(m)), p, "t") for p in "xy" for c, m in (("real", 2.0), ("one", 0.0), ("two", 1.0)) for _ in range(60)]
    spark.createDataFrame(scores, "condition string, score double, protocol string, tier string").write.parquet(str(tmp_path / "scores"))
    out = str(tmp_path / "out")
    command.main(["detection", "--scores", str(tmp_path / "scores"), "--out", out, "--draws", "40"], spark)
    found = {(r.protocol, r.condition): r for r in spark.read.parquet(f"{out}/error_rates").collect()}
    assert set(found) == {(p, c) for p in "xy" for c in ("one", "two")}
    assert all(r.low <= r.eer <= r.high or abs(r.eer - r.low) < 0.1 for r in found.values()) and found["x", "one"].eer < found["x", "two"].eer
    with pytest.raises(FileExistsError):
        command.main(["detection", "--scores", str(tmp_path / "scores"), "--out", out, "--draws", "40"], spark)
    with pytest.raises(BadSource):
        drivers.quality(spark, str(tmp_path / "scores"), out, ("nothing",))
    drivers.quality(spark, str(tmp_path / "scores"), f"{out}/quality", ("condition",), ("score",))
    assert spark.read.parquet(f"{out}/quality/summary").count() == 3

    rows = [(f"i{k}", "train" if k % 3 else "eval", k % 2, (rng.standard_normal(4) + 2 * (k % 2)).tolist()) for k in range(90)]
    spark.createDataFrame(rows, "id string, split string, label int, features array<double>").write.parquet(str(tmp_path / "features"))
    drivers.pilot(spark, str(tmp_path / "features"), f"{out}/pilot")
    assert spark.read.parquet(f"{out}/pilot/metrics").first().auroc > 0.8
    drivers.predict(spark, f"{out}/pilot/model", str(tmp_path / "features"), f"{out}/predicted")
    assert spark.read.parquet(f"{out}/predicted/predictions").count() == 90

    rows = [(f"i{k}", ("fit", "calibration", "held")[k % 3], (None, 0, 1, -1)[k % 4], float(k % 4 and 1 - k % 4), (rng.standard_normal(3) + 3 * np.eye(3)[k % 4 % 3]).tolist()) for k in range(240)]
    spark.createDataFrame(rows, "id string, split string, source int, margin double, features array<double>").write.parquet(str(tmp_path / "sources"))
    drivers.verification(spark, str(tmp_path / "sources"), f"{out}/verification")
    assert spark.read.parquet(f"{out}/verification/decisions").count() == 80

    windows = [(e, 100, s, 20, 0.9 if 30 <= s + 10 < 60 else 0.1) for e in "ab" for s in range(0, 81, 10)]
    runs = [(e, a, b, y) for e in "ab" for a, b, y in ((0, 30, 0), (30, 60, 1), (60, 100, 0))]
    spark.createDataFrame(windows, "example_id string, size long, start long, length int, probability double").write.parquet(str(tmp_path / "windows"))
    spark.createDataFrame(runs, "example_id string, run_start long, run_end long, label int").write.parquet(str(tmp_path / "runs"))
    drivers.localization(spark, str(tmp_path / "windows"), str(tmp_path / "runs"), f"{out}/localization")
    r = spark.read.parquet(f"{out}/localization/overall").first()
    assert r.tp + r.fn == 60 and r.f1 > 0.8
    changed = [("before", 0.0), ("after", 1.0)]
    for name, add in changed:
        spark.createDataFrame([(f"s{k}", k % 5 + add) for k in range(40)], "source string, value double").write.parquet(str(tmp_path / name))
    drivers.paired(spark, str(tmp_path / "before"), str(tmp_path / "after"), f"{out}/paired", draws=50)
    r = spark.read.parquet(f"{out}/paired/change").first()
    assert r.low == pytest.approx(1) == r.high


def test_json_maps_and_plans(spark, tmp_path):
    from assayer.sources import files, sinks

    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "condition string, lag int, share double")
    sinks.write_map(df, "condition", str(tmp_path / "map.json"))
    back = files.read_map(spark, str(tmp_path / "map.json"), "struct<lag: int, share: double>")
    assert sorted(map(tuple, back.collect())) == [("a", 1, 0.5), ("b", 2, 0.25)]
    with pytest.raises(ValueError):
        sinks.write_map(df.union(df), "condition", str(tmp_path / "twice.json"))
    digest = sinks.write_plan(spark, {"seed": 1}, str(tmp_path / "plan.json"))
    assert sinks.planned(spark, str(tmp_path / "plan.json"), digest) == {"seed": 1}
    with pytest.raises(ValueError):
        sinks.planned(spark, str(tmp_path / "plan.json"), "0" * 64)
    with pytest.raises(Exception, match="exists"):
        sinks.write_plan(spark, {"seed": 2}, str(tmp_path / "plan.json"))


def test_intake(spark, tmp_path):
    from assayer.sources import files, intake, sinks

    rng = np.random.default_rng(7)
    audio = tmp_path / "audio"
    audio.mkdir()
    one, two = (rng.uniform(-0.5, 0.5, 4000).astype(np.float32) for _ in "ab")
    for name, x, rate in (("one", one, 16_000), ("two", two, 16_000), ("copy", two, 16_000), ("still", np.zeros(4000, np.float32), 16_000), ("short", one[:99], 16_000), ("rate", one, 22_050)):
        sinks.write_wave(x, str(audio / f"{name}.wav"), rate)
    (audio / "broken.wav").write_bytes(b"nothing")
    named = lambda df: df.withColumn("item", F.regexp_extract("path", "([a-z]+)[.]wav", 1))
    found = named(intake.measured(files.read_audio(spark, str(audio)), 16_000))
    members = spark.createDataFrame([(n,) for n in ("one", "two", "copy", "still", "short", "rate", "broken", "gone")], "item string")
    decided = intake.admitted(found, "item", ["samples_sha256"], members)
    out = {r["item"]: r.reason for r in decided.collect()}
    assert out == {"one": None, "two": "duplicate", "copy": "duplicate", "still": "silent", "short": "duration", "rate": "rate", "broken": "not a RIFF/WAVE file", "gone": "missing"}
    sealed = decided.join(files.inventory(spark, str(audio)).select("path", "sha256"), "path", "left")
    intake.seal_intake(sealed, str(tmp_path / "intake"))
    rows = intake.ingested(str(tmp_path / "intake"), str(audio), spark)
    assert intake.gate(rows, 1, rows.limit(0)).count() == 1
    for expected, broken in ((2, rows.limit(0)), (1, rows)):
        with pytest.raises(BadSource):
            intake.gate(rows, expected, broken)
    sinks.write_wave(two, str(audio / "one.wav"), 16_000)
    with pytest.raises(BadSource, match="changed"):
        intake.ingested(str(tmp_path / "intake"), str(audio), spark)
    probed = {r.path.rpartition("/")[2]: r for r in files.probe_audio(spark, str(audio)).collect()}
    whole = {r.path.rpartition("/")[2]: r for r in files.read_audio(spark, str(audio)).drop("samples").collect()}
    assert probed == whole


def test_names_select(spark):
    from assayer.operators import selection as S

    df = spark.createDataFrame([(1, "a", 2.0, 0.5), (2, "b", 1.0, None), (3, "c", 3.0, 1.0)], "k int, c string, x double, y double")
    assert [r.k for r in S.tier(df, "c", "a").collect()] == [1]
    for bad in (lambda: S.tier(df, "tier", "a"), lambda: S.metric(df, "x-z"), lambda: S.metric(df, "x-y-x")):
        with pytest.raises(ValueError):
            bad()
    assert df.select(S.metric(df, "x-y")).first()[0] == 1.5 and df.select(S.metric(df, "x")).first()[0] == 2
    assert {r.k: r.y for r in S.label_index(df, "c", ["c", "a"]).collect()} == {3: 0, 1: 1}
    assert tuple(S.refused(df, "c", df.where("k > 1")).first()) == ("b,c", 2)
    assert tuple(S.refused(df, "c", df.limit(0)).first()) == ("", 0)
    names = df.select(S.status(F.col("y"), [(0.6, "low"), (0.9, "mid")], "high").alias("s"))
    assert [r.s for r in names.collect()] == ["low", "missing", "high"]
    paths = spark.createDataFrame([("a/cache/x",), ("a/cached/x",), ("b?x",)], "p string")
    assert [r.p for r in S.kept_paths(paths, "p", ["cache"], ["?"]).collect()] == ["a/cached/x"]
