import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators import constraints
from assayer.sources import files, sinks

SCHEMA = T.StructType([T.StructField("utt_id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("extra,n,utt_id\nx,3,u1\ny,,u2\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()] == [("u1", 3), ("u2", None)]
    (tmp_path / "b.csv").write_text("n\n3\n")
    with pytest.raises(files.BadSource):
        files.read_csv(spark, str(tmp_path / "b.csv"), SCHEMA)


def test_piped_and_side_tables(spark, tmp_path):
    (tmp_path / "p").write_text("b|x|y\n\na|z\n")
    assert [tuple(r) for r in files.read_piped(spark, str(tmp_path / "p")).collect()] == [("a", None), ("b", "y")]
    (tmp_path / "s").write_text("ID AGE\n# c\n225 23 F English, London\np226 22 M\n")
    assert [tuple(r) for r in files.read_side_table(spark, str(tmp_path / "s")).collect()] == [("p225", "23", "F", "English, London"), ("p226", "22", "M", None)]
    (tmp_path / "t").write_text("225 23\np225 24\n")
    with pytest.raises(files.BadSource):
        files.read_side_table(spark, str(tmp_path / "t"))


def test_paths(spark):
    df = spark.createDataFrame([("a/b.wav",), ("/old/real/x.wav",), ("C:\\old\\real\\y.wav",), ("/else/z.wav",)], "path string")
    there = spark.createDataFrame([("/new/real/x.wav",), ("/new/real/y.wav",)], "path string")
    found = {r.path: (r.resolved, r.relocated) for r in files.resolve_paths(df, "/new", there).collect()}
    assert found == {"a/b.wav": ("/new/a/b.wav", False), "/old/real/x.wav": ("/new/real/x.wav", True), "C:\\old\\real\\y.wav": ("/new/real/y.wav", True), "/else/z.wav": ("/else/z.wav", False)}


def test_json_map(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": {"x": 1.5}, "b": {"x": None}}, indent=1))
    assert sorted((r.name, r.x) for r in files.read_map(spark, str(tmp_path / "m.json"), "struct<x: double>").collect()) == [("a", 1.5), ("b", None)]


def test_waves(spark, tmp_path):
    x = np.sin(np.arange(16_000) / 20).astype(np.float32) * 0.5
    sinks.write_wave(x, str(tmp_path / "a.wav"), 16_000)
    (tmp_path / "b.wav").write_bytes(b"nothing")
    found = {r.path.rpartition("/")[2]: r for r in files.checked_audio(files.read_audio(spark, str(tmp_path)), 16_000).collect()}
    assert found["a.wav"].reason is None and found["a.wav"].frames == 16_000
    assert np.abs(np.array(found["a.wav"].samples) - x).max() <= 1 / 32768
    assert found["b.wav"].reason == "not a RIFF/WAVE file"
    assert {r.reason for r in files.checked_audio(files.read_audio(spark, str(tmp_path / "a.wav")), 22_050).collect()} == {"rate"}
    with pytest.raises(ValueError):
        sinks.write_wave(x, str(tmp_path / "c.wav"), 44_100)


def test_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a").write_bytes(b"x")
    (tmp_path / "d/b").write_bytes(b"yy")
    found = files.inventory(spark, str(tmp_path / "d"))
    assert sorted(r.bytes for r in found.collect()) == [1, 2]
    assert files.tree_digest(found).first() == files.tree_digest(found.orderBy(F.desc("path"))).first()


def test_publish_is_all_or_nothing(spark, tmp_path):
    df = spark.range(5)
    target = str(tmp_path / "out")
    with pytest.raises(constraints.Violation):
        sinks.publish(df, target, lambda x: constraints.require(x.where("id > 3"), "small ids"))
    assert not list(tmp_path.glob("out*"))
    sinks.publish(df, target, lambda x: constraints.require(x.where("id > 4"), "small ids"))
    assert spark.read.parquet(target).count() == 5
    with pytest.raises(FileExistsError):
        sinks.publish(df, target)


def test_json_refuses_nan(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "x.json"))


def test_manifest_and_seal(spark, tmp_path):
    df = spark.createDataFrame([("u2", "/r/b.wav"), ("u1", "/r/a.wav")], "utt_id string, path string")
    sinks.write_manifest(df, str(tmp_path / "m"), ["utt_id", "path"], ["utt_id"], "/r")
    back = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(r.path for r in back.collect()) == ["a.wav", "b.wav"]
    assert files.same_rows(sinks.seal(back, ["utt_id"]), sinks.seal(back.orderBy(F.desc("utt_id")), ["utt_id"]))
    with pytest.raises(ValueError):
        sinks.write_manifest(df, str(tmp_path / "n"), ["utt_id", "path"], ["utt_id"], "/other")
    assert [tuple(r) for r in sinks.flat_record(spark.sql("select array(1, 2) as a, null as b, true as c")).collect()] == [("[1,2]", "null", "true")]
