"""Scans: checked CSV, piped text, side tables, wave files, directory inventories."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BadSource(ValueError):
    """A scan's input isn't what its contract says."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header that has every column of the schema, in any order; other columns are left out."""
    header = spark.read.option("header", True).csv(path)
    if missing := [f.name for f in schema if f.name not in header.columns]:
        raise BadSource(f"{path} lacks {missing}")
    # The file's own order, with the asked-for types; nothing is inferred.
    wanted = {f.name: f.dataType for f in schema}
    own = T.StructType([T.StructField(c, wanted.get(c, T.StringType())) for c in header.columns])
    return spark.read.schema(own).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path).select(*wanted)


def resolve_paths(df: DataFrame, root: str, existing: DataFrame) -> DataFrame:
    """Relative paths under the root; absolute ones, of either kind of system, moved there if that file exists
    (existing: path), else as they are. Adds resolved and relocated."""
    parts = F.split(F.regexp_replace("path", "\\\\", "/"), "/")
    absolute = F.col("path").rlike(r"^(/|[A-Za-z]:|\\\\)")
    moved = F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice(parts, -2, 2), "/"))
    there = existing.select(F.col("path").alias("_there")).distinct()
    out = df.withColumn("_moved", moved).join(there, F.col("_moved") == F.col("_there"), "left")
    relocated = absolute & F.col("_there").isNotNull()
    resolved = F.when(relocated, F.col("_moved")).when(absolute, F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    return out.withColumns({"resolved": resolved, "relocated": relocated}).drop("_moved", "_there")


def read_piped(spark: SparkSession, path: str) -> DataFrame:
    """Lines id|raw|normalised: utt_id and text (the third field, or null), by id; blank lines are skipped."""
    parts = F.split("value", "\\|")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[0]).alias("utt_id"), F.when(F.size(parts) > 2, parts[2]).alias("text")).orderBy("utt_id")


def read_side_table(spark: SparkSession, path: str, prefix: str = "p") -> DataFrame:
    """Blank-separated id and up to three more fields; header, comments and blanks are skipped; a bare number gets the
    prefix; a repeated id is an error."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and v not rlike '^(#|;|ID\\\\b)'")
    parts = F.split("v", "\\s+", 4)
    one = F.when(parts[0].rlike("^[0-9]+$"), F.concat(F.lit(prefix), parts[0])).otherwise(parts[0])
    out = rows.select(one.alias("id"), *(F.get(parts, F.lit(i)).alias(f"field_{i}") for i in (1, 2, 3)))
    if again := out.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect():
        raise BadSource(f"repeated ids {[r.id for r in again]}")
    return out


def read_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document that maps names to records: name and the record's fields."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {schema}>", {"mode": "FAILFAST"}).alias("m"))
    return rows.select(F.explode("m").alias("name", "r")).select("name", "r.*")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest of an inventory, the same in any order of its rows: of 4,096 buckets' digests, each of its sorted lines."""
    lines = files.select(F.concat_ws(" ", "sha256", "path").alias("line"), F.substring(F.sha2("path", 256), 1, 3).alias("bucket"))
    buckets = lines.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "bucket", "d"))), "\n")
    return buckets.agg(F.sha2(whole, 256).alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


_WAVE = "path string, rate int, channels int, bits int, frames long, duration double, problem string"


def _header(data: bytes) -> tuple[tuple, bytes]:
    """(rate, channels, bits, frames, duration, problem) and the samples' bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return (None, None, None, None, None, "not a RIFF/WAVE file"), b""
    try:
        with wave.open(io.BytesIO(data)) as w:
            n = w.getnframes()
            return (w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), n, n / w.getframerate(), None), w.readframes(n)
    except (wave.Error, EOFError) as e:
        return (None, None, None, None, None, f"unreadable: {e}"), b""


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads, samples = [], []
        for x in batch.column("content"):
            head, data = _header(x.as_py())
            if head[5] is None and head[2] != 16:
                head = (*head[:5], "not PCM of 16 bits")
            heads.append(head)
            own = np.frombuffer(data, "<i2").reshape(-1, head[1]).astype(np.float32) / 32768 if head[5] is None else np.empty((0, 1), np.float32)
            samples.append(own.mean(1, dtype=np.float64).astype(np.float32) if own.size else own[:, 0])
        rate, channels, bits, frames, duration, problem = (list(x) for x in zip(*heads)) if heads else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rate, pa.int32()), pa.array(channels, pa.int32()), pa.array(bits, pa.int32()), pa.array(frames, pa.int64()), pa.array(duration, pa.float64()), pa.array(problem, pa.string()), pa.array(samples, pa.list_(pa.float32()))], names=["path", "rate", "channels", "bits", "frames", "duration", "problem", "samples"])


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """16-bit wave files at their own rate, channels averaged to one: header columns, samples (array<float>), problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInArrow(_decode, f"{_WAVE}, samples array<float>")


def _little(data: Column, at: int, size: int) -> Column:
    """An unsigned number of ``size`` bytes, the lowest first, at a 1-based place."""
    digits = F.concat(*(F.hex(F.substring(data, at + k, 1)) for k in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def probe_audio(spark: SparkSession, path: str) -> DataFrame:
    """Header columns only, by expressions on a file's first bytes: no sample is decoded. A header whose chunks don't stand in the
    plain order (fmt, then data) is read like any other file's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    head = files.select("path", "length", F.substring("content", 1, 44).alias("h"))
    text = lambda at: F.substring(F.col("h"), at, 4).cast("string")
    plain = (text(1) == "RIFF") & (text(9) == "WAVE") & (text(13) == "fmt ") & (_little(F.col("h"), 17, 4) == 16) & (text(37) == "data")
    named = {"channels": (23, 2), "rate": (25, 4), "align": (33, 2), "bits": (35, 2), "bytes": (41, 4)}
    rows = head.where(plain & (F.col("length") >= 44)).select("path", "length", *(_little(F.col("h"), *where).alias(n) for n, where in named.items()))
    frames = F.floor(F.least(F.col("bytes"), F.col("length") - 44) / F.col("align"))
    rows = rows.where("align > 0 and rate > 0").select(
        "path", F.col("rate").cast("int").alias("rate"), F.col("channels").cast("int").alias("channels"), F.col("bits").cast("int").alias("bits"),
        frames.alias("frames"), (frames / F.col("rate")).alias("duration"), F.when(F.col("bits") != 16, "not PCM of 16 bits").alias("problem"),
    )
    others = files.join(rows.select("path"), "path", "left_anti").select("path", "content")
    return rows.unionByName(others.mapInArrow(_decode, f"{_WAVE}, samples array<float>").drop("samples"))


def checked_audio(audio: DataFrame, rate: int, most_peak: float = 10 ** (-1 / 20), seconds: tuple[float, float] = (0.1, 60.0)) -> DataFrame:
    """Adds reason: the first rule that a recording breaks, null if none."""
    peak = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("rate") != rate, "rate").when(F.col("channels") != 1, "channels")
        .when((F.col("duration") < seconds[0]) | (F.col("duration") > seconds[1]), "duration").when(F.exists("samples", lambda x: F.isnan(x)), "not finite").when(peak > most_peak, "peak")
    )
    return audio.withColumn("reason", reason)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def read_json_row(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
