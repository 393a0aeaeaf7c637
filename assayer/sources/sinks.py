"""Writers whose output is checked, sorted or sealed."""

from __future__ import annotations

import hashlib
import json
import math
import os
import shutil
import uuid
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_manifest(df: DataFrame, path: str, columns: list[str], order: list[str], root: str) -> None:
    """Exactly these columns, sorted, with paths relative to the root; a path outside it is refused."""
    base = root.rstrip("/") + "/"
    outside = df.where(F.col("path").startswith("/") & ~F.col("path").startswith(base)).limit(3).collect()
    if outside:
        raise ValueError(f"paths outside {root}: {[r.path for r in outside]}")
    relative = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 20)).otherwise(F.col("path"))
    df.withColumn("path", relative).select(*columns).orderBy(*order).write.mode("errorifexists").parquet(path)


def flat_record(df: DataFrame) -> DataFrame:
    """Every column as text: nested ones, booleans and nulls as JSON."""
    def text(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.to_json(c), F.lit("null"))
        return F.coalesce(c.cast("string"), F.lit("null"))

    return df.select(*(text(f).alias(f.name) for f in df.schema))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file, in any store that Spark writes to; an existing one is refused."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _few(rows: DataFrame, most: int) -> list[dict]:
    found = [r.asDict(True) for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows aren't a JSON document")
    return found


def write_json(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small table as one JSON document with sorted keys; NaN and infinities are refused, as is a table above ``most`` rows."""
    write_text(rows.sparkSession, json.dumps(_few(rows, most), sort_keys=True, indent=1, allow_nan=False), path)


def write_map(rows: DataFrame, key: str, path: str, most: int = 10_000) -> None:
    """A small table as one JSON map from its key, which must be unique, to the other columns. files.read_map() reads it."""
    found = _few(rows, most)
    out = {str(r.pop(key)): r for r in found}
    if len(out) < len(found):
        raise ValueError(f"{key} repeats")
    write_text(rows.sparkSession, json.dumps(out, sort_keys=True, indent=1, allow_nan=False), path)


def write_plan(spark: SparkSession, plan: dict, path: str) -> str:
    """A plan that is written before any result is; returns its digest. It can't be written twice."""
    body = json.dumps(plan, sort_keys=True, indent=1, allow_nan=False)
    write_text(spark, body, path)
    return hashlib.sha256(body.encode()).hexdigest()


def planned(spark: SparkSession, path: str, digest: str) -> dict:
    """The plan of write_plan(), if it is still what was written."""
    body = spark.read.text(path, wholetext=True).first()[0]
    if hashlib.sha256(body.encode()).hexdigest() != digest:
        raise ValueError(f"{path} isn't the plan that was written")
    return json.loads(body)


def publish(df: DataFrame, path: str, check=None) -> None:
    """Written beside the target, checked as read back, then renamed; an existing target is refused, a failure leaves nothing.

    Paths go through Hadoop's file system, so any store that Spark writes to will do.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, staging = hadoop(path), hadoop(f"{path}.staging-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        df.write.parquet(staging.toString())
        if check:
            check(spark.read.parquet(staging.toString()))
        if not fs.rename(staging, target):
            raise OSError(f"{path} can't be published")
    finally:
        fs.delete(staging, True)


def seal(df: DataFrame, keys: list[str]) -> DataFrame:
    """A table's rows as JSON with their digest, by key: what a later read is held against."""
    body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))
    return df.select(*keys, F.sha2(body, 256).alias("sha256"))


def write_wave(samples: np.ndarray, path: str, rate: int, rates: tuple[int, ...] = (22_050, 16_000)) -> None:
    """Mono float32 samples as 16-bit PCM, at an allowed rate, to a .wav file."""
    if rate not in rates or not path.endswith(".wav") or samples.ndim != 1 or samples.dtype != np.float32:
        raise ValueError("mono float32 at an allowed rate to a .wav file, please")
    if not np.isfinite(samples).all() or np.abs(samples).max(initial=0) > 1:
        raise ValueError("samples must be finite and within [-1, 1]")
    with wave.open(path, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(samples * 32768), -32768, 32767).astype("<i2").tobytes())


def remove_local(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path)


def finite_or_none(x: float) -> float | None:
    return x if math.isfinite(x) else None


def provenance(spark: SparkSession, inputs: dict[str, DataFrame]) -> DataFrame:
    """One row per input: name, rows and an order-free digest of its content."""
    out = None
    for name, df in inputs.items():
        body = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.sum(body).cast("string").alias("digest"), F.lit(spark.version).alias("spark"))
        out = row if out is None else out.unionByName(row)
    return out
