"""Intake of recordings: measured, accepted or rejected with a reason, and read back against what was sealed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.dedup import collisions
from assayer.sources.files import BadSource, checked_audio, inventory
from assayer.sources.sinks import publish


def measured(audio: DataFrame, rate: int, least_level: float = 10 ** (-50 / 20), **limits) -> DataFrame:
    """read_audio() rows without their samples: n_samples, level, peak, digest of the samples, and reason, the first rule that a
    recording breaks: those of checked_audio(), then silence."""
    x = F.col("samples")
    level = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.size(x))
    out = checked_audio(audio, rate, **limits).withColumns(
        {
            "n_samples": F.size(x), "level": F.when(F.size(x) > 0, level), "peak": F.array_max(F.transform(x, lambda v: F.abs(v))),
            "samples_sha256": F.when(F.size(x) > 0, F.sha2(F.to_json(x), 256)),
        }
    )
    silent = F.coalesce(F.col("level") < least_level, F.lit(True))
    return out.withColumn("reason", F.coalesce("reason", F.when(silent, F.lit("silent")))).drop("samples")


def admitted(found: DataFrame, item: str, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """measured() rows with their decision in reason (null: accepted). members: the items that must be there; one without a row is missing.
    Of accepted recordings that share a digest with another one, all are duplicates."""
    rows = found
    if members is not None:
        rows = members.select(item).distinct().join(found.withColumn("_there", F.lit(True)), item, "left")
        rows = rows.withColumn("reason", F.when(F.col("_there").isNull(), F.lit("missing")).otherwise(F.col("reason"))).drop("_there")
    twins = collisions(rows.where("reason is null"), item, keys).select(item, F.lit("duplicate").alias("_twin"))
    return rows.join(twins, item, "left").withColumn("reason", F.coalesce("reason", "_twin")).drop("_twin")


def seal_intake(decided: DataFrame, path: str) -> None:
    """The accepted and the rejected rows as two tables, published whole."""
    publish(decided.where("reason is null").drop("reason"), f"{path}/accepted")
    publish(decided.where("reason is not null"), f"{path}/rejected")


def ingested(intake: str, files: str, spark, path: str = "path", digest: str = "sha256") -> DataFrame:
    """The accepted rows of a sealed intake, if every file still has the digest that was recorded."""
    rows = spark.read.parquet(f"{intake}/accepted")
    now = inventory(spark, files).select(F.col("path").alias(path), F.col("sha256").alias("_now"))
    changed = rows.join(now, path, "left").where(~F.col(digest).eqNullSafe(F.col("_now"))).select(path).limit(3).collect()
    if changed:
        raise BadSource(f"files that changed since their intake: {[r[0] for r in changed]}")
    return rows


def gate(cohort: DataFrame, expected: int, violations: DataFrame) -> DataFrame:
    """The cohort, if it has as many rows as expected and no rule is broken (see operators.constraints)."""
    n = cohort.count()
    if n != expected:
        raise BadSource(f"{n} rows where {expected} were expected")
    if broken := violations.limit(3).collect():
        raise BadSource(f"rules broken: {[tuple(r) for r in broken]}")
    return cohort
