"""Streaming forms of batch operators, beyond the batch engine: additive counts, windows, sessions, first-of-copies.

Late rows are dropped behind the watermark; state is bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import plain_text


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark; a time without a zone is taken as the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def sliding(stream: DataFrame, time: str, by: list[str], value: str, length: str, hop: str, late: str) -> DataFrame:
    """Count and sum of a value in sliding windows (no anchored tail: a stream has no end)."""
    out = _timed(stream, time, late).groupBy(F.window(time, length, hop).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Rows at most the gap apart as one session; its end is the last row's time plus the gap."""
    out = _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_confusion(stream: DataFrame, time: str, truth: Column, predicted: Column, length: str, late: str) -> DataFrame:
    """tp, fp, tn, fn by tumbling window; they add up over windows."""
    cell = {"tp": truth & predicted, "fp": ~truth & predicted, "tn": ~truth & ~predicted, "fn": truth & ~predicted}
    out = _timed(stream, time, late).groupBy(F.window(time, length).alias("w")).agg(*(F.count_if(c).alias(n) for n, c in cell.items()))
    return out.select(F.col("w.start").alias("start"), *cell)


def first_of_copies(stream: DataFrame, time: str, text: str, late: str) -> DataFrame:
    """The first row of each content within the watermark. (The batch operator excludes all copies instead.)"""
    return _timed(stream, time, late).withColumn("content", F.sha2(plain_text(F.col(text)), 256)).dropDuplicatesWithinWatermark(["content"])
