"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.scalar import ratio
from assayer.operators.ordered import joined, quantiles


def numeric_summary(df: DataFrame, by: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """mean, sample std and non-null count of every numeric column, as {column}_{statistic}."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (*by, *skip)]
    return df.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))))


def _with_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], *sums: Column) -> DataFrame:
    """n, exact quantiles and the given aggregates; quantiles are null where all values are."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), *sums)
    found = quantiles(df, by, value, shares).drop("n")
    return joined(out, found, by, "left")


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample std (null for one row), 5th percentile, median, 95th percentile (linear interpolation)."""
    shares = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    out = _with_quantiles(df, by, value, shares, F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.select(*by, "n", "mean", "std", *shares)


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, p05, median, p95, max, mean, population std."""
    ends = F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high")
    out = _with_quantiles(df, by, value, {"p05": 0.05, "median": 0.5, "p95": 0.95}, *ends, F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"))
    return out.select(*by, "n", "low", "p05", "median", "p95", "high", "mean", "std_pop")


def first_known(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each column's first non-null value in the given order."""
    return df.groupBy(*by).agg(*(F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def mode_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value (the smallest of equals), its count and share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("mode")).agg(F.count("*").alias("n"))
    least = F.min(F.struct((-F.col("n")).alias("less"), "mode")).alias("first")
    out = counts.groupBy(*by).agg(least, F.sum("n").alias("total")).withColumn("n", -F.col("first.less"))
    return out.select(*by, F.col("first.mode").alias("mode"), "n", ratio(F.col("n"), F.col("total")).alias("share"))


def top_share(df: DataFrame, group: str, value: Column, k: int = 10) -> DataFrame:
    """What the k largest groups hold of a total: in_top, total, share (null for a total of 0)."""
    sums = df.groupBy(group).agg(F.sum(value).alias("v"))
    top = sums.orderBy(F.col("v").desc(), group).limit(k).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("in_top"))
    total = sums.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"))
    return top.crossJoin(total).select("in_top", "total", ratio(F.col("in_top"), F.col("total")).alias("share"))


def variance_split(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Population variance of group means (between) and mean of group variances (within)."""
    inner = df.groupBy(*by, group).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return inner.groupBy(*by).agg(F.count("*").alias("n_groups"), F.var_pop("m").alias("between"), F.avg("v").alias("within"))


def win_share(df: DataFrame, by: list[str], source: str, difference: Column) -> DataFrame:
    """Chance that the difference is positive, ties as a half: by source first, then over sources."""
    inner = df.groupBy(*by, source).agg(F.avg(F.when(difference > 0, 1.0).when(difference == 0, 0.5).otherwise(0.0)).alias("win"))
    return inner.groupBy(*by).agg(F.count("*").alias("n_sources"), F.avg("win").alias("win"))


def histogram(df: DataFrame, by: list[str], value: Column, weight: Column, bins: int = 20) -> DataFrame:
    """Weight by bin of [0, 1], the last bin closed; values outside count nowhere."""
    inside = df.withColumn("_v", value).where((F.col("_v") >= 0) & (F.col("_v") <= 1))
    return inside.groupBy(*by, F.least(F.floor(F.col("_v") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum(weight).alias("mass"))


def table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column, zeros included."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def stratum_mass(df: DataFrame, sets: list[list[str]], weight: Column) -> DataFrame:
    """Rows and weight at several groupings at once; a column that a grouping leaves out is null there. level: its number."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"), F.sum(weight).alias("mass"), F.grouping_id().cast("int").alias("level"))
    return out.select(*columns, "level", "n", "mass")


def collapse_point(df: DataFrame, by: list[str], cutoff: str, error: str, at: float) -> DataFrame:
    """The highest cutoff at which the error reaches ``at``; null where it never does."""
    return df.groupBy(*by).agg(F.max(F.when(F.col(error) >= at, F.col(cutoff))).alias("collapse"))


def strength(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and largest value as text with five decimals, n/a for none."""
    text = lambda c: F.coalesce(F.format_string("%.5f", c), F.lit("n/a"))
    out = df.groupBy(*by).agg(F.avg(value).cast("double").alias("m"), F.max(value).cast("double").alias("x"))
    return out.select(*by, F.when(F.col("m").isNull(), "n/a").otherwise(text(F.col("m"))).alias("mean_text"), F.when(F.col("x").isNull(), "n/a").otherwise(text(F.col("x"))).alias("max_text"))
