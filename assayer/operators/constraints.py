"""Integrity constraints as queries for the rows that break them; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Violation(ValueError):
    """Raised by require() with a few of the offenders."""


def require(offenders: DataFrame, rule: str, show: int = 5) -> None:
    found = offenders.limit(show).collect()
    if found:
        raise Violation(f"{rule}: {[r.asDict() for r in found]}")


def rule(offenders: DataFrame, name: str, key: Column, detail: Column) -> DataFrame:
    """Offenders in the common form: rule, key, detail."""
    return offenders.select(F.lit(name).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_of(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values not allowed (null is one), with their counts."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def broken_dependency(df: DataFrame, key: list[str], *values: str) -> DataFrame:
    """Keys with more than one value in any of the columns."""
    counts = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))).groupBy(*key).agg(*(F.count_distinct(v).alias(f"n_{v}") for v in values))
    return counts.where(reduce(lambda a, b: a | b, (F.col(f"n_{v}") > 1 for v in values)))


def unpaired(df: DataFrame, condition: str, unit: str, reference: str, show: int = 5) -> DataFrame:
    """For each condition, units of the reference that it lacks and units it has beyond: counts and the first few."""
    rows = df.select(F.col(condition).alias("condition"), F.col(unit).alias("unit")).where("condition is not null and unit is not null")
    # Units with all their conditions in one row: only what a unit lacks is spelled out, not conditions times units.
    held = rows.groupBy("unit").agg(F.collect_set("condition").alias("have"))
    every = rows.agg(F.collect_set("condition").alias("every"))  # a handful of conditions
    held = held.crossJoin(F.broadcast(every)).withColumn("in_ref", F.array_contains("have", F.lit(reference)))
    lacks = F.when(F.col("in_ref"), F.array_except("every", "have")).otherwise(F.col("have"))
    apart = held.select("unit", F.when(F.col("in_ref"), "missing").otherwise("extra").alias("side"), F.explode(lacks).alias("condition"))
    order = Window.partitionBy("condition", "side").orderBy("unit")
    # The first few of each, before anything is gathered: Spark keeps only so many rows of a window's partition in a task.
    few = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= show)
    few = few.groupBy("condition", "side").agg(F.concat_ws(",", F.sort_array(F.collect_list("unit")).cast("array<string>")).alias("some"))
    return apart.groupBy("condition", "side").agg(F.count("*").alias("n")).join(few, ["condition", "side"])


def not_constant(df: DataFrame, by: list[str], column: str, value) -> DataFrame:
    """Groups in which the column is ever null or another value."""
    return df.groupBy(*by).agg(F.count_if(F.col(column).isNull()).alias("n_null"), F.count_if(F.col(column) != value).alias("n_other")).where("n_null + n_other > 0")


def incomplete(df: DataFrame, by: list[str], column: str, wanted: list) -> DataFrame:
    """Groups whose set of values isn't exactly the wanted one: what is missing and what is beyond."""
    want = F.array(*map(F.lit, sorted(wanted)))
    out = df.groupBy(*by).agg(F.array_sort(F.collect_set(column)).alias("have"))
    out = out.select(*by, F.array_sort(F.array_except(want, "have")).alias("missing"), F.array_sort(F.array_except("have", want)).alias("extra"))
    return out.where((F.size("missing") > 0) | (F.size("extra") > 0)).select(*by, F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "extra").alias("extra"))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def leaked(df: DataFrame, content: Column, split: str) -> DataFrame:
    """Content found in more than one split."""
    return df.groupBy(content.alias("content")).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides of what should be disjoint."""
    return a.select(key).intersect(b.select(key))


def bad_cover(df: DataFrame, key: list[str], start: str, end: str, size: str, label: str, labels: list[int]) -> DataFrame:
    """Keys whose intervals aren't a gapless, ordered, half-open cover of [0, size) with allowed labels."""
    order = Window.partitionBy(*key).orderBy(start, end)
    rows = df.withColumn("_before", F.lag(end).over(order))
    bad = (F.col(end) <= F.col(start)) | ~F.col(label).isin(labels) | (F.col("_before").isNotNull() & (F.col("_before") != F.col(start)))
    out = rows.groupBy(*key).agg(F.count_if(bad).alias("n_bad"), F.min(start).alias("first"), F.max(end).alias("last"), F.max(size).alias("size"))
    return out.where((F.col("n_bad") > 0) | (F.col("first") != 0) | (F.col("last") != F.col("size")))


def differing(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys on one side only, or with other values: side is left, right or both."""
    x, y = a.select(*key, F.col(value).alias("left_value"), F.lit(1).alias("l")), b.select(*key, F.col(value).alias("right_value"), F.lit(1).alias("r"))
    both = x.join(y, key, "full_outer").where(F.col("l").isNull() | F.col("r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value")))
    return both.select(*key, F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("side"), "left_value", "right_value")


def beyond_tolerance(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], absolute: float, relative: float) -> DataFrame:
    """(key, column, left, right) where two tables differ by more than absolute + relative * |right|, or a row lacks."""
    long = lambda df, n: df.select(*key, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("column", n))
    both = long(a, "left").join(long(b, "right"), [*key, "column"], "full_outer")
    fine = F.coalesce(F.abs(F.col("left") - F.col("right")) <= absolute + relative * F.abs("right"), F.col("left").isNull() & F.col("right").isNull())
    return both.where(~fine)


def citable(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """True where there are rows and all of them are flagged; a null flag is not."""
    return df.groupBy(*by).agg(F.bool_and(F.coalesce(F.col(flag), F.lit(False))).alias("citable"), F.count("*").alias("n"))


def excluded_units(df: DataFrame, unit: str, bad: Column) -> DataFrame:
    """The rows of units none of whose rows, in any condition, is bad."""
    return df.join(df.where(bad).select(unit).distinct(), unit, "left_anti").select(*df.columns)
