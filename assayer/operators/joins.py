"""Joins of paired rows. Keys, never positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side_by_side(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which rows of one side stay visible, with nulls for the other."""
    return a.join(b, keys, "full_outer")


def with_reference(df: DataFrame, unit: str, condition: str, reference: str, value: str) -> DataFrame:
    """Every other condition's rows beside the reference's value of the same unit: adds ref_value and delta."""
    ref = df.where(F.col(condition) == reference).select(unit, F.col(value).alias("ref_value"))
    return df.where(F.col(condition) != reference).join(ref, unit).withColumn("delta", F.col(value) - F.col("ref_value"))


def same_bytes(a: DataFrame, b: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """One row: keys on both sides, on one only, and those whose digests differ."""
    x, y = a.select(*keys, F.col(digest).alias("x")), b.select(*keys, F.col(digest).alias("y"))
    both = x.join(y, keys, "full_outer")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_both"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_one_side"), F.count_if(F.col("x") != F.col("y")).alias("n_differing"))


def shared_positions(df: DataFrame, group: str, position: str, member: str, members: list[str], usable: Column, least: int = 1) -> DataFrame:
    """(group, position) usable in every member, of groups with at least so many such positions."""
    common = df.where(F.col(member).isin(members)).groupBy(group, position).agg(F.count_distinct(F.when(usable, F.col(member))).alias("k")).where(F.col("k") == len(members)).drop("k")
    return common.withColumn("n", F.count("*").over(Window.partitionBy(group))).where(F.col("n") >= least).select(group, position)


def contrast(df: DataFrame, by: list[str], condition: str, full: str, limited: str, value: str) -> DataFrame:
    """full - limited of one row per condition and group."""
    pick = lambda c: F.max(F.when(F.col(condition) == c, F.col(value)))
    return df.groupBy(*by).agg(pick(full).alias("full"), pick(limited).alias("limited")).where("full is not null and limited is not null").withColumn("delta", F.col("full") - F.col("limited"))


def pivoted(df: DataFrame, by: list[str], column: str, values: list, value: str, order: str) -> DataFrame:
    """One column per given value: its first entry in the given order."""
    return df.groupBy(*by).pivot(column, values).agg(F.min_by(value, order))


def matched_controls(df: DataFrame, controls: DataFrame, group: str, prefer: Column, limit: int) -> DataFrame:
    """One row per group, joined to its control, those that are preferred first."""
    one = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("pick"))).where("_rank = 1").drop("_rank")
    return one.join(controls, group).orderBy(prefer.cast("int").desc(), group).limit(limit)


def overlapping(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of half-open [a_start, a_end), [b_start, b_end) of one key that overlap, with the length."""
    return a.join(b, key).where("a_start < b_end and b_start < a_end").withColumn("overlap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))


def donors(selected: DataFrame, sources: DataFrame, key: str, conditions: list[str]) -> DataFrame:
    """Each selected item under each condition, joined to its source, with an id from the key's fields."""
    grid = selected.select(key, F.explode(F.array(*map(F.lit, conditions))).alias("condition"))
    return grid.join(sources, key).withColumn("donor_id", F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "condition"), 256), 1, 24))
