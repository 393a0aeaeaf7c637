"""Content de-duplication that excludes every member of a colliding group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collisions(df: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """(item, n_keys): items that share any of the fingerprints with another one. Null fingerprints collide with nothing."""
    long = df.select(item, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys))).alias("f")).select(item, "f.kind", "f.value").where("value is not null")
    # Grouped counts combine before the shuffle, so a fingerprint that very many rows share is no hot task.
    shared = long.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1").select("kind", "value")
    return long.join(shared, ["kind", "value"], "left_semi").groupBy(item).agg(F.count_distinct("kind").alias("n_keys"), F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("kinds"))


def without_collisions(df: DataFrame, item: str, keys: list[str]) -> DataFrame:
    return df.join(collisions(df, item, keys).select(item), item, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with their multiplicities, and the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def stacked(runs: list[DataFrame], condition: str, reference: str) -> DataFrame:
    """UNION ALL of runs with the reference condition from the first only."""
    return reduce(DataFrame.unionByName, [runs[0], *(r.where(F.col(condition) != reference) for r in runs[1:])])
