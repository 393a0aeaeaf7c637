"""Deterministic order, folds and samples by digest, so any run and any partitioning draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalar import hash_order
from assayer.operators.ordered import running


#: First hexadecimal digits of a digest that deal an ungrouped order over tasks: 4,096 slots.
DIGITS = 3


def ranked(df: DataFrame, value: str, namespace: str, seed: int, by: list[str] = (), name: str = "rank") -> DataFrame:
    """1-based place by sha256(seed:namespace:value), then value.

    Without groups the order is dealt over slots of the digest, and a slot's rows count on from those of the slots before it.
    """
    order = [hash_order(namespace, seed, F.col(value)), value]
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    rows = df.withColumn("_slot", F.substring(order[0], 1, DIGITS))
    slots = rows.groupBy("_slot").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select("_slot", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_slot").orderBy(*order)))
    place = F.col("_before") + F.col("_in")
    return rows.join(F.broadcast(slots), "_slot").withColumn(name, place).drop("_slot", "_in", "_before")


def _counted(df: DataFrame) -> DataFrame:
    """Adds n, the number of all rows."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))  # one row


def folds(groups: DataFrame, group: str, k: int, namespace: str, seed: int) -> DataFrame:
    """fold = place modulo k. Groups are few against rows; rows get theirs by a join."""
    return ranked(groups.select(group).where(F.col(group).isNotNull()).distinct(), group, namespace, seed).select(group, ((F.col("rank") - 1) % k).alias("fold"))


def nested(folded: DataFrame, group: str, held: int, namespace: str, seed: int) -> DataFrame:
    """part: held for the fold, and of the rest every third in hash order calibration, the others fit."""
    rest = ranked(folded.where(F.col("fold") != held), group, namespace, seed).select(group, F.when(F.col("rank") % 3 == 0, "calibration").otherwise("fit").alias("part"))
    return rest.union(folded.where(F.col("fold") == held).select(group, F.lit("held").alias("part")))


def inner_hold_out(groups: DataFrame, group: str, share: float, namespace: str, seed: int) -> DataFrame:
    """The first ceil(share) of the groups in hash order."""
    out = ranked(_counted(groups.select(group).distinct()), group, namespace, seed)
    return out.where(F.col("rank") <= F.ceil(F.col("n") * share)).select(group)


def qualified(df: DataFrame, group: str, item: str, groups: int, per_group: int, namespace: str, seed: int, take: int | None = None) -> DataFrame:
    """Every row with its decision: groups with per_group rows or more are ranked, so many kept, and ``take`` (per_group) rows of each.

    With too few qualified groups nothing is selected.
    """
    sized = df.groupBy(group).agg(F.count("*").alias("n_rows"))
    fit = ranked(sized.where(F.col("n_rows") >= per_group).select(group), group, namespace, seed, name="group_rank")
    enough = fit.agg(F.count("*").alias("n_fit"))
    rows = ranked(df, item, namespace, seed, [group], "item_rank").join(sized, group).join(fit, group, "left").crossJoin(enough)
    decision = F.when(F.col("n_rows") < per_group, "group_too_small").when(F.col("n_fit") < groups, "shortfall").when(F.col("group_rank") > groups, "group_not_drawn").when(F.col("item_rank") > (take or per_group), "item_not_drawn").otherwise("selected")
    return rows.withColumn("decision", decision).select(*df.columns, "decision")


def round_robin(df: DataFrame, group: str, item: str, limit: int) -> DataFrame:
    """The first of each group in group order, then the second ones, up to the limit."""
    return df.withColumn("turn_no", F.row_number().over(Window.partitionBy(group).orderBy(item))).orderBy("turn_no", group).limit(limit)


def quota(df: DataFrame, pool: str, item: str, eligible: Column, take: int, namespace: str, seed: int) -> DataFrame:
    """Every row with rank among its pool's eligible ones and reason: selected, over_quota or ineligible."""
    marked = df.withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    out = ranked(marked, item, namespace, seed, [pool, "_ok"], "rank")
    reason = F.when(~F.col("_ok"), "ineligible").when(F.col("rank") <= take, "selected").otherwise("over_quota")
    return out.select(*df.columns, F.when(F.col("_ok"), F.col("rank")).alias("rank"), reason.alias("reason"))


def capped(df: DataFrame, by: list[str], item: str, cap: int, namespace: str, seed: int) -> DataFrame:
    return ranked(df, item, namespace, seed, by).where(F.col("rank") <= cap).drop("rank")


def balanced(df: DataFrame, by: list[str], label: str, item: str, cap: int, namespace: str, seed: int) -> DataFrame:
    """As many rows of label 0 as of label 1 in each group: the smaller count, at most cap."""
    whole = Window.partitionBy(*by)
    n = F.least(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).over(whole), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).over(whole), F.lit(cap))
    return ranked(df.withColumn("_n", n), item, namespace, seed, [*by, label]).where(F.col("rank") <= F.col("_n")).drop("_n", "rank")


def frozen_split(units: DataFrame, unit: str, shares: dict[str, float], namespace: str, seed: int) -> DataFrame:
    """unit, split: rounded shares in hash order, the remainder to the last split."""
    out = ranked(_counted(units.select(unit).distinct()), unit, namespace, seed)
    names, split, bound = list(shares), None, F.lit(0)
    for name in names[:-1]:
        bound = bound + F.bround(F.col("n") * shares[name], 0)
        split = F.when(F.col("rank") <= bound, name) if split is None else split.when(F.col("rank") <= bound, name)
    return out.select(unit, split.otherwise(names[-1]).alias("split"))


def strided(df: DataFrame, index: str, step: int) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(step)) == 0)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = N / (k * N_class), so that classes weigh alike."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(total).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def matched_mass(df: DataFrame, by: list[str], matched: str, weight: str, share: float) -> DataFrame:
    """Weights with each group's mass kept and ``share`` of it on matched rows; groups of one kind only keep theirs."""
    whole = Window.partitionBy(*by)
    total, on = F.sum(weight).over(whole), F.sum(F.when(F.col(matched), F.col(weight)).otherwise(0)).over(whole)
    new = F.when((on == 0) | (on == total), F.col(weight)).when(F.col(matched), F.col(weight) * share * total / on).otherwise(F.col(weight) * (1 - share) * total / (total - on))
    return df.withColumn("new_weight", new)


def effective_size(df: DataFrame, by: list[str], weight: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("effective"))


def best(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a lexicographic order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def order_statistic(df: DataFrame, by: list[str], value: str, budget: float) -> DataFrame:
    """The value at 0-based place floor(budget * n) of the sorted ones, which aren't null: by, n, cutoff."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("cutoff")).agg(F.count("*").alias("_k"))
    ties = running(ties, by, "cutoff", ["_k"])
    at = F.min(F.when(F.col("_k_cum") > F.floor(F.col("_k_all") * budget), F.col("cutoff")))
    return ties.groupBy(*by).agg(F.max("_k_all").alias("n"), at.alias("cutoff"))
