"""Running sums, ranks and exact quantiles over an order, without a task for a whole group.

Rows are dealt over slots of the order, by a rule that only reads the value: a window runs within a slot, and
what lies before a slot comes from a table of slots. That table has a fixed number of rows for a group however
many rows the input has, so its own window is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalar import finite

#: Slots for each halving of the distance to an end of the range, and halvings that are told apart.
PER_HALVING, HALVINGS = 512, 64


def checked(value: Column, name: str) -> Column:
    """The value as a double; null stays, NaN and infinities are an error, as they have no place in an order of scores."""
    value = value.cast("double")
    return F.when(value.isNull() | finite(value), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} isn't finite: "), value.cast("string"))))


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on group keys that may be null; without keys right has one row, which is sent to all."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"_{c}_right" for c in by})
    same = [left[c].eqNullSafe(right[f"_{c}_right"]) for c in by]
    return left.join(right, same, how).drop(*(f"_{c}_right" for c in by))


def _from_end(u: Column) -> Column:
    """A whole number that doesn't fall as u rises from 0 to 0.5."""
    halving = F.greatest(F.floor(F.log2(u)), F.lit(-HALVINGS))
    within = F.floor(u / F.pow(F.lit(2.0), halving) * PER_HALVING)
    return F.when(u <= 0, 0).otherwise((halving + HALVINGS) * 4 * PER_HALVING + within).cast("long")


def slotted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds _slot, which doesn't fall as the value rises within its group. Slots are finest towards the ends of the range."""
    # Halves, so that the width of a range from -1e308 to 1e308 is finite too.
    half = F.col(value).cast("double") / 2
    ends = df.groupBy(*by).agg(F.min(half).alias("_low"), F.max(half).alias("_high"))
    out = joined(df, ends, by)
    up, down = (half - F.col("_low")) / (F.col("_high") - F.col("_low")), (F.col("_high") - half) / (F.col("_high") - F.col("_low"))
    top = (HALVINGS + 1) * 8 * PER_HALVING
    slot = F.when(F.col("_high") == F.col("_low"), 0).when(up < 0.5, _from_end(up)).otherwise(top - _from_end(F.least(down, F.lit(0.5))))
    return out.withColumn("_slot", slot.cast("long")).drop("_low", "_high")


def running(df: DataFrame, by: list[str], order: str, sums: list[str], falling: bool = False) -> DataFrame:
    """Adds {c}_cum, the sum of c up to and with the row in its group's order, and {c}_all, that of the group.

    The order's values are distinct within a group, and not null.
    """
    rows = slotted(df, by, order)
    key = [*by, "_slot"]
    turn = (lambda c: F.col(c).desc()) if falling else F.col
    slots = rows.groupBy(*key).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy(turn("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    slots = slots.select(
        *key, *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums), *(F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in sums)
    )
    inside = Window.partitionBy(*key).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(c).over(inside).alias(f"_{c}_in") for c in sums))
    out = joined(rows, slots, key)
    cum = [(F.col(f"_{c}_before") + F.col(f"_{c}_in")).alias(f"{c}_cum") for c in sums]
    return out.select(*df.columns, *cum, *(f"{c}_all" for c in sums))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of the non-null values with linear interpolation between neighbours: by, n, one column for each share."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ties = running(ties, by, "_v", ["_n"])
    at = {name: (F.col("_n_all") - 1) * share for name, share in shares.items()}
    ends = []
    for name, place in at.items():
        ends.append(F.min(F.when(F.col("_n_cum") > F.floor(place), F.col("_v"))).alias(f"_{name}_0"))
        ends.append(F.min(F.when(F.col("_n_cum") > F.ceil(place), F.col("_v"))).alias(f"_{name}_1"))
        ends.append(F.max(place - F.floor(place)).alias(f"_{name}_f"))
    out = ties.groupBy(*by).agg(F.max("_n_all").alias("n"), *ends)
    mixed = {name: F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * F.col(f"_{name}_f") for name in shares}
    return out.select(*by, "n", *(c.alias(name) for name, c in mixed.items()))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, name): the mean 1-based rank of each distinct value. df has a count n for each row."""
    ties = df.groupBy(*by, value).agg(F.sum("n").alias("n"))
    return running(ties, by, value, ["n"]).select(*by, value, (F.col("n_cum") - (F.col("n") - 1) / 2.0).alias(name))
