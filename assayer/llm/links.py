"""Similarity components from inverted lists, without all pairs inside a list.

Items meet in lists (one row per item and list). Which pairs link is settled by a ``verify``
function on full data; here candidates are only chosen. Lists that a family of copies fills are
worked off by stars: members are tried against one pivot a list, twice with different pivots, and
what links becomes one component. Pairs inside a component need no test any more. What is left are
pairs of different components in one list. Lists are taken coolest first (by their length), and an
item enters as many of its lists as two linked items need to be certain to meet in one of them. The
items that such lists hold go through a prefix and position filter over their whole sets, rarest
elements first, which rules out only pairs that can't link; so no link is lost, and a list's length
squared is never work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import sieve
from assayer.llm.graph import components
from assayer.llm.lineage import cut, release

Verify = Callable[[DataFrame], DataFrame]


def link_components(
    lists: DataFrame, verify: Verify, elements: Callable[[DataFrame], DataFrame], need: Callable | None = None, percent: int = 75,
    met: Callable | None = None,
) -> DataFrame:
    """(id, component) for the items that link with a smaller one, directly or through others.

    lists: key long, id long, own long, n_keys int. An item has one set or more, each with its own number (``own``) and
    n_keys distinct keys; items link by any of their sets. Sizes of linked sets differ by at most ``percent``. verify:
    takes (a, b) pairs with a < b and returns the true ones. elements: takes distinct (id, part) and returns (id, part,
    own, hashes), the distinct elements of each whole set. need(n_keys): column, the keys that two linked sets at
    least share. met(sieve): the rows of lists whose key passes, where the caller has them cheaper than from lists.
    """
    spark = lists.sparkSession
    heads = cut(lists.groupBy("key").agg(F.count("*").alias("df"), F.min("id").alias("pivot")).where("df > 1").select("key", "pivot"))
    bits = sieve.of(heads.select("key"))
    wanted = met(bits) if met else sieve.through(lists, "key", bits)
    shared = cut(wanted.join(heads, "key").select("key", "id", "own", "n_keys", "pivot"))
    del wanted, heads
    release(spark)

    first = shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    parts = components(verify(first))
    release(spark)

    placed = cut(_with(shared, parts))
    shared = None
    pivot = placed.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("id", "key"), "id", "part")).alias("p"), F.min("part").alias("low"), F.max("part").alias("high")
    )
    pivot = pivot.where("low <> high").select("key", F.col("p.id").alias("c"), F.col("p.part").alias("c_part"))
    apart = placed.join(pivot, "key").where("part <> c_part")
    second = apart.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    found = verify(second)
    parts = components(_edges(parts).union(found))
    del pivot, apart, second, found
    release(spark)

    placed = cut(_with(placed, parts))
    heat = placed.groupBy("key").agg(F.count("*").alias("heat"), F.min("part").alias("low"), F.max("part").alias("high"))
    live = placed.join(heat.where("low <> high").select("key", "heat"), "key")
    if need:
        # Keys in no other item's list, or in lists of one component, are the coolest of all; they fill the
        # first places of an item without being rows here.
        each = Window.partitionBy("id", "own")
        live = live.withColumn("place", F.row_number().over(each.orderBy("heat", "key"))).withColumn("of", F.count("*").over(each))
        live = live.where(F.col("of") - F.col("place") + 1 >= need(F.col("n_keys")))
        live = cut(live.select("key", "id", "part"))
        # A list that only one component's items still enter joins nothing.
        two = live.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
        live = live.join(two, "key", "left_semi")
    items = cut(live.select("id", "part").distinct())
    # Kept as arrays: rows of single elements would cost more to write than to take apart twice.
    own = cut(elements(items))
    own = own.select("id", "part", "own", F.size("hashes").alias("n"), F.explode("hashes").alias("element"))
    del placed, heat, live, items
    release(spark)
    third = _by_elements(own, percent)
    del own
    release(spark)
    return components(_edges(parts).union(verify(third)))


def _edges(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("component").alias("a"), F.col("id").alias("b"))


def _by_elements(own: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different parts that a prefix and position filter on whole sets doesn't rule out. own: id, part, own, n, element.

    Elements are ordered alike in all items: first those of one part only, which no pair has in common, then by rising
    frequency. A pair's first common element bounds what it can have in common by what follows it in either item.
    """
    share = percent / (100.0 + percent)
    spread = own.groupBy("element").agg(F.count("*").alias("f"), F.min("part").alias("low"), F.max("part").alias("high"))
    met = own.join(spread.where("low <> high").select("element", "f"), "element")
    each = Window.partitionBy("id", "own")
    place = F.col("n") - F.count("*").over(each) + F.row_number().over(each.orderBy("f", "element"))
    rows = met.select("id", "part", "element", "n", place.alias("place"))
    rows = rows.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1)
    # The largest partner that the rest of the item, from here on, could suffice for.
    rows = cut(rows.withColumn("most", F.floor((F.col("n") - F.col("place") + 1) / F.lit(share) - F.col("n") + 1e-9)))
    fit = rows.groupBy("element").agg(F.min("n").alias("least"), F.min("part").alias("low"), F.max("part").alias("high"))
    rows = rows.join(fit.where("low <> high").select("element", "least"), "element").where("most >= least")
    rows = cut(rows.select("id", "part", "element", "n", "place"))
    other = rows.select("element", *(F.col(c).alias(f"{c}_b") for c in ("id", "part", "n", "place")))
    room = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) + 1
    near = (F.col("id") < F.col("id_b")) & (F.col("part") != F.col("part_b")) & (room >= share * (F.col("n") + F.col("n_b")) - 1e-9)
    return rows.join(other, "element").where(near).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def _with(placed: DataFrame, parts: DataFrame) -> DataFrame:
    parts = parts.select(F.col("id").alias("p_id"), "component")
    joined = placed.join(parts, F.col("id") == F.col("p_id"), "left")
    return joined.select("key", "id", "own", "n_keys", F.coalesce("component", "id").alias("part"))
