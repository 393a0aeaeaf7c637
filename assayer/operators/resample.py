"""Bootstrap by weights: draws say how often a unit is taken, so a replicate never copies rows.

Draws are digests of (seed, replicate, place), so they are the same on any cluster. What is drawn are units: sources, or
the rows of a class where the rows themselves are resampled; there are n draws for each unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import ratio
from assayer.operators import classify, ranking
from assayer.operators.ordered import checked, joined, quantiles, running
from assayer.operators.sampling import ranked


def _place(seed: int, replicate: str, place: str, total: str) -> Column:
    """A place below the total, from the first 48 bits of a digest."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(replicate).cast("string"), F.col(place).cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col(total))


def _replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def draws(groups: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """(draw, group, w): how often each group is drawn in each of n replicates of as many draws as there are groups.

    A group's place is its rank in digest order. Groups are few against rows; there are n rows for each.
    """
    placed = ranked(groups.select(group).where(F.col(group).isNotNull()).distinct(), group, "draw", seed)
    placed = placed.select(group, (F.col("rank") - 1).cast("long").alias("place"))
    total = placed.agg(F.count("*").alias("m"))
    picks = joined(placed, total, []).select("m", F.col("place").alias("k"), _replicates(n).alias("draw"))
    picks = picks.select("draw", _place(seed, "draw", "k", "m").alias("place")).groupBy("draw", "place").agg(F.count("*").alias("w"))
    return picks.join(placed, "place").select("draw", group, "w")


def _interval(each: DataFrame, value: str, alpha: float, by: list[str] = ()) -> DataFrame:
    """by, low, high (percentiles of the defined replicates), n_undefined."""
    ends = quantiles(each, list(by), value, {"low": alpha / 2, "high": 1 - alpha / 2}).drop("n")
    missing = each.groupBy(*by).agg(F.count_if(F.col(value).isNull()).alias("n_undefined"))
    return joined(missing, ends, list(by), "left").select(*by, "low", "high", "n_undefined")


def ratio_interval(rows: DataFrame, group: str, numerator: Column, denominator: Column, drawn: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of sum(numerator) / sum(denominator): low, high, n_undefined (left out of the quantiles)."""
    sums = rows.groupBy(group).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    w = F.col("w")
    each = drawn.join(sums, group).groupBy("draw").agg(F.sum(w * F.col("a")).alias("a"), F.sum(w * F.col("b")).alias("b"))
    return _interval(each.withColumn("value", ratio(F.col("a"), F.col("b"))), "value", alpha)


def macro_f1_interval(rows: DataFrame, group: str, truth: str, predicted: str, labels: DataFrame, drawn: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interval of the mean F1 over all labels (a column ``label``): cells of the confusion are summed by group once and weighted."""
    cells = rows.groupBy(group, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("c"))
    seen = drawn.join(cells, group).groupBy("draw", "truth", "predicted").agg(F.sum(F.col("w") * F.col("c")).alias("n"))
    grid = drawn.select("draw").distinct().crossJoin(F.broadcast(labels.select(F.col("label").alias("truth"))))
    grid = grid.crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    whole = grid.join(seen, ["draw", "truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _interval(classify.macro(classify.class_scores(whole, ["draw"]), "f1", ["draw"]), "macro", alpha)


def paired_change(before: DataFrame, after: DataFrame, group: str, value: Column, drawn: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interval of the change of the mean over groups, with the same draws on both sides: low, high, n_draws."""
    a = before.groupBy(group).agg(F.avg(value).alias("a"))
    b = after.groupBy(group).agg(F.avg(value).alias("b"))
    change = (F.sum(F.col("w") * (F.col("b") - F.col("a"))) / F.sum("w")).alias("change")
    each = drawn.join(a.join(b, group).where("a is not null and b is not null"), group).groupBy("draw").agg(change)
    return _interval(each, "change", alpha).crossJoin(F.broadcast(each.agg(F.count("change").alias("n_draws")))).drop("n_undefined")


def source_mean_interval(sources: DataFrame, source: str, value: str, n: int, seed: int, least: int = 10, alpha: float = 0.05) -> DataFrame:
    """Interval of the mean of one value for each source: n, n_missing, mean, low, high. Null and NaN values are missing; infinite
    ones are an error; under ``least`` values there is no interval."""
    rows = sources.select(source, F.when(~F.isnan(value), F.col(value).cast("double")).alias("_v")).withColumn("_v", checked(F.col("_v"), value))
    known = rows.where("_v is not null")
    drawn = draws(known, source, n, seed).join(known, source)
    each = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("value"))
    whole = rows.agg(F.count("_v").alias("n"), F.count_if(F.col("_v").isNull()).alias("n_missing"), F.avg("_v").alias("mean"))
    out = whole.crossJoin(F.broadcast(_interval(each, "value", alpha)))
    enough = F.col("n") >= least
    return out.select("n", "n_missing", "mean", *(F.when(enough, F.col(c)).alias(c) for c in ("low", "high")))


def eer_interval(df: DataFrame, by: list[str], score: str, reference: str, n: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Interval of the equal error rate by group when both classes are resampled, each by itself: by, low, high, n_undefined.

    A class' rows stand in the order of their scores; tied rows are alike, so a draw is a weight of a tie group.
    """
    key = [*by, reference]
    rows = df.where(F.col(score).isNotNull()).select(*key, checked(F.col(score), score).alias("score"))
    ties = running(rows.groupBy(*key, "score").agg(F.count("*").alias("c")), key, "score", ["c"])
    spot = F.explode(F.sequence(F.col("c_cum") - F.col("c"), F.col("c_cum") - 1))
    spots = ties.select(*key, "score", F.col("c_all").alias("m"), spot.alias("place"))
    picks = spots.select(*key, "m", F.col("place").alias("k"), _replicates(n).alias("draw"))
    picks = picks.select(*key, "draw", _place(seed, "draw", "k", "m").alias("place")).groupBy(*key, "draw", "place").agg(F.count("*").alias("w"))
    drawn = joined(picks, spots.drop("m"), [*key, "place"]).select(*key, "draw", "score", "w")
    each = ranking.eer(drawn, [*by, "draw"], "score", F.col(reference), F.col("w"))
    return _interval(each, "eer", alpha, by)
