"""Ranking statistics whose tied scores cross a threshold together. All by tie groups and running sums over them.

Null scores take no part; NaN and infinite ones are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import ratio
from assayer.operators.ordered import average_ranks, checked, joined, running

#: For products of two counts, which pass 64 bits where each has more than some thousand million rows.
_WIDE = "decimal(19,0)"


def _ties(df: DataFrame, by: list[str], score: str, sums: dict[str, Column]) -> DataFrame:
    """by, score and the sums of each tie group."""
    rows = df.where(F.col(score).isNotNull()).select(*by, checked(F.col(score), score).alias("score"), *(c.alias(n) for n, c in sums.items()))
    return rows.groupBy(*by, "score").agg(*(F.sum(n).alias(n) for n in sums))


def _steps(df: DataFrame, by: list[str], score: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """Tie groups by rising score: p, q (weights of the two classes), their running sums and totals."""
    w = F.lit(1) if weight is None else weight
    ties = _ties(df, by, score, {"p": F.when(positive, w).otherwise(0), "q": F.when(~positive, w).otherwise(0)})
    return running(ties, by, "score", ["p", "q"])


def _first(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The row of each group that is least in the order of the columns: an aggregate, so no group is one task's work."""
    found = df.groupBy(*by).agg(F.min(F.struct(*columns)).alias("_first"))
    return found.where(F.col("_first").isNotNull()).select(*by, *(F.col(f"_first.{c}").alias(c) for c in columns))


def _crossing(frr0: Column, far0: Column, frr1: Column, far1: Column) -> Column:
    """Where the straight lines of both rates meet between two steps."""
    return frr0 + (far0 - frr0) / ((far0 - frr0) - (far1 - frr1)) * (frr1 - frr0)


def eer(df: DataFrame, by: list[str], score: str, reference: Column, weight: Column | None = None) -> DataFrame:
    """Equal error rate by group: n_ref, n_other, eer, threshold.

    Accept when score > threshold. The miss rate of the reference rises from 0 and the false acceptance rate
    of the others falls from 1 over the distinct scores; where they cross they are interpolated linearly, an
    exact meeting is taken as it is. Rates are compared as integers. Groups without both classes give nothing.
    weight: how many rows a row stands for.
    """
    counts = ["p", "q", "p_cum", "q_cum", "p_all", "q_all"]
    steps = _steps(df, by, score, reference, weight).where("p_all > 0 and q_all > 0")
    steps = steps.withColumns({c: F.col(c).cast(_WIDE) for c in counts})
    crossed = _first(steps.where("p_cum * q_all >= (q_all - q_cum) * p_all"), by, ["score", *counts])
    p, q, p_cum, q_cum, p_all, q_all = map(F.col, counts)
    before = ratio(p_cum - p, p_all), ratio(q_all - q_cum + q, q_all)
    after = ratio(p_cum, p_all), ratio(q_all - q_cum, q_all)
    value = F.when(F.expr("p_cum * q_all = (q_all - q_cum) * p_all"), after[0]).otherwise(_crossing(*before, *after))
    return crossed.select(*by, p_all.cast("long").alias("n_ref"), q_all.cast("long").alias("n_other"), value.alias("eer"), F.col("score").alias("threshold"))


def against_reference(df: DataFrame, condition: str, reference: str, score: str) -> DataFrame:
    """Each other condition's scores together with the reference's: condition, score, n (rows with that score), is_ref."""
    scored = df.select(F.col(condition).alias("condition"), F.col(score).alias("score"))
    rows = scored.where("condition is not null and score is not null").groupBy("condition", "score").agg(F.count("*").alias("n"))
    others = rows.where(F.col("condition") != reference)
    # The reference's tie groups, not its rows, are repeated for each condition.
    ref = rows.where(F.col("condition") == reference).select("score", "n")
    repeated = ref.crossJoin(others.select("condition").distinct()).select("condition", "score", "n", F.lit(True))
    return others.select("condition", "score", "n", F.lit(False).alias("is_ref")).union(repeated)


def auroc(df: DataFrame, by: list[str], score: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """n_pos, n_neg and the chance that a positive outscores a negative, ties as a half; null without both classes.

    weight: how many rows a row stands for."""
    steps = _steps(df, by, score, positive, weight)
    won = F.sum(F.col("p").cast("double") * (2 * F.col("q_cum") - F.col("q")))
    out = steps.groupBy(*by).agg(F.max("p_all").cast("long").alias("n_pos"), F.max("q_all").cast("long").alias("n_neg"), won.alias("won"))
    return out.select(*by, "n_pos", "n_neg", ratio(F.col("won"), 2 * F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def weighted_roc(df: DataFrame, by: list[str], score: str, positive: Column, weight: str) -> DataFrame:
    """auroc and eer with row weights; rows of weight 0 don't count. Integer weights stay exact."""
    steps = _steps(df.where(F.col(weight) > 0), by, score, positive, F.col(weight))
    won = F.sum(F.col("p").cast("double") * (2 * F.col("q_cum") - F.col("q")))
    area = steps.groupBy(*by).agg(won.alias("won"), F.max("p_all").alias("p_all"), F.max("q_all").alias("q_all"))
    area = area.select(*by, ratio(F.col("won"), 2 * F.col("p_all").cast("double") * F.col("q_all")).alias("auroc"))
    p, q, p_cum, q_cum, p_all, q_all = map(F.col, ("p", "q", "p_cum", "q_cum", "p_all", "q_all"))
    rates = {"frr0": (p_cum - p) / p_all, "far0": 1 - (q_cum - q) / q_all, "frr1": p_cum / p_all, "far1": 1 - q_cum / q_all}
    steps = steps.where("p_all > 0 and q_all > 0").select(*by, "score", *(c.cast("double").alias(n) for n, c in rates.items()))
    first = _first(steps.where("frr1 >= far1"), by, ["score", *rates])
    found = first.select(*by, _crossing(*map(F.col, rates)).alias("eer"))
    return joined(area, found, by, "left") if by else area.join(found, how="left")


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """n and the correlation of average ranks; null under ``least`` pairs or with a constant side.

    Distinct pairs are counted first and distinct values ranked; ranks come back by joins on the values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = rows.groupBy(*by, checked(F.col(x), x).alias("_x"), checked(F.col(y), y).alias("_y")).agg(F.count("*").alias("n"))
    ranked = joined(pairs, average_ranks(pairs, by, "_x", "_rx"), [*by, "_x"])
    ranked = joined(ranked, average_ranks(pairs, by, "_y", "_ry"), [*by, "_y"])
    ranked = joined(ranked, pairs.groupBy(*by).agg(F.sum("n").alias("_all")), by)
    middle = (F.col("_all") + 1) / 2.0  # the mean of all ranks
    dx, dy, n = F.col("_rx") - middle, F.col("_ry") - middle, F.col("n")
    sums = {"xy": n * dx * dy, "xx": n * dx * dx, "yy": n * dy * dy}
    out = ranked.groupBy(*by).agg(F.max("_all").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))
    defined = (F.col("n") >= least) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return out.select(*by, "n", F.when(defined, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def verdict(rho: Column) -> Column:
    """How strongly two orders agree: the sign matters for strong ones only."""
    size = F.abs(rho)
    strong = F.when(rho > 0, "strong positive").otherwise("strong negative")
    return F.when(rho.isNull(), "undefined").when(size >= 0.7, strong).when(size >= 0.4, "moderate").otherwise("weak")


def least_balanced_error(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Threshold (accept when score > threshold) with the least mean of the two error rates; ties go to the
    smaller difference of the rates, then the smaller threshold. A null threshold lies below all scores."""
    steps = _steps(df, by, score, positive)
    zero = [F.lit(0).cast("long").alias(c) for c in ("p_cum", "q_cum")]
    below = steps.groupBy(*by).agg(*(F.max(c).alias(c) for c in ("p_all", "q_all")))
    below = below.select(*by, F.lit(None).cast("double").alias("threshold"), *zero, "p_all", "q_all")
    every = below.union(steps.select(*by, "score", "p_cum", "q_cum", "p_all", "q_all")).where("p_all > 0 and q_all > 0")
    every = every.withColumns({c: F.col(c).cast(_WIDE) for c in ("p_cum", "q_cum", "p_all", "q_all")})
    # Errors over the common denominator p_all * q_all, as integers.
    missed, accepted = F.col("p_cum") * F.col("q_all"), (F.col("q_all") - F.col("q_cum")) * F.col("p_all")
    every = every.withColumns({"both": missed + accepted, "apart": F.abs(missed - accepted)})
    best = _first(every, by, ["both", "apart", "threshold", "p_all", "q_all"])  # a null threshold is the least
    of = 2.0 * F.col("p_all").cast("double") * F.col("q_all").cast("double")
    return best.select(*by, "threshold", (F.col("both").cast("double") / of).alias("balanced_error"))


def control_cutoff(df: DataFrame, by: list[str], score: str, weight: Column, target: float) -> DataFrame:
    """Highest-recall cut on controls: the least score such that those above it weigh at most target of all.

    Tied scores stay together. ``boundary``: rows strictly above it are flagged; null flags all. realised: their share.
    """
    ties = running(_ties(df, by, score, {"w": weight}), by, "score", ["w"], falling=True)
    over = F.col("w_cum") > F.col("w_all") * target
    flagged = F.coalesce(F.max(F.when(~over, F.col("w_cum"))), F.lit(0))
    out = ties.groupBy(*by).agg(F.max(F.when(over, F.col("score"))).alias("boundary"), flagged.alias("flagged"), F.max("w_all").alias("total"))
    return out.select(*by, "boundary", ratio(F.col("flagged"), F.col("total")).alias("realised"))


def recall_at_controls(df: DataFrame, score: str, positive: Column, kinds: dict[str, Column], target: float) -> DataFrame:
    """Largest recall over thresholds at which no kind of control is flagged above target; 0 where none is."""
    sums = {"p": positive, **{f"c{i}": c for i, c in enumerate(kinds.values())}}
    ties = _ties(df, [], score, {n: F.when(c, 1).otherwise(0) for n, c in sums.items()})
    ties = running(ties, [], "score", list(sums), falling=True)
    fine = F.lit(True)
    for i in range(len(kinds)):
        fine = fine & (F.col(f"c{i}_cum") <= target * F.col(f"c{i}_all"))
    recall = F.max(F.when(fine, F.col("p_cum") / F.col("p_all")))
    return ties.agg(F.max("p_all").alias("n_pos"), F.coalesce(recall, F.lit(0.0)).alias("recall"))
