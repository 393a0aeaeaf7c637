"""Classification metrics from counts; a label of -1 counts nowhere; undefined ratios are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import argmax, ratio


def confusion(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """tp, fp, tn, fn by group."""
    t, p = F.col(truth), F.col(predicted)
    cell = {"tp": (t == 1) & (p == 1), "fp": (t == 0) & (p == 1), "tn": (t == 0) & (p == 0), "fn": (t == 1) & (p == 0)}
    return df.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in cell.items()))


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, iou, fpr beside the counts."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "fpr": ratio(fp, fp + tn)})


def error_rates(df: DataFrame, by: list[str], score: str, reference: str, threshold: float, n: str | None = None) -> DataFrame:
    """Rates at a threshold (accept when score > threshold): n_ref, n_other, frr (references missed), far (others accepted).

    n: a column of the rows that a row stands for."""
    w = F.col(n) if n else F.lit(1)
    count = lambda c: F.sum(F.when(c, w).otherwise(0))
    ref, over = F.col(reference), F.col(score) > threshold
    out = df.groupBy(*by).agg(count(ref).alias("n_ref"), count(~ref).alias("n_other"), count(ref & ~over).alias("_missed"), count(~ref & over).alias("_taken"))
    return out.select(*by, "n_ref", "n_other", ratio(F.col("_missed"), F.col("n_ref")).alias("frr"), ratio(F.col("_taken"), F.col("n_other")).alias("far"))


def matrix(df: DataFrame, truth: str, predicted: str, labels: DataFrame, abstained: bool = False) -> DataFrame:
    """truth, predicted, n for all pairs of labels (one column ``label``), zero cells too; abstained adds predicted = -1."""
    columns = labels.select(F.col("label").alias("predicted"))
    if abstained:
        columns = columns.union(labels.sparkSession.range(1).select(F.lit(-1).cast(labels.schema["label"].dataType).alias("predicted")))
    grid = labels.select(F.col("label").alias("truth")).crossJoin(columns)
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, label, support, precision, recall, f1 from matrices; f1 is 0 for a class that is neither true nor predicted."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit")
    rows = cells.groupBy(*by, F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit)
    columns = cells.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    both = rows.join(columns, [*by, "label"], "left").withColumn("called", F.coalesce("called", F.lit(0)))
    f1 = F.coalesce(ratio(2 * F.col("hit"), F.col("support") + F.col("called")), F.lit(0.0))
    precision, recall = (ratio(F.col("hit"), F.col(c)) for c in ("called", "support"))
    return both.select(*by, "label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def macro(scores: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Mean over groups, once without and once with undefined groups as 0."""
    return scores.groupBy(*by).agg(F.avg(value).alias("macro"), F.avg(F.coalesce(value, F.lit(0.0))).alias("macro_zero"), F.count("*").alias("n_groups"))


def decide(df: DataFrame, policies: DataFrame, margin: str, score: str, logits: str) -> DataFrame:
    """Every row under every policy (policy, gate, cutoff; null cutoff rejects all): label or -1, state, reason."""
    every = df.crossJoin(F.broadcast(policies))
    passed, supported = F.col(margin) <= F.col("gate"), F.col("cutoff").isNotNull() & (F.col(score) >= F.col("cutoff"))
    label = F.when(passed & supported, argmax(F.col(logits))).otherwise(-1)
    reason = F.when(passed & supported, "accepted").when(F.col("cutoff").isNull(), "reject_all").when(~passed, "binary_gate").otherwise("support")
    state = F.when(passed & supported, "attributed").when(~passed, "genuine").otherwise("uncertain")
    return every.withColumns({"label_out": label, "state": state, "reason": reason, "gate_margin": F.col(margin) - F.col("gate"), "support_margin": F.col(score) - F.col("cutoff")})


#: Categories of a decision. Fixed values.
OUTCOMES = (
    "genuine_no_attribution", "genuine_false_attribution", "known_correct", "known_wrong", "known_rejected",
    "withheld_wrong_attribution", "withheld_rejected_real_like", "withheld_rejected_uncertain",
)


def outcome(role: Column, truth: Column, label: Column, state: Column) -> Column:
    """Category of a decision. role: genuine, known or withheld."""
    known = F.when(label == truth, "known_correct").when(label >= 0, "known_wrong").otherwise("known_rejected")
    withheld = F.when(label >= 0, "withheld_wrong_attribution").when(state == "genuine", "withheld_rejected_real_like").otherwise("withheld_rejected_uncertain")
    genuine = F.when(label >= 0, "genuine_false_attribution").otherwise("genuine_no_attribution")
    return F.when(role == "genuine", genuine).when(role == "known", known).otherwise(withheld)


def scorecard(df: DataFrame, category: str, by: list[str]) -> DataFrame:
    """Counts by outcome and their ratios, for each group and (by null) overall, in one pass."""
    out = df.rollup(*by).agg(*(F.count_if(F.col(category) == n).alias(n) for n in OUTCOMES))
    known = F.col("known_correct") + F.col("known_wrong") + F.col("known_rejected")
    withheld = F.col("withheld_wrong_attribution") + F.col("withheld_rejected_real_like") + F.col("withheld_rejected_uncertain")
    genuine = F.col("genuine_no_attribution") + F.col("genuine_false_attribution")
    return out.withColumns({
        "coverage": ratio(F.col("known_correct") + F.col("known_wrong"), known),
        "selective_accuracy": ratio(F.col("known_correct"), F.col("known_correct") + F.col("known_wrong")),
        "withheld_rejection": ratio(withheld - F.col("withheld_wrong_attribution"), withheld),
        "genuine_false_rate": ratio(F.col("genuine_false_attribution"), genuine),
    })
