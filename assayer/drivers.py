"""Whole reports: each reads tables, runs operators, and publishes its results with their provenance.

Tables are Parquet folders, or CSV files with a header, in any store that Spark reads. Results are published whole or not
at all; an existing target is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import classify, grouped, intervals, models, ranking, resample
from assayer.sources.files import BadSource
from assayer.sources.records import require_columns, same_keys
from assayer.sources.sinks import provenance, publish


def read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table that has these columns."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return require_columns(df, columns, path)


def _publish(out: str, inputs: dict[str, DataFrame], **tables: DataFrame) -> None:
    spark = next(iter(inputs.values())).sparkSession
    for name, df in tables.items():
        publish(df, f"{out}/{name}")
    publish(provenance(spark, inputs), f"{out}/provenance")


def detection(spark: SparkSession, scores: str, out: str, reference: str = "real", draws: int = 1000, seed: int = 0) -> None:
    """scores: condition, score, and protocol, tier, which are never pooled. Writes the error rate and area of each condition against the
    reference, with bootstrap intervals, and each condition's rates at the threshold."""
    rows = read(spark, scores, ["condition", "score", "protocol", "tier"])
    kind = ["protocol", "tier"]
    pairs = rows.where(F.col("condition") != reference).withColumn("is_ref", F.lit(False))
    groups = pairs.select(*kind, "condition").distinct()
    refs = rows.where(F.col("condition") == reference).drop("condition").join(groups, kind).withColumn("is_ref", F.lit(True))
    both = pairs.select(*kind, "condition", "score", "is_ref").unionByName(refs.select(*kind, "condition", "score", "is_ref"))
    by = [*kind, "condition"]
    found = ranking.eer(both, by, "score", F.col("is_ref")).join(ranking.auroc(both, by, "score", F.col("is_ref")).select(*by, "auroc"), by)
    ends = resample.eer_interval(both, by, "score", "is_ref", draws, seed)
    _publish(out, {"scores": rows}, error_rates=found.join(ends, by, "left"))


def quality(spark: SparkSession, measures: str, out: str, by: tuple[str, ...] = ("condition",), values: tuple[str, ...] = ()) -> None:
    """measures: one row for each item, with the group columns. Writes mean, deviation and count of the values (all numeric columns where
    none are named), and the values' distributions."""
    rows = read(spark, measures, [*by, *values])
    summary = grouped.numeric_summary(rows.select(*by, *values) if values else rows, list(by))
    spreads = [grouped.distribution(rows, list(by), v).withColumn("measure", F.lit(v)) for v in values]
    tables = {"summary": summary}
    for part in spreads:
        tables["distributions"] = tables["distributions"].unionByName(part) if "distributions" in tables else part
    _publish(out, {"measures": rows}, **tables)


def headline(spark: SparkSession, qualities: str, detections: str, out: str) -> None:
    """qualities: condition, quality. detections: condition, eer. Writes both side by side, their rank correlation and its verdict."""
    q, d = read(spark, qualities, ["condition", "quality"]), read(spark, detections, ["condition", "eer"])
    table = q.select("condition", "quality").join(d.select("condition", "eer"), "condition", "full")
    rho = ranking.spearman(table, [], "quality", "eer").withColumn("strength", ranking.verdict(F.col("rho")))
    _publish(out, {"qualities": q, "detections": d}, headline=table, correlation=rho)


def pilot(spark: SparkSession, features: str, out: str) -> None:
    """features: id, split (train, eval), label (0, 1), features (array). Fits on train alone; writes the model, the predictions of eval with
    their metrics, and refuses an id in both splits."""
    rows = read(spark, features, ["id", "split", "label", "features"])
    crossed = rows.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").limit(3).collect()
    if crossed:
        raise BadSource(f"ids in several splits: {[r.id for r in crossed]}")
    model = models.logistic(rows.where("split = 'train'"), "features", "label")
    models.save_model(spark, model, f"{out}/model")
    scored = model.score(rows.where("split = 'eval'"), "features").withColumn("predicted", (F.col("margin") > 0).cast("int"))
    predictions = scored.select("id", F.col("label").cast("int").alias("label"), "margin", "probability", "predicted")
    counts = classify.rates(classify.confusion(predictions, [], "label", "predicted"))
    area = ranking.auroc(predictions, [], "margin", F.col("label") == 1)
    _publish(out, {"features": rows}, predictions=predictions, metrics=counts.crossJoin(area))


def predict(spark: SparkSession, model: str, features: str, out: str) -> None:
    """features: id, features. Scores rows that have no labels with a saved model."""
    rows = read(spark, features, ["id", "features"])
    scored = models.load_model(spark, model).score(rows, "features").drop("features")
    _publish(out, {"features": rows}, predictions=scored)


def verification(spark: SparkSession, features: str, out: str, budget: float = 0.05) -> None:
    """features: id, split (fit, calibration, held), source (null: genuine; -1: withheld), margin, features. Fits the verifier on known sources of
    fit, takes the support cutoff and the genuine gate from calibration, and writes every held row's decision with the scorecard."""
    rows = read(spark, features, ["id", "split", "source", "margin", "features"])
    known = F.col("source") >= 0
    model = models.fit_verifier(rows.where((F.col("split") == "fit") & known), "features", "source")
    models.save_model(spark, model, f"{out}/model")
    scored = models.verify(models.centroid_logits(rows, model, "features"), model, "features", "logits")
    calibration = scored.where("split = 'calibration'")
    cutoff = models.confidence_cutoff(calibration.where(known), "msp", budget).select("cutoff")
    gate = models.genuine_gate(calibration.where("source is null"), "margin", budget).select("gate")
    policy = gate.crossJoin(cutoff).select(F.lit("gate_and_support").alias("policy"), "gate", "cutoff")
    decided = classify.decide(scored.where("split = 'held'"), policy, "margin", "msp", "logits")
    # A label is a place in the list of known sources.
    truth = F.array_position(F.array(*map(F.lit, model.labels)), F.col("source").cast("long")) - 1
    role = F.when(F.col("source").isNull(), "genuine").when(known, "known").otherwise("withheld")
    decided = decided.withColumn("category", classify.outcome(role, truth, F.col("label_out"), F.col("state")))
    kept = ["id", "policy", "label_out", "state", "reason", "gate_margin", "support_margin", "category"]
    _publish(out, {"features": rows}, decisions=decided.select(*kept), scorecard=classify.scorecard(decided, "category", ["policy"]), policy=policy)


def localization(spark: SparkSession, windows: str, runs: str, out: str, threshold: float = 0.5, merge: int = 0) -> None:
    """windows: example_id, size, start, length, probability. runs: example_id, run_start, run_end, label (tiling each example).
    Writes the events found, how each reference event is matched, and positions' metrics by example and over all."""
    cells_of, truth = read(spark, windows, ["example_id", "size", "start", "length", "probability"]), read(spark, runs, ["example_id", "run_start", "run_end", "label"])
    key = ["example_id"]
    same_keys(cells_of.select(*key).distinct(), truth.select(*key).distinct(), key)
    lengths = [r.length for r in cells_of.select("length").distinct().limit(2).collect()]
    if len(lengths) != 1:
        raise BadSource(f"windows of lengths {lengths}")
    cells = intervals.cells(cells_of, key, "start", lengths[0], "size")
    events = intervals.events(cells, key, "probability", threshold, merge)
    wanted = truth.where("label = 1").select(*key, F.col("run_start").alias("start"), F.col("run_end").alias("end"))
    hit = (F.col("probability") >= threshold).cast("int")
    both = intervals.overlaps(cells, truth.where("label >= 0"), key, ("cell_start", "cell_end"), ("run_start", "run_end"))
    width = F.least("cell_end", "run_end") - F.greatest("cell_start", "run_start")
    cell = lambda t, p: F.sum(F.when((F.col("label") == t) & (hit == p), width).otherwise(0))
    counts = both.groupBy(*key).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))
    whole = classify.rates(counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn"))))
    matched = intervals.matched_events(events, wanted, key)
    _publish(out, {"windows": cells_of, "runs": truth}, events=events, matched=matched, by_example=classify.rates(counts), overall=whole)


def paired(spark: SparkSession, before: str, after: str, out: str, group: str = "source", draws: int = 2000, seed: int = 0) -> None:
    """before, after: the group column and value, over the same groups. Writes the change of the mean over groups with its interval."""
    a, b = read(spark, before, [group, "value"]), read(spark, after, [group, "value"])
    same_keys(a.select(group).distinct(), b.select(group).distinct(), [group])
    drawn = resample.draws(a, group, draws, seed)
    change = resample.paired_change(a, b, group, F.col("value"), drawn)
    means = [df.groupBy(group).agg(F.avg("value").alias("value")).agg(F.avg("value").alias(name)) for df, name in ((a, "before"), (b, "after"))]
    _publish(out, {"before": a, "after": b}, change=means[0].crossJoin(means[1]).crossJoin(change))


DRIVERS = {f.__name__: f for f in (detection, quality, headline, pilot, predict, verification, localization, paired)}
