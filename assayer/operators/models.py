"""Linear models and the source verifier. Fits run on the cluster; models are small arrays, and scores are column expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.scalar import argmax, dot, energy, linear, max_softmax, quadratic, sigmoid
from assayer.operators.sampling import order_statistic


def _constant(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


@dataclass
class Scaling:
    """Frozen normalisation: what is fitted on one set of rows and used for all others."""

    mean: list[float]
    scale: list[float]


@dataclass
class Linear:
    """A fitted model: one weight vector for two classes, one for each of more."""

    scaling: Scaling
    weights: list[list[float]]
    biases: list[float]

    def _margin(self, x: Column, k: int) -> Column:
        mean, scale = _constant(self.scaling.mean), _constant(self.scaling.scale)
        return linear(x, mean, scale, _constant(self.weights[k]), F.lit(self.biases[k]))

    def score(self, df: DataFrame, features: str) -> DataFrame:
        """Adds margin and probability (two classes), or logits and predicted (more)."""
        x = F.col(features).cast("array<double>")
        if len(self.weights) == 1:
            out = df.withColumn("margin", self._margin(x, 0))
            return out.withColumn("probability", sigmoid(F.col("margin")))
        out = df.withColumn("logits", F.array(*(self._margin(x, k) for k in range(len(self.weights)))))
        return out.withColumn("predicted", argmax(F.col("logits")))


def normalisation(train: DataFrame, features: str, weight: str | None = None) -> Scaling:
    """Mean and population deviation of each feature; a constant one has scale 1."""
    x = array_to_vector(F.col(features).cast("array<double>"))
    metrics = Summarizer.metrics("mean", "variance", "count")
    found = train.select(metrics.summary(x, F.col(weight)) if weight else metrics.summary(x)).first()[0]
    n = float(found["count"])
    spread = np.sqrt(np.asarray(found["variance"].toArray()) * (max(n - 1, 0) / max(n, 1)))
    return Scaling(found["mean"].toArray().tolist(), np.where(spread > 0, spread, 1.0).tolist())


def logistic(
    train: DataFrame, features: str, label: str, c: float = 1.0, weight: str | None = None, scaling: Scaling | None = None
) -> Linear:
    """L2 logistic regression on standardised features, for two classes (0, 1) or more (0 .. k - 1).

    scaling: a frozen normalisation; without it, that of the training rows. weight: a column of row weights. The penalty
    is 1 / (c * total weight), as the objective is a mean; scores agree with other solvers' to a tolerance, not bit by bit. A
    fit that doesn't settle is an error.
    """
    scaling = scaling or normalisation(train, features)
    mean, scale = _constant(scaling.mean), _constant(scaling.scale)
    z = F.zip_with(F.zip_with(F.col(features).cast("array<double>"), mean, lambda u, v: u - v), scale, lambda u, v: u / v)
    rows = train.select(array_to_vector(z).alias("_z"), F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    rows = rows.where("_w > 0")
    total = rows.agg(F.sum("_w")).first()[0]
    solver = LogisticRegression(featuresCol="_z", labelCol="_y", weightCol="_w", regParam=1 / (c * total), standardization=False, tol=1e-6, maxIter=2000)
    model = solver.fit(rows)
    if model.summary.totalIterations >= 2000:
        raise RuntimeError("the regression didn't settle")
    if model.numClasses == 2:
        return Linear(scaling, [model.coefficients.toArray().tolist()], [float(model.intercept)])
    return Linear(scaling, model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist())


def out_of_fold(df: DataFrame, features: str, label: str, fold: str, k: int, c: float = 1.0, weight: str | None = None) -> DataFrame:
    """Every row scored by the model that was fitted on the other folds. fold: 0 .. k - 1."""
    out = None
    for held in range(k):
        model = logistic(df.where(F.col(fold) != held), features, label, c, weight)
        part = model.score(df.where(F.col(fold) == held), features)
        out = part if out is None else out.unionByName(part)
    return out


def save_model(spark: SparkSession, model, path: str) -> str:
    """Writes a model as one row: its kind, its numbers as JSON, their digest and Spark's version. Returns the digest."""
    body = json.dumps(asdict(model), sort_keys=True, allow_nan=False)
    digest = hashlib.sha256(body.encode()).hexdigest()
    row = [(type(model).__name__, body, digest, spark.version)]
    spark.createDataFrame(row, "kind string, body string, sha256 string, spark string").write.mode("errorifexists").parquet(path)
    return digest


def load_model(spark: SparkSession, path: str):
    """The model of save_model(); numbers that don't fit their digest are an error."""
    row = spark.read.parquet(path).first()
    if hashlib.sha256(row.body.encode()).hexdigest() != row.sha256:
        raise ValueError(f"{path} isn't what was saved")
    values = json.loads(row.body)
    if row.kind == "Linear":
        return Linear(Scaling(**values.pop("scaling")), **values)
    return {"Scaling": Scaling, "Verifier": Verifier}[row.kind](**values)


@dataclass
class Verifier:
    """Class centroids and an inverse pooled covariance: small arrays of a fixed size."""

    labels: list[int]
    centroids: list[list[float]]
    precision: list[list[float]]


_SUMS = "label long, n long, total array<double>"


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sum of each label's vectors in a task."""
    seen: dict[int, list] = {}
    for batch in batches:
        label, x = batch.column("label").to_numpy(), np.stack(batch.column("x").to_numpy(zero_copy_only=False)) if batch.num_rows else None
        for k in np.unique(label).tolist():
            own = x[label == k]
            held = seen.setdefault(k, [0, np.zeros(x.shape[1])])
            held[0] += len(own)
            held[1] += own.sum(0)
    columns = zip(*((k, n, s.tolist()) for k, (n, s) in seen.items())) if seen else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["label", "n", "total"])


def _added(table: pa.Table) -> pa.Table:
    total = np.sum(table.column("total").to_pylist(), 0)
    n = int(np.sum(table.column("n").to_numpy()))
    return pa.table([table.column("label").slice(0, 1), pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["label", "n", "total"])


def _scatter(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(next(iter(centres.values())))
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            if batch.num_rows:
                middle = np.stack([centres[k] for k in batch.column("label").to_pylist()])
                x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)) - middle
                total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["label", "n", "total"])

    return run


def fit_verifier(df: DataFrame, features: str, label: str, keep: float = 0.9) -> Verifier:
    """Pooled within-class covariance over n - k, shrunk to keep * S + (1 - keep) * I, inverted on the driver.

    A task sends one sum for each class, and one d * d matrix of products; both are added up on executors.
    """
    rows = df.select(F.col(label).cast("long").alias("label"), F.col(features).cast("array<double>").alias("x")).where("label is not null and x is not null")
    sums = rows.mapInArrow(_class_sums, _SUMS).groupBy("label").applyInArrow(_added, _SUMS).orderBy("label").collect()
    labels, n = [r.label for r in sums], sum(r.n for r in sums)
    centres = {r.label: np.array(r.total) / r.n for r in sums}
    tasks = rows.mapInArrow(_scatter(centres), _SUMS).withColumn("label", F.spark_partition_id().cast("long") % 16)
    parts = tasks.groupBy("label").applyInArrow(_added, _SUMS).collect()
    d = len(centres[labels[0]])
    s = np.sum([r.total for r in parts], 0).reshape(d, d) / (n - len(labels))
    precision = np.linalg.inv(keep * s + (1 - keep) * np.eye(d))
    return Verifier(labels, [centres[k].tolist() for k in labels], precision.tolist())


def verify(df: DataFrame, model: Verifier, features: str, logits: str) -> DataFrame:
    """Adds distance (the least Mahalanobis one), msp and negative energy."""
    x = F.col(features).cast("array<double>")
    each = [quadratic(F.zip_with(x, _constant(c), lambda a, b: a - b), model.precision) for c in model.centroids]
    distance = F.least(*each) if len(each) > 1 else each[0]
    return df.withColumns({"distance": distance, "msp": max_softmax(F.col(logits)), "negative_energy": -energy(F.col(logits))})


def centroid_logits(df: DataFrame, model: Verifier, features: str) -> DataFrame:
    """logits from inner products with the centroids."""
    x = F.col(features).cast("array<double>")
    return df.withColumn("logits", F.array(*(dot(x, _constant(c)) for c in model.centroids)))


def confidence_cutoff(calibration: DataFrame, score: str, budget: float) -> DataFrame:
    """The largest cutoff (accept when score >= cutoff) that rejects at most the budget of the calibration rows: n, cutoff."""
    return order_statistic(calibration, [], score, budget)


def genuine_gate(calibration: DataFrame, margin: str, budget: float) -> DataFrame:
    """The largest gate (accept when margin <= gate) that accepts at most the budget of the genuine rows: n, gate. It is the
    next number below the first margin that must stay out."""
    found = order_statistic(calibration, [], margin, budget)
    gate = found.select("n", F.col("cutoff").cast("double").alias("gate"))
    return gate.mapInArrow(_below, "n long, gate double")  # one row


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gate = np.nextafter(batch.column("gate").to_numpy(zero_copy_only=False).astype(float), -np.inf)
        yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(gate)], names=["n", "gate"])
