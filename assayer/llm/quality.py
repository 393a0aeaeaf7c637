"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered; P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector over hashed
text features for all thresholds. The expected grade and the tail probability P(grade >= select)
come from it; a document is kept when the tail probability reaches ``MIN_TAIL``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat
from assayer.llm.lineage import small_batches

#: Word buckets; SHAPES buckets for word shapes follow them.
WORDS, SHAPES = 1 << 18, 1 << 10
#: Labelled rows that the model is fitted on at most: those with the smallest hash of doc_id. This bounds the
#: driver's part; every document is scored.
FIT_ROWS = 12_000
EPOCHS = 25
BATCH = 256
RATE = 0.3
SHRINK = 1e-4  # L1, by which buckets without evidence stay at 0
#: Buckets in fewer of the fitted rows take no part.
LEAST_ROWS = 8
GRADES = 3
SELECT = 2
MIN_TAIL = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, values and n + 1 offsets. Words count as present or not; shapes and repeats by the root of their share."""
    n = len(off) - 1
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0), np.zeros(n + 1, np.int64)
    plain = np.where(_LETTER[buf], flat._LOWER[buf], 32).astype(np.uint8)
    starts, ends, at = flat.words(plain, off)
    h = flat.span_hashes(plain, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(at))
    key = np.unique(doc * (WORDS + SHAPES) + (h % flat.U(WORDS)).astype(np.int64))
    # A word's shape: classes of characters, a run of one class taken once.
    starts, ends, at = flat.words(buf, off)
    shape = _SHAPE[buf]
    fresh = np.ones(len(buf), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[starts] = True
    fresh &= ~flat._SPACE[buf]
    order = np.concatenate([[0], np.cumsum(fresh)])
    shapes = flat.span_hashes(shape[fresh], order[starts], order[ends]) if len(starts) else np.empty(0, flat.U)
    raw = flat.span_hashes(buf, starts, ends)
    own = np.repeat(np.arange(n), np.diff(at))
    again = np.flatnonzero((raw[1:] == raw[:-1]) & (own[1:] == own[:-1])) + 1
    total = np.maximum(np.diff(at), 1)
    shape_key = np.concatenate([own * (WORDS + SHAPES) + WORDS + 1 + (shapes % flat.U(SHAPES - 1)).astype(np.int64), own[again] * (WORDS + SHAPES) + WORDS])
    shape_key, many = np.unique(shape_key, return_counts=True)
    value = np.concatenate([np.ones(len(key)), np.sqrt(many / total[shape_key // (WORDS + SHAPES)]) * 4])
    key = np.concatenate([key, shape_key])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return key % (WORDS + SHAPES), value, np.searchsorted(key, np.arange(n + 1) * (WORDS + SHAPES))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) in column k, k < GRADES - 1."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def score(self, bucket: np.ndarray, value: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Each text's sum by itself, so that it doesn't depend on the texts beside it."""
        return np.bincount(np.repeat(np.arange(len(off) - 1), np.diff(off)), self.weights[bucket] * value, len(off) - 1)

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= SELECT)."""
        low = self.at_most(score)
        return (1 - low).sum(1), 1 - low[:, SELECT - 1]


def slopes(cuts: np.ndarray, score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the sum of -log P(grade) by each score and by each threshold."""
    n = len(grade)
    low = np.concatenate([np.zeros((n, 1)), Model(np.empty(0), cuts).at_most(score), np.ones((n, 1))], 1)
    slope, at = low * (1 - low), np.arange(n)
    p = np.maximum(low[at, grade + 1] - low[at, grade], 1e-9)
    d_cuts = np.zeros(len(cuts) + 2)
    np.add.at(d_cuts, grade + 1, -slope[at, grade + 1] / p)
    np.add.at(d_cuts, grade, slope[at, grade] / p)
    return (slope[at, grade + 1] - slope[at, grade]) / p, d_cuts[1:-1]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int = GRADES, epochs: int = EPOCHS) -> Model:
    """rows: (buckets, values) of each example. Batches in a fixed order, adaptive steps, soft thresholding by SHRINK."""
    w, squares = np.zeros(WORDS + SHAPES), np.full(WORDS + SHAPES, 1e-4)
    share = np.clip(np.array([(grade <= k).mean() for k in range(grades - 1)]), 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    cuts, cut_squares = np.maximum.accumulate(cuts + 1e-3 * np.arange(grades - 1)), np.full(grades - 1, 1e-4)
    seen = np.bincount(np.concatenate([b for b, _ in rows]), minlength=len(w)) >= LEAST_ROWS
    rows = [(b[seen[b]], v[seen[b]]) for b, v in rows]
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            bucket, value = np.concatenate([rows[j][0] for j in pick]), np.concatenate([rows[j][1] for j in pick])
            off = np.concatenate([[0], np.cumsum([len(rows[j][0]) for j in pick])])
            d_score, d_cuts = slopes(cuts, Model(w, cuts).score(bucket, value, off), grade[pick])
            g = np.bincount(bucket, np.repeat(d_score, np.diff(off)) * value, WORDS + SHAPES) / len(pick)
            touched = np.flatnonzero(g)
            squares[touched] += g[touched] ** 2
            step = RATE / np.sqrt(squares[touched])
            w[touched] -= step * g[touched]
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK / np.sqrt(squares), 0)
            d = d_cuts / len(pick)
            cut_squares += d**2
            cuts = np.maximum.accumulate(cuts - RATE * d / np.sqrt(cut_squares))
    return Model(w, cuts)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.slices(batch):
            bucket, value, off = features(*flat.bytes_of(part.column("text")))
            lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), x) for x in (pa.array(bucket.astype(np.int32)), pa.array(value.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([part.column("grade"), *lists], names=["grade", "bucket", "value"])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for quality 0, 1 for quality 1 but toxic, 2 for the rest; the lowest where rows disagree.

    Rows with a null doc_id or quality give no grade; a null toxic counts as not toxic.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """The model, or None where fewer than two grades are there to learn from."""
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.join(sample, "doc_id").select("doc_id", "text", "grade").orderBy("doc_id", F.xxhash64("text"), "text").limit(rows).mapInArrow(_features, "grade int, bucket array<int>, value array<float>").toArrow()
    grade = found.column("grade").to_numpy().astype(np.int64)
    if len(set(grade.tolist())) < 2:
        return None
    rows_of = [(np.asarray(b.values), np.asarray(v.values, np.float64)) for b, v in zip(found.column("bucket"), found.column("value"))]
    return fit(rows_of, grade)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, expected_grade, tail_prob, kept.

    labels: doc_id, quality, toxic (see graded()). Null and empty texts get the score of no evidence.
    Without labels of two grades at least, expected_grade and tail_prob are null and all rows are kept.
    Repeated rows and null doc_ids are scored like any other; other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_on(docs, labels)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_prob"), F.lit(True).alias("kept"))
    return docs.mapInArrow(scorer(model, False), "doc_id long, expected_grade double, tail_prob double, kept boolean")


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with all their columns as they were."""
    model = fit_on(docs, labels)
    if model is None:
        return docs
    return docs.mapInArrow(scorer(model, True), docs.schema)


def scorer(model: Model, select: bool):
    used = np.flatnonzero(model.weights).astype(np.int32)
    weight, thresholds = model.weights[used], model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(WORDS + SHAPES)
        full[used] = weight
        own = Model(full, thresholds)
        for batch in batches:
            for part in flat.slices(batch):
                expected, tail = own.grades(own.score(*features(*flat.bytes_of(part.column("text")))))
                kept = pa.array(tail >= MIN_TAIL)
                yield part.filter(kept) if select else pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected), pa.array(tail), kept], names=["doc_id", "expected_grade", "tail_prob", "kept"])

    return run
