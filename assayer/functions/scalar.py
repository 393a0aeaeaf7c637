"""Scalar and array expressions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null where b is 0 or either is null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, mean: Column, scale: Column, weight: Column, bias: Column) -> Column:
    """((x - mean) / scale) . weight + bias."""
    return dot(F.zip_with(F.zip_with(x, mean, lambda u, v: u.cast("double") - v), scale, lambda u, v: u / v), weight) + bias


def log_sum_exp(a: Column, temperature: float = 1.0) -> Column:
    most = F.array_max(a)
    return most + temperature * F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp((x - most) / temperature)))


def energy(logits: Column, temperature: float = 1.0) -> Column:
    """-T log sum exp(z / T): lower for more confident rows."""
    return -log_sum_exp(logits, temperature)


def softmax(logits: Column) -> Column:
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most))
    return F.transform(logits, lambda x: F.exp(x - most) / total)


def max_softmax(logits: Column) -> Column:
    most = F.array_max(logits)
    return 1 / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most))


def argmax(a: Column) -> Column:
    """0-based index of the first largest entry."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def quadratic(r: Column, p: list[list[float]]) -> Column:
    """r' P r for a constant matrix."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in p))
    return dot(F.transform(rows, lambda row: dot(row, r)), r)


def decibels(x: Column, floor: float = 1e-12) -> Column:
    return 20 * F.log10(F.greatest(x.cast("double"), F.lit(floor)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def resampled_length(n: Column, source: int = 48_000, target: int = 22_050) -> Column:
    """ceil(n * target / source) in integers."""
    return F.floor((n * target + (source - 1)) / source).cast("long")


def plain_text(x: Column) -> Column:
    """Lower case, outer blanks off, runs of blanks as one space."""
    return F.regexp_replace(F.lower(F.trim(x)), "\\s+", " ")


def repeat_to(a: Column, n: int) -> Column:
    """An array repeated and cut to n entries."""
    return F.slice(F.flatten(F.array_repeat(a, F.ceil(F.lit(n) / F.size(a)).cast("int"))), 1, n)


def hash_order(namespace: str, seed: int, value: Column) -> Column:
    """The hexadecimal digest by which seed:namespace:value is ranked."""
    return F.sha2(F.concat(F.lit(f"{seed}:{namespace}:"), value.cast("string")), 256)
