"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.lineage import cut

ROUNDS = 60
#: Edges that one task contracts by itself (16 MB).
TASK_EDGES = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as (node, smallest node reachable within them); at most one edge a node. What is held at a
    time is bounded by TASK_EDGES (twice that, with the forest so far)."""
    left, right, held = [], [], 0
    for batch in batches:
        left.append(batch.column(0).to_numpy())
        right.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > 2 * TASK_EDGES:
            a, b = _contracted(np.concatenate(left), np.concatenate(right))
            if len(a) > TASK_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                left, right, held = [], [], 0
            else:
                left, right, held = [a], [b], len(a)
    if held:
        a, b = _contracted(np.concatenate(left), np.concatenate(right))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("low"))
    large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), "low")
    joined = large.join(low, F.col("a") == F.col("k"))
    small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.union(low.select(F.col("k").alias("a"), F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b) that isn't itself the smallest of its component.

    Self links and repeated edges change nothing; an edge with a null end is no edge.
    Up to TASK_EDGES edges are one task's work. Of more, each task contracts its own first, and star rounds follow:
    every step of theirs is a join or a grouped minimum that combines before the shuffle, so a node with
    very many edges is dealt over tasks. The rounds grow with the logarithm of the longest path.
    """
    edges = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = cut(edges)
    parts = math.ceil(edges.count() / TASK_EDGES)
    # A fixed number of edges fits into a task; as many as there are of those are contracted where they lie.
    edges = cut((edges.coalesce(parts) if 0 < parts < edges.rdd.getNumPartitions() else edges).mapInArrow(_forest, "a long, b long"))
    if parts <= 1:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    seen = None
    for _ in range(ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = cut(_stars(edges))
    else:
        raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
