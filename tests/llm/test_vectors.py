"""Recall of rare pairs, and an audit that fails."""

import numpy as np
import pytest

from assayer.llm import vectors


def isolated(n, pairs, dim=64):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        side = x[pairs + k] - (x[pairs + k] @ x[k]) * x[k]
        x[pairs + k] = 0.945 * x[k] + np.sqrt(1 - 0.945**2) * side / np.linalg.norm(side)
    return [(i, v, 0) for i, v in enumerate(x.tolist())]


def test_isolated_pairs_in_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 8)
    df = spark.createDataFrame(isolated(3000, 200), "vec_id long, embedding array<double>, label int").repartition(3)
    found = {r.vec_id: r.component_id for r in vectors.near_duplicates(df).collect()}
    assert sum(found[200 + k] == k for k in range(200)) >= 0.98 * 200


def test_a_failed_audit_is_no_result(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RECALL", 1.1)
    monkeypatch.setattr(vectors, "ATTEMPTS", 1)
    df = spark.createDataFrame(isolated(100, 20), "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="recall"):
        vectors.near_duplicates(df).count()


def crowds(seed=5, dim=32):
    """One label: a tight crowd, one whose pairs lie about the threshold, small families, noise; some ids twice."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = lambda n, angle: unit(unit(rng.standard_normal((1, dim))) + np.tan(angle) * unit(rng.standard_normal((n, dim))))
    x = np.concatenate([near(900, 0.1), near(700, 0.255), *(near(3, 0.05) for _ in range(150)), rng.standard_normal((1000, dim))])
    x = np.concatenate([x, x[:40]])[rng.permutation(len(x) + 40)]
    ids = rng.permutation(len(x))
    ids[:200] = ids[200:400]
    return ids.tolist(), x


def test_crowds_and_repeated_ids_against_brute_force(spark):
    ids, x = crowds()
    df = spark.createDataFrame([(i, v, 3, "extra") for i, v in zip(ids, x.tolist())], "vec_id long, embedding array<double>, label int, part string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= vectors.THRESHOLD
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:  # the least row reachable
        low = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    least = {r: min(i for i, q in zip(ids, root) if q == r) for r in set(root.tolist())}
    want = sorted(zip(ids, near.sum(1).tolist(), (least[r] for r in root.tolist())))
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect())
    assert len(found) == len(want)
    assert sum(a == b for a, b in zip(found, want)) >= 0.99 * len(want)
    assert found == want
