import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import ranking

#: Reference scores, other scores, equal error rate.
CASES = [
    ([0, 0, 0, 0], [0, 0, 0, 0], 0.5),
    ([7, 7], [7, 7, 7, 7, 7], 0.5),
    ([0, 1, 2], [0, 1, 2], 0.5),
    ([5] * 4, [-5] * 4, 0.0),
    ([-5] * 4, [5] * 4, 1.0),
    ([0, 1, 1], [0, 0, 1], 1 / 3),
    ([0, 1, 1, 2], [0, 0, 1], 3 / 10),
    ([1, 2, 3], [0, 1], 1 / 5),
    ([0, 3, 5], [1, 2], 1 / 3),
]


def rows(spark, cases):
    return spark.createDataFrame([(i, float(s), r) for i, (a, b, _) in enumerate(cases) for r, x in ((True, a), (False, b)) for s in x], "k int, score double, is_ref boolean")


def test_equal_error_rates(spark):
    found = {r.k: r.eer for r in ranking.eer(rows(spark, CASES), ["k"], "score", F.col("is_ref")).collect()}
    assert found == pytest.approx({i: c[2] for i, c in enumerate(CASES)})


def test_one_class_gives_nothing(spark):
    df = rows(spark, [([1, 2], [], 0)])
    assert ranking.eer(df, ["k"], "score", F.col("is_ref")).count() == 0
    assert ranking.auroc(df, ["k"], "score", F.col("is_ref")).first().auroc is None
    assert ranking.eer(df.limit(0), ["k"], "score", F.col("is_ref")).count() == 0


def test_areas_by_counting(spark):
    rng = np.random.default_rng(3)
    cases = [(rng.integers(0, 6, 20).tolist(), rng.integers(0, 5, 30).tolist(), 0) for _ in range(5)]
    found = {r.k: r.auroc for r in ranking.auroc(rows(spark, cases), ["k"], "score", F.col("is_ref")).collect()}
    for i, (a, b, _) in enumerate(cases):
        assert found[i] == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b]))


def test_spearman_needs_three_pairs_and_two_values(spark):
    df = spark.createDataFrame([("few", 1.0, 2.0), ("few", 2.0, 1.0), *[("flat", 1.0, float(i)) for i in range(4)], *[("rev", float(i), -float(i)) for i in range(4)]], "g string, x double, y double")
    assert {r.g: r.rho for r in ranking.spearman(df, ["g"], "x", "y").collect()} == {"few": None, "flat": None, "rev": pytest.approx(-1)}
