import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import scalar as X
from assayer.operators import classify, constraints, grouped, models, resample, sampling


def test_scalars(spark):
    df = spark.sql("select array(1.0D, 2.0D, 2.0D) as a, -800.0D as x")
    r = df.select(X.argmax(F.col("a")).alias("i"), X.energy(F.col("a")).alias("e"), X.sigmoid(F.col("x")).alias("s"), X.max_softmax(F.col("a")).alias("m"), F.array_max(X.softmax(F.col("a"))).alias("m2")).first()
    assert r.i == 1 and r.e == pytest.approx(-np.log(np.exp([1, 2, 2]).sum())) and r.s == 0 and r.m == pytest.approx(r.m2)
    assert df.select(X.energy(F.transform("a", lambda x: x + 5)).alias("e")).first().e == pytest.approx(r.e - 5)


def test_violations(spark):
    df = spark.createDataFrame([(1, 0, 5, 9, 0), (1, 5, 9, 9, 1), (2, 0, 4, 9, 0), (2, 5, 9, 9, 1), (3, 0, 9, 9, 7)], "k int, s long, e long, n long, y int")
    assert sorted(r.k for r in constraints.bad_cover(df, ["k"], "s", "e", "n", "y", [0, 1, -1]).collect()) == [2, 3]
    with pytest.raises(constraints.Violation):
        constraints.require(df, "none")
    constraints.require(df.limit(0), "none")


def test_class_scores_of_an_absent_class(spark):
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int")
    found = {r.label: r for r in classify.class_scores(classify.matrix(df, "t", "p", labels)).collect()}
    assert found[2].f1 == 0 and found[2].precision is None and found[1].precision == 0.5


def test_empty_and_single_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    r = {x.g: x for x in grouped.spread(df, ["g"], "v").collect()}
    assert r["a"].std is None and r["a"].median == 1 and r["b"].n == 0 and r["b"].mean is None
    assert grouped.top_share(df.limit(0), "g", F.col("v")).first().share is None


def test_folds_are_even_and_stable(spark):
    df = spark.range(103).withColumnRenamed("id", "g")
    a, b = (sampling.folds(x, "g", 5, "n", 1).orderBy("g").collect() for x in (df, df.repartition(3)))
    assert a == b
    sizes = np.bincount([r.fold for r in a])
    assert sizes.max() - sizes.min() <= 1


def test_matched_mass_keeps_mass(spark):
    df = spark.createDataFrame([("s", i < 4, 1.0) for i in range(12)] + [("l", i < 6, 1.0) for i in range(24)] + [("o", False, 1.0)], "g string, m boolean, w double")
    out = {(r.g, r.m): r.t for r in sampling.matched_mass(df, ["g"], "m", "w", 0.25).groupBy("g", "m").agg(F.sum("new_weight").alias("t")).collect()}
    assert out[("s", True)] == pytest.approx(3) and out[("s", False)] == pytest.approx(9) and out[("o", False)] == 1


def test_verifier_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((90, 4)) + np.repeat(np.eye(3, 4) * 3, 30, 0)
    y = np.repeat(np.arange(3), 30)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int")
    v = models.fit_verifier(df, "x", "y")
    c = np.stack([x[y == k].mean(0) for k in range(3)])
    r = x - c[y]
    p = np.linalg.inv(0.9 * r.T @ r / 87 + 0.1 * np.eye(4))
    assert v.precision == pytest.approx(p)
    got = [row.distance for row in models.verify(models.centroid_logits(df, v, "x"), v, "x", "logits").collect()]
    want = [min((a - b) @ p @ (a - b) for b in c) for a in x]
    assert sorted(got) == pytest.approx(sorted(want))


def test_logistic_separates(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([((rng.standard_normal(3) + k * 2).tolist(), float(k)) for k in (0, 1) for _ in range(60)], "x array<double>, y double")
    out = models.logistic(df, "x", "y").score(df, "x").select("y", "margin").collect()
    assert np.mean([(r.margin > 0) == (r.y > 0) for r in out]) > 0.9


def test_draws_and_intervals(spark):
    df = spark.createDataFrame([(g, float(g % 4 == 0)) for g in range(40) for _ in range(5)], "g int, v double")
    drawn = resample.draws(df, "g", 100, 1)
    assert {r.t for r in drawn.groupBy("draw").agg(F.sum("w").alias("t")).collect()} == {40}
    r = resample.ratio_interval(df, "g", F.col("v"), F.lit(1), drawn).first()
    assert 0.05 < r.low < 0.25 < r.high < 0.45 and r.n_undefined == 0
    same = resample.paired_change(df, df, "g", F.col("v"), drawn).first()
    assert same.low == same.high == 0
