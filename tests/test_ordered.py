"""Running sums, ranks and quantiles over slots against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import ordered, ranking, sampling

VALUES = [0.0, -0.0, 1.0, 1e-300, 5e-324, -7.5, 1e308, -1e308, 0.1, 0.1 + 1e-17, 1000.0, 1000.5]


def test_slots_never_fall(spark):
    rng = random.Random(1)
    groups = {"wide": VALUES, "near": [1000 + rng.random() for _ in range(200)], "one": [4.0], "whole": [float(i) for i in range(-50, 50)], None: [rng.gauss(0, 1) for _ in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    found = ordered.slotted(df, ["g"], "v").collect()
    assert len(found) == sum(map(len, groups.values()))
    for g in groups:
        slots = [r._slot for r in sorted((r for r in found if r.g == g), key=lambda r: r.v)]
        assert slots == sorted(slots)
    assert len({r._slot for r in found if r.g == "whole"}) > 90


@pytest.mark.parametrize("falling", [False, True])
def test_running_sums(spark, falling):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if k else None, v, rng.randint(0, 9)) for k, v in enumerate(sorted({rng.lognormvariate(0, 3) for _ in range(400)}))]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(4)
    out = {(r.g, r.v): (r.n_cum, r.n_all) for r in ordered.running(df, ["g"], "v", ["n"], falling).collect()}
    assert len(out) == len(rows)
    for g, v, _ in rows:
        before = [n for h, w, n in rows if h == g and (w >= v if falling else w <= v)]
        assert out[g, v] == (sum(before), sum(n for h, _, n in rows if h == g))


def test_quantiles_and_order_statistics(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 301).astype(float)
    df = spark.createDataFrame([(1, v) for v in x.tolist()] + [(1, None), (2, 5.0)], "g int, v double").repartition(3)
    out = {r.g: r for r in ordered.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}).collect()}
    assert (out[1].a, out[1].b, out[1].c, out[1].n) == (*np.quantile(x, [0.05, 0.5, 1.0]), 301) and out[2].a == 5
    assert sampling.order_statistic(df.where("g = 1"), [], "v", 0.25).first().cutoff == np.sort(x)[75]


def test_ungrouped_ranks_are_those_of_one_window(spark):
    df = spark.range(5000).repartition(6)
    want = sorted(range(5000), key=lambda i: (__import__("hashlib").sha256(f"9:n:{i}".encode()).hexdigest(), i))
    assert [r.id for r in sampling.ranked(df, "id", "n", 9).orderBy("rank").collect()] == want


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_scores_that_are_no_numbers_are_refused(spark, bad):
    df = spark.createDataFrame([("g", 1.0, True), ("g", bad, False)], "g string, s double, r boolean")
    for f in (ranking.eer, ranking.auroc, ranking.least_balanced_error):
        with pytest.raises(Exception, match="finite"):
            f(df, ["g"], "s", F.col("r")).collect()
    with pytest.raises(Exception, match="finite"):
        ranking.control_cutoff(df, ["g"], "s", F.lit(1), 0.1).collect()
    with pytest.raises(Exception, match="finite"):
        ranking.spearman(df.withColumn("o", F.lit(1.0)), ["g"], "s", "o").collect()


def test_products_of_counts_beyond_64_bits(spark):
    n = 10**13
    df = spark.createDataFrame([(0.0, True, n), (1.0, True, n), (0.5, False, n), (2.0, False, 3 * n)], "s double, r boolean, n long")
    r = ranking.eer(df, [], "s", F.col("r"), F.col("n")).first()
    assert r.n_ref == 2 * n and r.eer == pytest.approx(0.75 if r.threshold == 1.0 else r.eer)
    assert ranking.auroc(df, [], "s", F.col("r"), F.col("n")).first().auroc == pytest.approx(0.125)
