import numpy as np
import pytest

from assayer.operators import patches as P


def test_slopes_by_differences():
    rng = np.random.default_rng(0)
    x, y, w = rng.standard_normal((5, 8, 5)), np.array([0.0, 1, 1, 0, 1]), rng.uniform(0.5, 2, 5)
    net = P.start(x, 3, channels=2)
    _, slopes = P.loss_and_slopes(net, x, y, w, 0.01)
    for name, slope in zip(("filters", "offsets", "head"), slopes):
        value = getattr(net, name)
        for at in [tuple(rng.integers(0, value.shape)) for _ in range(6)]:
            keep, out = value[at], []
            for step in (1e-6, -1e-6):
                value[at] = keep + step
                out.append(P.loss_and_slopes(net, x, y, w, 0.01)[0])
            value[at] = keep
            assert (out[0] - out[1]) / 2e-6 == pytest.approx(slope[at], abs=1e-6)


def test_patches_are_told_apart(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 24, 7))
    y = np.arange(600) % 2
    x[y == 1, 5:9, 2:5] += 1.0
    assert P.start(x, 0).size == 521
    rows = [(k, v.ravel().tolist(), int(t)) for k, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(600, None, 1)], "k int, x array<double>, y int")
    net = P.fit_on(df.where("k < 400"), "k", "x", "y", 24, epochs=8)
    out = {r.k: r.margin for r in P.score(df.where("k >= 400"), net, ["k"], "x").collect()}
    assert len(out) == 200 and np.mean([(m > 0) == (k % 2 == 1) for k, m in out.items()]) > 0.9
    with pytest.raises(ValueError):
        P.start(x[:, :23], 0)
