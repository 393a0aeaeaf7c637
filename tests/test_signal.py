import numpy as np
import pytest

from assayer.functions import signal as G

RATE = 16_000


def test_tone_features():
    t = np.arange(4096) / RATE
    x = np.sin(2 * np.pi * 1000 * t)
    f = G.window_features(np.stack([x, np.zeros_like(x)]), RATE)
    assert f.shape == (2, 31)
    assert np.argmax(f[0, :24]) in (2, 3) and abs(f[0, 24] - 1000) < 20 and np.isfinite(f).all()


def test_band_limit_and_fraction():
    t = np.arange(8192) / RATE
    x = np.sin(2 * np.pi * 500 * t) + np.sin(2 * np.pi * 6000 * t)
    assert G.high_fraction(x, RATE, 4000) == pytest.approx(0.5, abs=0.01)
    assert G.high_fraction(G.low_pass(x, RATE, 4000), RATE, 4000) < 1e-9
    assert G.high_fraction(np.zeros(64), RATE, 4000) == 0


def test_lag_sign():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(3000)
    assert G.lag(np.concatenate([np.zeros(7), x]), x)[0] == 7
    assert G.lag(x, np.concatenate([np.zeros(7), x]))[0] == -7


def test_splice():
    x = np.round(np.random.default_rng(2).uniform(-0.5, 0.5, 200) * 32768) / 32768
    assert (G.splice(x, x[50:90], 50, 5) == x).all()
    y = G.splice(x, np.zeros(40), 50, 5)
    assert (y[:50] == x[:50]).all() and (y[90:] == x[90:]).all() and (y[55:85] == 0).all()


def test_periodicity_and_mel():
    t = np.arange(4000) / RATE
    assert G.periodicity(np.sin(2 * np.pi * 200 * t), RATE) > 0.9
    assert G.mel_triangles(RATE, 512, 24).sum(1) == pytest.approx(np.ones(24))
    assert G.mel_cepstral_distortion(np.ones((3, 4)), np.ones((3, 4))) == 0


def test_null_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "k int, x array<double>")
    assert {r.k: r.v for r in G.apply(df, "x", ["k"], lambda x: x.sum(), "v").collect()} == {1: [3.0], 2: None, 3: None}
