import numpy as np
from pyspark.sql import functions as F

from assayer.operators import intervals as I


def test_grid_anchors_its_last_window(spark):
    df = spark.createDataFrame([(0,), (4,), (10,), (25,)], "n long")
    found = {}
    for r in I.grid(df, "n", 10, 6).collect():
        found.setdefault(r.n, []).append(r.start)
    assert found == {4: [0], 10: [0], 25: [0, 6, 12, 15]}


def test_edit_labels(spark):
    for fade in (0, 1, 3):
        df = spark.createDataFrame([(40, 8, 30, fade)], "n long, a long, b long, f long")
        found = sorted((r.run_start, r.run_end, r.label) for r in I.labels_of_edit(df, "n", "a", "b", "f").collect())
        assert found[0][0] == 0 and found[-1][1] == 40 and all(x[1] == y[0] for x, y in zip(found, found[1:]))
        assert sum(e - s for s, e, y in found if y == -1) == 2 * fade
        assert (8 + fade, 30 - fade, 1) in found


def test_guard_against_dense_labels(spark):
    rng = np.random.default_rng(5)
    for guard in (0, 1, 3):
        runs, want = [], {}
        for key in range(12):
            cuts = np.unique(np.concatenate([[0, 60], rng.integers(1, 60, 4)]))
            labels = []
            for _ in cuts[1:]:
                labels.append(int(rng.choice([y for y in (-1, 0, 1) if not labels or y != labels[-1]])))
            dense = np.concatenate([np.full(b - a, y) for a, b, y in zip(cuts, cuts[1:], labels)])
            runs += [(key, 60, int(a), int(b), y) for a, b, y in zip(cuts, cuts[1:], labels)]
            out = dense.copy()
            if guard:
                marked = dense == -1
                marked[1:] |= dense[1:] != dense[:-1]
                for i in np.flatnonzero(marked):
                    out[max(0, i - guard) : i + guard + 1] = -1
                out[:guard] = out[60 - guard :] = -1
            want[key] = out
        df = spark.createDataFrame(runs, "key int, n long, run_start long, run_end long, label int")
        for key in want:
            got = np.full(60, -1)
            for r in I.guarded(df.where(F.col("key") == key), ["key"], "n", guard).collect():
                got[r.run_start : r.run_end] = r.label
            assert got.tolist() == want[key].tolist(), (guard, key)


def test_islands(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 5, 9), (0, 12, 20), (0, 13, 14), (0, 30, 30), (1, 3, 4)], "k int, s long, e long")
    at = lambda gap: sorted((r.k, r.start, r.end) for r in I.islands(df, ["k"], "s", "e", gap).collect())
    assert at(0) == [(0, 0, 9), (0, 12, 20), (1, 3, 4)]
    assert at(3) == [(0, 0, 20), (1, 3, 4)]
    assert I.islands(df.limit(0), ["k"], "s", "e").count() == 0


def test_quiet_ends(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0, 0.0],), ([0.0, 0.0],)], "x array<double>")
    assert [tuple(r.q) for r in df.select(I.quiet_ends(F.col("x"), 0.5, 1).alias("q")).collect()] == [(2.0, 2.0), (2.0, 0.0)]  # the last loud sample counts as quiet


def test_score_guard():
    assert I.score_guard([(1000, 250, 1), (1000, 250, 3)], 100) == 100 + 500 + 250 + 125
