"""A shard's contexts are sorted in parts that bound a worker's memory, without any value cut in two."""

import numpy as np
import pyarrow as pa

from assayer.llm import suffixes


def test_shards_are_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    sizes, sort = [], suffixes.repeated
    monkeypatch.setattr(suffixes, "repeated", lambda own, length: sizes.append(sum(map(len, own))) or sort(own, length))
    half = [rng.integers(0, 256, 500).astype(np.uint8).tobytes() for _ in range(800)]
    own = half + [x[50:] + b"end" for x in half]  # each value has two contexts with 450 bytes in common
    value = [*range(800), *range(800)]
    at = [int(suffixes._pack(np.array(7), np.array(len(x) - 399), np.array(7))) for x in own]
    ids = pa.array(range(1600), pa.int64())
    columns = [ids, ids, pa.array(at, pa.int64()), pa.array(value, pa.int64()), pa.array([1] * 1600, pa.int32()), pa.array(own, pa.binary())]
    out = suffixes._sorted_shard(400)(pa.table(columns, names=["k_id", "k_text", "at", "value", "many", "own"]))
    got = sorted(zip(*(out.column(c).to_pylist() for c in ("k_id", "a", "b"))))
    assert got == [(i, 57, 108) for i in range(800)] + [(i, 7, 58) for i in range(800, 1600)]
    assert sum(sizes) == sum(map(len, own)) and max(sizes) <= suffixes.SORT_BYTES + 1000 < sum(sizes)


def test_copied_contexts_are_ranges(spark):
    """A passage in very many texts leaves each of them a range or two, not a row for each of its contexts."""
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = word(6000)
    texts = [word(499 + i) + chr(33 + i) + passage + chr(33 + i) + word(450) for i in range(60)] + [passage, passage, word(3000)]
    base = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)] + [(61, 61, passage)], "k_id long, k_text long, text string").repartition(3)
    runs = {r.k_id: sorted((x.a, x.b) for x in r.runs) for r in suffixes.repeated_windows(base).collect()}
    assert set(runs) == set(range(62)) and max(map(len, runs.values())) <= 3
    for i, own in runs.items():
        covered = {w for a, b in own for w in range(a, b)}
        start = 500 + i if i < 60 else 0
        assert covered == set(range(start, start + 6000 - 400 + 1))
