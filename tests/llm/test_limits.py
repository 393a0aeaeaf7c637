"""Limits come from all rated documents."""

import random

import numpy as np
import pytest
import zstandard

from assayer.llm import rules


def test_limits_from_all_rated_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(str(rng.randrange(10 ** rng.randint(1, 12))) for _ in range(rng.randint(30, 120)))) for i in range(13_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = df.selectExpr("doc_id", "cast(doc_id % 50 > 0 as int) as quality", "0 as toxic")
    press = zstandard.ZstdCompressor(level=rules.LEVEL).compress
    sizes, ratios = np.array([(len(t), len(t) / len(press(t.encode()))) for i, t in rows if i % 50]).T
    got = rules.fitted(df, labels)
    band = np.searchsorted(rules.FROM, sizes, "right") - 1
    assert min((band == k).sum() for k in (1, 2)) > 3000 and got.chunk == rules.WIDE_CHUNK
    for k, wide in enumerate(rules.WIDE):
        own = ratios[band == k]
        want = (np.quantile(own, rules.TAIL) * (1 - rules.MARGIN), np.quantile(own, 1 - rules.TAIL) * (1 + rules.MARGIN)) if len(own) >= rules.LEAST_FIT else wide
        assert got.bands[k] == pytest.approx(want, rel=1e-12)
