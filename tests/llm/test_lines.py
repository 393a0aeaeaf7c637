"""Line chunks have no line that can't be removed."""

import random

import pyarrow as pa

from assayer.llm import flat, lines


def test_every_line_of_a_copy_goes(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(["", "w w"]) if rng.random() < 0.1 else f"line {rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 40))) for _ in range(40)]
    texts = [t for t in texts if sum(x.strip() != "" for x in t.split("\n")) >= 2]
    buf, off = flat.bytes_of(pa.array(texts))
    assert lines.chunks(buf, off)[3].all()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts)], "doc_id long, text string").repartition(3)
    left = {r.row.doc_id: r.kept for r in lines.stripped(df).collect()}
    assert all(left[len(texts) + k] == "" for k in range(len(texts)))
