import random

import pytest

WORDS = [f"w{i}" for i in range(300)] + ["the", "of", "And", "été", "straße"] * 12


def text(rng, n, line=12):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + ("." if rng.random() < 0.12 else ""))
        out.append("\n" if rng.random() < 1 / line else " ")
    return "".join(out).strip()


def corpus(seed, n=160):
    """(doc_id, text) with copies, near copies, shared passages, repeats, junk, nulls and empty texts; ids out of order."""
    rng = random.Random(seed)
    base, passage = text(rng, 150), text(rng, 90, 1000)
    texts = [None, "", " \n\t ", "one", "one two", "one two", "a b c d e", base, base, base.upper(), "Of " * 400, "x" * 3000, "\n" * 50, "▁▁ a  b", passage, passage]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3:
            words = base.split(" ")
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        elif kind < 0.5:
            own = text(rng, rng.randint(0, 120))
            at = rng.randint(0, len(own))
            texts.append(own[:at] + rng.choice(["\n", " ", ""]) + passage + rng.choice(["\n", " ", ""]) + own[at:])
        elif kind < 0.6:
            texts.append(rng.choice(texts))
        else:
            texts.append(text(rng, rng.randint(1, 200)))
    ids = rng.sample(range(10 * n), len(texts))
    return list(zip(ids, texts))


@pytest.fixture(scope="session")
def rows():
    return corpus(1)


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names an operator might use for itself."""
    wide = [(i, t, f"s{i % 7}" if i % 11 else None, 1, "id", [1]) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, n int, component string, gone array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows, a repeated id with another text."""
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa\nlambda mu nu xi omicron pi rho sigma tau upsilon\n" * 6
    return spark.createDataFrame([(None, t, "s"), (None, None, None), (5, t, "s"), (5, t, "s"), (5, "other words entirely here now", None), (7, None, "s")], "doc_id long, text string, source string")
