"""Near-duplicate documents, paragraphs and vectors against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest

from assayer.llm import graph, minhash, paragraphs, sieve, vectors
from tests.llm.conftest import corpus

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(words):
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def linked(sets):
    u = Union()
    items = list(sets.items())
    for k, (i, a) in enumerate(items):
        u.find(i)
        for j, b in items[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                u.join(i, j)
    return u


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents(spark, seed):
    rows = corpus(seed)
    sets = {i: shingles(WORD.findall(lower(t))) for i, t in rows}
    u = linked(sets)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert found == {i: (len(s), u.find(i), u.find(i) == i) for i, s in sets.items()}


def test_document_odd_cases(spark, docs, no_docs, odd_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd_docs).collect()), key=str)
    assert found == sorted([(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 7, True)], key=str)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def paragraph_sets(rows):
    sets, count = {}, {}
    for d, t in rows:
        n, words, end = 0, [], 0
        found = list(WORD.finditer(t or ""))
        for k, m in enumerate(found):
            words.append(lower(m[0]))
            last = k + 1 == len(found)
            if last or "\n" in t[m.end() : found[k + 1].start()]:
                if len(words) >= paragraphs.LEAST_WORDS:
                    sets[d, n] = shingles(words)
                n, words = n + 1, []
        count[d] = n
    return sets, count


def test_paragraphs(spark, docs, rows):
    sets, count = paragraph_sets(rows)
    u = linked(sets)
    gone = defaultdict(int)
    for i in sets:
        gone[i[0]] += u.find(i) != i
    found = {r.doc_id: (r.n_paragraphs, r.n_removed_paragraphs) for r in paragraphs.digests(docs).collect()}
    # Banding finds a pair at the threshold with a probability of 0.999 only.
    wrong = [d for d, t in rows if WORD.search(t or "") and found[d] != (count[d], gone[d])]
    assert len(wrong) <= 1, wrong


def test_paragraph_odd_cases(spark, docs, no_docs, odd_docs):
    assert paragraphs.digests(no_docs).count() == 0
    out = paragraphs.stripped(odd_docs).collect()
    assert len(out) == 6 and all(r.n_removed_paragraphs == 0 for r in out if r.row.doc_id is None)
    bands, rows_ = paragraphs.tune_bands(0.75, 0.999)
    assert 1 - (1 - 0.75**rows_) ** bands >= 0.999
    for r in paragraphs.stripped(docs).collect():
        if not r.n_removed_words:  # in paragraphs and in passages
            assert r.kept == r.row.text and not r.n_removed_paragraphs


def embeddings(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, dim))
    x = np.where(rng.random((n, 1)) < 0.5, base[rng.integers(0, 4, n)] + 0.12 * rng.standard_normal((n, dim)), rng.standard_normal((n, dim))).astype(np.float32)
    x[5:40] = x[4]
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, rows[4][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (None, rows[4][1], 1)]
    return rows


def test_vectors(spark):
    rows = embeddings(0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    u, links = Union(), defaultdict(int)
    good = [(i, np.array(v, np.float64), y) for i, v, y in rows if i is not None and v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    for k, (i, a, y) in enumerate(good):
        for j, b, z in good[:k]:
            if y == z and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                u.join(i, j)
                links[i] += 1
                links[j] += 1
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert len(found) == len(rows)
    right = sum(found[i] == (links[i], u.find(i)) for i, _, _ in rows if i is not None)
    assert right >= 0.99 * (len(rows) - 1) and sum(n for n, _ in found.values()) <= sum(links.values())
    assert found[None] == (0, None) and found[500] == (0, 500) and found[504] == (0, 504) and found[506] == (1, 506)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {i: 0 for i in range(1, 61)} | {101: 100}
    assert {r.id: r.component for r in graph.components(df).collect()} == want
    monkeypatch.setattr(graph, "TASK_EDGES", 8)
    assert {r.id: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_sieve_lets_all_wanted_pass(spark):
    bits = sieve.of(spark.range(0, 5000, 5))
    df = spark.range(5000)
    through = {r.id for r in sieve.through(df, "id", bits).collect()}
    assert set(range(0, 5000, 5)) <= through and len(through) < 1100
    assert through.isdisjoint(r.id for r in sieve.through(df, "id", bits, wanted=False).collect())
