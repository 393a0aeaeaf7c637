"""Texts longer than a slice, in every operator and every stage of the pipeline, next to nulls and clashing names."""

import random

import pytest

import corpus_pipeline
from assayer.llm import flat, lines, packing, paragraphs, quality, rules, suffixes
from tests.llm.test_texts import MODEL, brute_rules

SIZE = flat.SLICE + 70_000


def long_text(seed):
    rng = random.Random(seed)
    out, n = [], 0
    while n < SIZE:
        out.append(" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 99999)}" for _ in range(rng.randint(30, 60))))
        n += len(out[-1]) + 1
    return "\n".join(out)


@pytest.fixture(scope="module")
def texts():
    one, other = long_text(1), long_text(2)
    middle = one.split("\n")[20:200]
    return {1: one, 2: other + "\n" + "\n".join(middle), 3: "short text of a few plain words in one line and some more", 4: None, 5: ""}


@pytest.fixture(scope="module")
def frame(spark, texts):
    rows = [(i, t, "src", 1, 2, [3], "k") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, k_id int, h int, runs array<int>, part string").repartition(2)


def test_lines(frame, texts):
    out = {r.row.doc_id: r for r in lines.stripped(frame).collect()}
    assert out[1].kept == texts[1] and out[1].n_removed_chunks == 0
    left = out[2].kept.split("\n")
    # All but the lines at the passage's two ends, whose chunks may reach out of it.
    assert len(texts[2].split("\n")) - len(left) >= 170 and left[: 50] == texts[2].split("\n")[:50]
    assert out[4].kept is None and out[5].kept == ""


def test_paragraphs(frame, texts):
    out = {r.row.doc_id: r for r in paragraphs.stripped(frame).collect()}
    assert out[1].kept == texts[1] and out[1].n_removed_paragraphs == 0
    assert out[2].n_removed_paragraphs == 180 and out[2].kept.split() == long_text(2).split()


def test_paragraph_ids_of_any_size(spark):
    """Large and negative ids lose what small ones lose."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    found = []
    for base in (0, 1 << 40, 1 << 62, -(1 << 62)):
        rows = [(base + 1, words(1) + "\n" + words(2)), (base + 2, words(2) + "\n" + words(3)), (base + 3, words(4))]
        out = paragraphs.stripped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        found.append({r.row.doc_id - base: r.n_removed_paragraphs for r in out})
    assert found == [{1: 0, 2: 1, 3: 0}] * 4


def test_bytes(frame, texts):
    out = {r.doc_id: r for r in suffixes.digests(frame).collect()}
    size = len("\n".join(texts[1].split("\n")[20:200]))
    assert size <= out[1].n_removed <= size + 2 and size <= out[2].n_removed <= size + 2
    assert out[1].n_spans == out[2].n_spans == 1 and out[4].n_bytes == out[5].n_bytes == 0


def test_rules(frame, texts):
    for r in rules.quality_rules(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(texts[r.doc_id])
        assert r.n_chunks == (-(-len(texts[r.doc_id]) // rules.CHUNK) if r.doc_id < 3 else 0)


def test_packing(frame, texts):
    out = packing.packed_documents(frame, MODEL).select("doc_id", "start", "n_tokens", "bin_id").collect()
    for i in (1, 2):
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert len(own) > 100 and all(a.start + a.n_tokens == b.start for a, b in zip(own, own[1:]))
        assert all(r.n_tokens == packing.CAPACITY for r in own[:-1]) and len({r.bin_id for r in own}) == len(own)
    assert [r.bin_id for r in out if r.doc_id in (4, 5)] == [None, None]


def test_classifier(frame):
    labels = frame.selectExpr("doc_id", "cast(doc_id < 3 as int) as quality", "0 as toxic")
    assert quality.classify(frame, labels).count() == 5 and quality.selected(frame, labels).columns == frame.columns


def test_stages(spark, frame, texts, tmp_path):
    """What each stage leaves of long texts, by the rule of the stage."""
    frame.selectExpr("doc_id", "1 as quality", "0 as toxic").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    now = frame
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.dtypes == frame.dtypes
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left = {r.doc_id: r.text for r in now.collect()}
        assert set(left) == {1, 2, 3, 4, 5} and left[3] == texts[3] and left[4] is None and left[5] == "", name
        assert left[1] == texts[1] if k < 3 else len(left[1]) <= len(texts[1])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(texts)
