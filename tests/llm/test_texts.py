"""Operators on single texts and repeated bytes, against libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

from assayer.llm import flat, induced, lines, packing, pieces, quality, rules, suffixes, tokens

WORD = re.compile(r"[^\x20\x09-\x0d]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.model(MODEL)


# ---- packing

def test_best_fit_is_tightest():
    rng = random.Random(5)
    for _ in range(60):
        capacity, n = rng.choice([1, 3, 64, 1024]), rng.randint(0, 120)
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        masks = [1 << rng.choice([0, 0, 0, 1, 2, 3]) | (1 << rng.randint(6, 20) if rng.random() < 0.3 else 0) for _ in range(n)]
        bins = {}
        for (b, start), size, mask in zip(packing.pack(sizes, masks, capacity), sizes, masks):
            left, have = bins.get(b, (capacity, 0))
            fit = [r for r, m in bins.values() if r >= size and not m & mask]
            assert capacity - left == start and left >= size and not have & mask
            assert (left == min(fit)) if b in bins else not fit
            bins[b] = left - size, have | mask


def test_packed_documents(docs, rows, no_docs, odd_docs, model):
    out = packing.packed_documents(docs, MODEL, capacity=64, shard=50).collect()
    want = {i: model.library.encode(t, add_eos=True) if t else [] for i, t in rows}
    source, content = {r.doc_id: r.source for r in docs.collect()}, dict(rows)
    got, bins = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.n_tokens == len(r.ids) and (r.bin_id is None) == (r.n_tokens == 0)
        got[r.doc_id] += r.ids
        if r.n_tokens:
            bins.setdefault(r.bin_id, []).append(r)
    assert got == want
    for own in bins.values():
        own.sort(key=lambda r: r.bin_start)
        assert sum(r.n_tokens for r in own) <= 64 and all(a.bin_start + a.n_tokens == b.bin_start for a, b in zip(own, own[1:]))
        named = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert len(named) == len(set(named)) and len({content[r.doc_id] for r in own}) == len(own)
        assert len(own) == 1 or own[0].bin_id >= 0
    again = packing.packed_documents(docs.repartition(5), MODEL, capacity=64, shard=50)
    assert {(r.doc_id, r.piece, r.bin_id, r.bin_start) for r in again.collect()} == {(r.doc_id, r.piece, r.bin_id, r.bin_start) for r in out}
    assert packing.packed_documents(no_docs, MODEL).count() == 0
    assert packing.packed_documents(odd_docs, MODEL).select("doc_id", "piece").count() == 6


def test_bins_are_full(spark):
    rng = random.Random(9)
    texts = [(k, "word " * rng.randint(1, 300), f"s{k % 97}") for k in range(3000)]
    out = packing.packed_documents(spark.createDataFrame(texts, "doc_id long, text string, source string"), MODEL, capacity=512, shard=1000)
    n, bins = out.selectExpr("sum(n_tokens)", "count(distinct bin_id)").first()
    assert n >= 0.97 * 512 * bins


# ---- quality

def test_classifier_on_held_out_rows():
    rng = np.random.default_rng(1)
    def make(y):
        words = [f"w{i}" for i in rng.integers(0, 500, 60)]
        if y == 0:
            words = [w + "***" for w in words]
        if y == 1:
            words[int(rng.integers(0, 60))] = "nasty"
        return " ".join(words)
    y = rng.integers(0, 3, 900)
    b, v, off = quality.features(*flat.bytes_of(pa.array([make(k) for k in y])))
    found = [(b[i:j], v[i:j]) for i, j in zip(off[:-1], off[1:])]
    model = quality.fit(found[:600], y[:600])
    assert model.thresholds[0] <= model.thresholds[1]
    score = np.array([(model.weights[b] * v).sum() for b, v in found[600:]])
    expected, tail = model.grades(score)
    assert ((tail >= 0.5) == (y[600:] == 2)).mean() > 0.95
    assert [expected[y[600:] == k].mean() for k in range(3)] == sorted(expected[y[600:] == k].mean() for k in range(3))


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(4)
    cuts, score, y = np.array([-0.7, 0.9]), rng.standard_normal(30) * 2, rng.integers(0, 3, 30)

    def loss(cuts, score):  # -log of differences of logistic functions, as the model is defined
        at_most = lambda k: 0.0 if k < 0 else 1.0 if k == 2 else 1 / (1 + np.exp(score_i - cuts[k]))
        total = 0.0
        for score_i, g in zip(score, y):
            total -= np.log(at_most(g) - at_most(g - 1))
        return total

    d_score, d_cuts = quality.slopes(cuts, score, y)
    step = 1e-6
    for k in range(30):
        e = np.eye(30)[k] * step
        assert abs((loss(cuts, score + e) - loss(cuts, score - e)) / (2 * step) - d_score[k]) < 1e-6
    for k in range(2):
        e = np.eye(2)[k] * step
        assert abs((loss(cuts + e, score) - loss(cuts - e, score)) / (2 * step) - d_cuts[k]) < 1e-5


def test_scores_do_not_depend_on_the_partitions(docs, spark):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) as quality", "cast(doc_id % 5 = 0 as int) as toxic")
    one, two = (sorted(tuple(r) for r in quality.classify(d, labels).collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_classifier_odd_cases(spark, docs, no_docs, odd_docs):
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id % 2), 0) for r in docs.collect()] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.tail_prob <= 1 and r.kept == (r.tail_prob >= quality.MIN_TAIL) for r in out)
    assert quality.selected(docs, labels).columns == docs.columns
    assert quality.classify(odd_docs, labels).count() == 6
    assert quality.classify(no_docs, labels).count() == 0
    assert {(r.tail_prob, r.kept) for r in quality.classify(docs, labels.limit(0)).collect()} == {(None, True)}
    assert {r.grade for r in quality.graded(spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, None)], labels.schema)).collect()} == {0, 1, 2}


# ---- rules

def brute_rules(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def brute_kept(t, limits):
    """The bands by the text of their rule."""
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    data, found = (t or "").encode(), [None]
    for least, greatest, start, stop in [(*b, a, z) for b, a, z in zip(limits.bands, rules.FROM, (*rules.FROM[1:], 1 << 60))]:
        if start <= len(data) < stop:
            ratio = len(data) / size(data)
            found = ["incompressible" if ratio < least else "repetitive" if ratio > greatest else None]
    full = [data[k : k + 4096] for k in range(0, len(data), 4096)] if len(data) >= 4096 else []
    if full and len(full[-1]) < 4096:
        full[-1] = data[-4096:]
    out = sum(not limits.chunk[0] <= 4096 / size(c) <= limits.chunk[1] for c in full)
    return found[0], len(full), out, found[0] is None and 4 * out <= len(full)


def test_rules(docs, rows, no_docs, odd_docs, spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(0x21, 0x2FF)) for _ in range(9)) for _ in range(900))
    rows = rows + [(10**6, long), (10**6 + 1, long[:9000] + noise[:9000]), (10**6 + 2, noise), (10**6 + 3, "ab cd ef gh ij kl mn\n" * 900)]
    content = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = df.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) as quality", "0 as toxic")
    sides = set()
    for limits in (rules.Limits(), rules.fitted(df, labels), rules.Limits(((1.5, 2.0),) * 9, (1.9, 2.5))):
        for r in rules.quality_rules(df, limits).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == brute_rules(content[r.doc_id])
            assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
            side, many, bad, fine = brute_kept(content[r.doc_id], limits)
            assert (r.side, r.n_chunks, r.n_bad_chunks, r.kept) == (side, many, bad, fine and not r.base_failed)
            sides.add((r.side, r.base_failed))
    assert {("incompressible", False), ("repetitive", False), (None, False)} <= sides
    assert rules.quality_rules(no_docs).count() == 0 and rules.quality_rules(odd_docs).count() == 6
    assert rules.fitted(no_docs, labels) == rules.fitted(docs, labels.limit(0)) == rules.Limits()


def test_rules_on_random_characters():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\té|") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    c = rules.counts(*flat.bytes_of(pa.array(texts)))
    assert list(zip(*(x.tolist() for x in c.values()))) == [brute_rules(t) for t in texts]
    own = rules.Limits()
    assert own.side(100, 99.0) is None and own.side(5000, 20.0) == "repetitive" and own.side(5000, 1.0) == "incompressible"


# ---- pieces

def check_pieces(model, texts):
    ids, off = model.encode(pa.array(texts, pa.string()))
    decoded, decimal = model.decode(ids, off), model.decimal(ids, off)
    for k, t in enumerate(texts):
        want = model.library.encode(t or "", add_eos=True)
        assert ids[off[k] : off[k + 1]].tolist() == want, t
        assert decoded[k].decode() == model.library.decode(want) and decimal[k].decode() == " ".join(map(str, want))


def test_pieces_like_the_library(model, rows):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "▁", "é", "€", "the", "ing", "\n", "😀", "aaaa", "=", "-", "0", "▁▁", "\x00", "漢", "<s>", "</s>"]
    texts = ["", None, " ", "a" * 3000, " " * 2000, "ab" * 1500, "-" * 777, "<0x41>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x4E00, 0x4EFF), rng.randint(0x1F600, 0x1F640)])) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    check_pieces(model, texts)
    check_pieces(model, [t for _, t in rows])
    assert model.decode(np.array([1, 5, 0, 300]), np.array([0, 4]))[0].decode() == model.library.decode([1, 5, 0, 300])


def test_pieces_on_frames(docs, no_docs, odd_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for r in pieces.encoded(docs, path).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == sha(" ".join(map(str, r.ids)).encode()) and r.decoded_sha256 == sha(r.decoded.encode())
    assert pieces.encoded(no_docs, path).count() == 0 and pieces.encoded(odd_docs, path).count() == 6


# ---- tokens

def test_token_attribution(docs, rows, no_docs, odd_docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own, size = tokens.encoding(path, pattern)
    content = dict(rows)
    for r in tokens.token_counts(docs, path, pattern, per_section=True).collect():
        text = (content[r.doc_id] or "").encode()
        starts, at, home, crossing = [0], 0, [], 0
        for i, c in enumerate(text):
            if c == 10 and i + 1 < len(text):
                starts.append(i + 1)
        for t in own.encode_ordinary(content[r.doc_id] or ""):
            a = sum(s <= at for s in starts) - 1
            b = sum(s <= at + size[t] - 1 for s in starts) - 1
            home.append(a)
            crossing += a != b
            at += size[t]
        assert r.n_tokens == len(home) and r.n_crossing == crossing
        assert r.section_tokens == ([home.count(k) for k in range(len(starts))] if text else [])
        assert r.n_prose + r.n_table + r.n_blank == r.n_tokens
    assert tokens.token_counts(no_docs, path, pattern).count() == 0 and tokens.token_counts(odd_docs, path, pattern).count() == 6


def test_long_texts_cut_where_the_pattern_does(monkeypatch, rows):
    own, _ = tokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = " ".join(t for _, t in rows if t)
    monkeypatch.setattr(tokens, "PIECE", 500)
    assert tokens.ids_of(text, own).tolist() == own.encode_ordinary(text)


# ---- lines

def test_lines(docs, rows, no_docs, odd_docs):
    seen, want = set(), {}
    for d, t in sorted(rows):
        buf, off = flat.bytes_of(pa.array([t or ""]))
        a, b, _, use = lines.chunks(buf, off)
        own = [buf[x:y].tobytes() for x, y in zip(a, b)]
        assert b"\n".join(own) == (t or "").encode()
        keep = []
        for p, u in zip(own, use):
            if u and p in seen:
                continue
            if u:
                seen.add(p)
            keep.append(p)
        want[d] = len(own), len(own) - len(keep), sha(b"\n".join(keep))
    assert {r.doc_id: (r.n_chunks, r.n_removed_chunks, r.kept_sha256) for r in lines.digests(docs).collect()} == want
    assert lines.digests(no_docs).count() == 0
    odd = lines.stripped(odd_docs).collect()
    assert len(odd) == 6 and all(r.n_removed_chunks == 0 for r in odd if r.row.doc_id is None)
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == sum(not (n and k == sha(b"")) for _, n, k in want.values())


def test_chunks_move_with_the_content():
    rng = random.Random(4)
    body = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(5)) for _ in range(200)]
    def parts(ls):
        buf, off = flat.bytes_of(pa.array(["\n".join(ls)]))
        a, b, _, _ = lines.chunks(buf, off)
        return {buf[x:y].tobytes() for x, y in zip(a, b)}
    one, two = parts(body), parts(["new first line", *body])
    assert len(one - two) <= 2


# ---- suffixes

def brute_suffixes(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone, [0]]).astype(int))
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    return out


@pytest.mark.parametrize("length, contexts", [(400, 1024), (60, 1024), (60, 1), (400, 1)])
def test_repeated_bytes(docs, rows, monkeypatch, length, contexts):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", contexts)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1 << 14)
    want = dict(zip([d for d, _ in rows], brute_suffixes([(t or "").encode() for _, t in rows], length)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs, length).collect()} == want


def test_repeated_bytes_odd_cases(docs, no_docs, odd_docs):
    assert suffixes.digests(no_docs).count() == 0
    found = sorted((r.n_bytes, r.n_removed) for r in suffixes.digests(odd_docs).collect())
    assert found[:3] == [(0, 0), (0, 0), (29, 0)] and all(n == k > 400 for n, k in found[3:])
    assert suffixes.deduplicated(docs).columns == docs.columns


def test_suffix_arrays(monkeypatch):
    rng = random.Random(2)
    for buckets in (1024, 1):
        monkeypatch.setattr(induced, "BUCKETS", buckets)
        for _ in range(500):
            n, s = rng.randint(0, 60), rng.choice([1, 2, 3, 200])
            t = [rng.randint(1, s) for _ in range(n)] * rng.choice([1, 1, 3]) + [0]
            sa = induced.suffix_array(np.array(t), s + 1)
            assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            most = rng.choice([3, 1000])
            common = induced.permuted_prefixes(np.array(t), sa, most)
            for a, b in zip(sa, sa[1:]):
                k = 0
                while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                    k += 1
                assert (common[b] >= most) == (k >= most) and (most < 1000 or common[b] == k)
