"""Quality rules: compression bands.

Repetitive text compresses too well and random text hardly at all. zstandard ratios (bytes to
compressed bytes) of the whole text and of its fixed chunks are held against limits that depend on
the length compressed, as short inputs compress less. The limits are exact quantiles of the ratios of all documents that
are rated good. Counting rules come before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat, sieve
from assayer.llm.lineage import cut, small_batches
from assayer.llm.quality import graded

LEVEL = 3
CHUNK = 4096
#: Chunks outside their band that reject a text, as a share of its chunks.
BAD_CHUNKS = 0.25
#: Least lengths of the bands, in bytes; shorter texts have none.
FROM = (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536)
#: (least, greatest) ratio of each band, and of chunks, where there are no ratings to fit them on.
WIDE = ((0.8, 2.4), (1.0, 2.6), (1.15, 2.8), (1.25, 3.0), (1.35, 3.2), (1.4, 3.4), (1.45, 3.7), (1.5, 4.0), (1.5, 5.0))
WIDE_CHUNK = (1.4, 3.4)
#: Slots of a ratio of 1 that ratios are counted in, to find where their quantiles lie.
SLOTS = 1024
#: A band is fitted on so many documents at least; of those so much is left out on each side, and so much is added to the rest.
LEAST_FIT, TAIL, MARGIN = 20, 0.001, 0.02
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, "
    "side string, n_chunks long, n_bad_chunks long, kept boolean"
)


@dataclass
class Limits:
    """(least, greatest) ratio of each band of FROM, and of a chunk."""

    bands: tuple[tuple[float, float], ...] = WIDE
    chunk: tuple[float, float] = WIDE_CHUNK

    def side(self, size: int, ratio: float | None) -> str | None:
        """Why a text of this many bytes is out of its band; null where it isn't."""
        k = int(np.searchsorted(FROM, size, "right")) - 1
        if ratio is None or k < 0:
            return None
        return "incompressible" if ratio < self.bands[k][0] else "repetitive" if ratio > self.bands[k][1] else None


def _distinct_lines(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text, lines with a word that equal an earlier line of it."""
    out = np.zeros(len(off) - 1, np.int64)
    if not len(buf):
        return out
    breaks = np.flatnonzero(buf == 10)
    heads = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    heads = heads[heads < len(buf)]
    tails = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, heads)], off[np.searchsorted(off, heads, "right")])
    filled = np.concatenate([[0], np.cumsum(~flat._SPACE[buf])])
    use = filled[tails] > filled[heads]
    heads, tails = heads[use], tails[use]
    doc = np.searchsorted(off, heads, "right") - 1
    key = flat.span_hashes(buf, heads, tails) ^ flat.mix(doc.astype(flat.U) + flat.U(1))
    _, first = np.unique(key, return_index=True)
    twice = np.ones(len(key), bool)
    twice[first] = False
    return np.bincount(doc[twice], minlength=len(out))


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counting rules' columns for each text."""
    n = len(off) - 1
    starts, ends, at = flat.words(buf, off)
    n_words = np.diff(at)
    place = np.concatenate([[0], np.cumsum(~flat._SPACE[buf] & ((buf & 0xC0) != 0x80))])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    h, to, _ = flat.shingles(buf, off, 5, lower=False)
    long = n_words >= 5
    doc = np.repeat(np.arange(n), np.diff(to))
    real = long[doc]
    key = h[real] ^ flat.mix(doc[real].astype(flat.U) + flat.U(1))
    _, inverse, found = np.unique(key, return_inverse=True, return_counts=True)
    again = (found[inverse] > 1).astype(np.int64)
    head = (at[doc] + np.arange(len(doc)) - to[doc])[real]
    cover = np.zeros(len(starts) + 6, np.int64)
    np.add.at(cover, head, again)
    np.add.at(cover, head + 5, -again)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(starts)] > 0)])
    return {"n_words": n_words, "word_chars": place[off[1:]] - place[off[:-1]], "n_symbols": symbol[off[1:]] - symbol[off[:-1]], "n_dup_lines": _distinct_lines(buf, off), "n_repeat_words": covered[at[1:]] - covered[at[:-1]]}


def ratios(text: memoryview, press) -> tuple[float | None, list[float]]:
    """Ratio of the whole text, and of its chunks: CHUNK bytes each, the last ones of the text for a rest. A shorter text has no chunks."""
    if not len(text):
        return None, []
    cuts = [text[i : i + CHUNK] for i in range(0, len(text) - CHUNK + 1, CHUNK)]
    if cuts and len(text) % CHUNK:
        cuts.append(text[-CHUNK:])
    return len(text) / len(press(text)), [CHUNK / len(press(c)) for c in cuts]


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Slices with their counts, text lengths and ratios."""
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        for part in flat.slices(batch):
            buf, off = flat.bytes_of(part.column("text"))
            data, cuts = memoryview(buf), off.tolist()
            yield part, counts(buf, off), np.diff(off), [ratios(data[a:b], press) for a, b in zip(cuts[:-1], cuts[1:])]


def _rules(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = limits.chunk
        for part, base, size, seen in _judged(batches):
            failed = base_failed(base)
            side = [limits.side(n, whole) for n, (whole, _) in zip(size.tolist(), seen)]
            bad = np.array([sum(not low <= r <= high for r in own) for _, own in seen], np.int64)
            many = np.array([len(own) for _, own in seen], np.int64)
            kept = ~failed & np.array([x is None for x in side], bool) & (bad <= BAD_CHUNKS * many)
            columns = [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(failed)]
            columns += [pa.array([whole for whole, _ in seen], pa.float64()), pa.array(side, pa.string()), *map(pa.array, (many, bad, kept))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length, ratio, and the chunks' least and greatest ratio of the texts that the counting rules pass."""
    for part, base, size, seen in _judged(batches):
        keep = np.flatnonzero(~base_failed(base)).tolist()
        rows = [(int(size[i]), seen[i][0], min(seen[i][1], default=None), max(seen[i][1], default=None)) for i in keep]
        if rows:
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), *[pa.float64()] * 3))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep)), *columns], names=["doc_id", "size", "ratio", "low", "high"])


def _quantiles(values: DataFrame, shares: tuple[float, ...]) -> dict[int, tuple[int, list[float]]]:
    """Of each kind of ``values`` (kind int, x double, not null): how many, and their exact quantiles, linear between neighbours.

    Counts by slot tell in which slots the wanted ranks lie; only what is in those is counted by value."""
    key = F.col("kind") * F.lit(1 << 40) + F.floor(F.col("x") * SLOTS)
    slots: dict[int, list[tuple[int, int]]] = {}
    for k, n in values.groupBy(key.alias("key")).count().orderBy("key").collect():
        slots.setdefault(k >> 40, []).append((k, n))
    places, wanted = {}, set()
    for kind, own in slots.items():
        ends = np.cumsum([n for _, n in own])
        at = [share * (int(ends[-1]) - 1) for share in shares]
        ranks = [(int(x), min(int(x) + 1, int(ends[-1]) - 1), x - int(x)) for x in at]
        slot = {r: int(np.searchsorted(ends, r, "right")) for low, high, _ in ranks for r in (low, high)}
        places[kind] = int(ends[-1]), ranks, {r: (own[k][0], r - int(ends[k] - own[k][1])) for r, k in slot.items()}
        wanted |= {own[k][0] for k in slot.values()}
    found: dict[int, list[tuple[float, int]]] = {}
    if wanted:
        for k, x, n in values.where(key.isin(sorted(wanted))).groupBy(key.alias("key"), "x").count().orderBy("key", "x").collect():
            found.setdefault(k, []).append((x, n))
    out = {}
    for kind, (n, ranks, place) in places.items():
        value = {r: found[k][int(np.searchsorted(np.cumsum([m for _, m in found[k]]), left, "right"))][0] for r, (k, left) in place.items()}
        out[kind] = n, [value[low] + (value[high] - value[low]) * part for low, high, part in ranks]
    return out


def fitted(docs: DataFrame, labels: DataFrame) -> Limits:
    """Limits from all documents that labels (doc_id, quality, toxic) rate good; bands with too few of them stay WIDE.

    Texts are measured where they are read: only sizes and ratios are joined with the ratings."""
    small_batches(docs.sparkSession)
    good = cut(graded(labels).where("grade > 0").select("doc_id"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = sieve.through(docs, "doc_id", sieve.of(good)).mapInArrow(_measured, "doc_id long, size long, ratio double, low double, high double")
    found = cut(found.join(good, "doc_id", "left_semi"))
    band = sum((F.col("size") >= least).cast("int") for least in FROM) - 1
    pairs = [F.struct(kind.alias("kind"), F.col(c).alias("x")) for kind, c in ((band, "ratio"), (F.lit(len(FROM)), "low"), (F.lit(len(FROM) + 1), "high"))]
    values = found.select(F.inline(F.array(*pairs))).where("kind >= 0 and x is not null")
    own = _quantiles(values, (TAIL, 1 - TAIL))

    def limits(low: int, high: int, wide: tuple[float, float]) -> tuple[float, float]:
        if own.get(low, (0,))[0] < LEAST_FIT:
            return wide
        return float(own[low][1][0] * (1 - MARGIN)), float(own[high][1][1] * (1 + MARGIN))

    return Limits(tuple(limits(k, k, wide) for k, wide in enumerate(WIDE)), limits(len(FROM), len(FROM) + 1, WIDE_CHUNK))


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the counts, base_failed, ratio, side ("repetitive" or "incompressible" for a
    whole text out of its band), n_chunks, n_bad_chunks, kept.

    A null text is an empty one: no words, so base_failed. Texts under 128 bytes have no band, those under CHUNK no
    chunks; repeated rows, null doc_ids and texts of any length are judged like any other row. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_rules(limits or Limits()), f"doc_id long, {SCHEMA}")
