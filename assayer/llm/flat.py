"""Whole batches of texts as one flat byte array: words, hashes and shingles in numpy.

A batch is cut into slices of at most ``SLICE`` bytes (one longer text makes a slice of its
own), so memory is bounded by the slice and the longest text, not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
WIDTH = 5  # words in a shingle

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: The C library's call, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_ODD))
_PLACE = mix(np.arange(1, 65, dtype=U) * U(_BASE)) | U(1)


def _power(kind: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of the inverse; kept between calls up to 4 SLICE."""
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, _BASE if kind == "up" else _BASE_INVERSE, U)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * SLICE:
            _powers[kind] = have
    return have[:n]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``size`` bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(lengths) > at:
        yield batch.slice(at)
    give_back()


def give_back() -> None:
    """What the allocators keep after a batch goes back to the system: workers live on, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def edges_of(off: np.ndarray, size: int) -> np.ndarray:
    mark = np.zeros(size + 1, bool)
    mark[off] = True
    return mark


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words, and how many words precede each text (n + 1 counts)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    full, edge = ~_SPACE[buf], edges_of(off, len(buf))
    first = full.copy()
    first[1:] &= ~full[:-1] | edge[1:-1]
    last = full.copy()
    last[:-1] &= ~full[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one prefix sum over the buffer."""
    if not len(starts):
        return np.empty(0, U)
    total = np.empty(len(buf) + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[buf] * _power("up", len(buf)), out=total[1:])
    out = (total[ends] - total[starts]) * _power("down", len(buf) + 1)[starts]
    return mix(out + (ends - starts).astype(U) * U(_ODD))


def shingles(buf: np.ndarray, off: np.ndarray, width: int = WIDTH, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's word windows (repeats included), n + 1 offsets into them, and word counts.

    A text of fewer words than ``width`` has one shingle, its whole word sequence; one without words none.
    """
    if lower:
        buf = _LOWER[buf]
    starts, ends, at = words(buf, off)
    h, n_words = span_hashes(buf, starts, ends), np.diff(at)
    full = len(h) - width + 1
    n = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(to[-1]), U)
    if full > 0:
        every = np.zeros(full, U)
        for k in range(width):
            every += h[k : k + full] * _PLACE[k]
        doc = np.repeat(np.arange(len(n)), np.where(n_words >= width, n, 0))
        where = np.arange(len(doc)) - np.repeat(np.cumsum(np.where(n_words >= width, n, 0)) - np.where(n_words >= width, n, 0), np.where(n_words >= width, n, 0))
        out[to[doc] + where] = mix(every[at[doc] + where] + U(width))
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        w = h[at[i] : at[i + 1]]
        out[to[i]] = mix((w * _PLACE[: len(w)]).sum(keepdims=True, dtype=U) + U(len(w)))[0]
    return out, to, n_words


def sets(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, to, _ = shingles(buf, off, width)
    return [np.unique(h[a:b]) for a, b in zip(to[:-1], to[1:])]


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive hashes (by their upper 40 bits, the first of equal ones)."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    low = U((1 << 24) - 1)
    place = np.arange(len(h), dtype=U)
    least, reach = h & ~low | place & low, 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    least = np.minimum(least[:n], least[width - reach : width - reach + n])
    return (place[:n] + ((least & low) - place[:n] & low)).astype(np.int64)


def jaccard_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for two sorted distinct arrays; two empty sets never do."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """table[s : s + n] for each s, n, one after the other."""
    total = int(lengths.sum())
    if not total:
        return table[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    shift += np.arange(total)
    return table[shift]
