"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A slice of texts is cut before each run of spaces; no piece of a supported model reaches across such
a cut, so each distinct segment ("word") is encoded once. The symbols of all words stand in one flat
array. A round looks up the rank of every pair, takes each word's least rank, merges its leftmost
occurrences in all words at once, and closes the gaps, until no pair is left. Several occurrences
merge in one round only as far as the next-best pair stays the same one (see _round()).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat
from assayer.llm.lineage import small_batches

MARK = "▁"
NONE = np.int64(1 << 40)
#: Words whose ids a worker keeps between slices.
KNOWN = 400_000


class Pairs:
    """(left id, right id) -> rank and merged id, in an open-addressed numpy table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.rank, self.merged = np.append(rank, NONE), np.append(merged, -1)
        key = left.astype(np.int64) << 32 | right
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.at[slot[put]] = key[todo[put]], todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indices into rank and merged; the last one, where there is no such pair."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where(have == key, self.at[slot], len(self.rank) - 1)
        todo = np.flatnonzero((have != key) & (have != -1))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            have = self.keys[slot]
            hit = have == key[todo]
            out[todo[hit]] = self.at[slot[hit]]
            go = ~hit & (have != -1)
            todo, slot = todo[go], slot[go]
        return out


class Model:
    """The tables of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a space behind another character; words can't be cut before spaces")
        probe = "  éﬁ\t　 x "
        if sp.encode("x", out_type=str)[:1] != [MARK + "x"] and sp.encode("x", out_type=str)[:1] != [MARK] or sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model changes texts before it encodes them; only identity normalisation is supported")
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
        self.end = sp.eos_id()
        self.special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        self.char = np.full(0x110000, -1, np.int64)
        _, self.score_rank = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)
        pairs = []
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
            pairs += [(normal[p[:k]], normal[p[k:]], i) for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        self.char[32] = self.char[ord(MARK)]
        self.known, self.known_row = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.known_off, self.known_ids = np.zeros(2, np.int64), np.empty(0, np.int32)
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = Pairs(left, right, self.score_rank[merged], merged)
        surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if self.special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.surface, self.surface_size = np.frombuffer(b"".join(surface), np.uint8), np.array([len(x) for x in surface])
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        width = len(str(n - 1)) + 1
        digits = [f"{i} ".encode() for i in range(n)]
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(n, width)

    # ---- encoding -------------------------------------------------------------------------

    def _round(self, sym: np.ndarray, word: np.ndarray, pos: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, ...]:
        """One round over words that have a pair left. found[i]: the pair of symbols i and i + 1."""
        rank = self.pairs.rank[found]
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, heads)
        mine = np.repeat(least, np.diff(np.append(heads, len(word))))
        hit = (rank == mine) & (rank < NONE)
        # Overlapping occurrences: of a run, every other one from the left.
        at = np.flatnonzero(hit)
        run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        # Merged one by one, the leftmost goes first; if it makes a pair that comes before (or ties with) the next
        # occurrence, later ones have to wait for another round.
        new = self.pairs.merged[found[at]]
        again = np.zeros(len(at), bool)
        right = at + 2
        ok = right < len(sym)
        ok[ok] = word[right[ok]] == word[at[ok]]
        again[ok] = self.pairs.rank[self.pairs.find(new[ok], sym[right[ok]])] <= mine[at[ok]]
        left = at - 1
        ok = left >= 0
        ok[ok] = word[left[ok]] == word[at[ok]]
        before = sym[np.maximum(left, 0)].copy()
        joined = np.zeros(len(at), bool)
        joined[1:] = at[1:] == at[:-1] + 2
        before[joined] = new[np.flatnonzero(joined) - 1]
        again[ok] |= self.pairs.rank[self.pairs.find(before[ok], new[ok])] <= mine[at[ok]]
        if again.any():
            own = word[at]
            earlier = np.cumsum(again) - again
            start = np.concatenate([[True], own[1:] != own[:-1]])
            at_start = earlier[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
            go = earlier == at_start
            at, new = at[go], new[go]
        sym = sym.copy()
        sym[at] = new
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        changed = np.zeros(len(sym), bool)
        changed[at] = True
        changed[np.maximum(at - 1, 0)] = True
        sym, word, pos, found, changed = sym[stay], word[stay], pos[stay], found[stay], changed[stay]
        changed[:-1] |= changed[1:]
        return sym, word, pos, self._pairs(sym, word, found, np.flatnonzero(changed))

    def _pairs(self, sym: np.ndarray, word: np.ndarray, found: np.ndarray, where: np.ndarray) -> np.ndarray:
        none = len(self.pairs.rank) - 1
        found[where] = none
        where = where[where < len(sym) - 1]
        where = where[word[where] == word[where + 1]]
        both = where[(sym[where] >= 0) & (sym[where + 1] >= 0)]
        found[both] = self.pairs.find(sym[both], sym[both + 1])
        return found

    def words(self, data: bytes, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word and n + 1 offsets. data: the words' UTF-8; n_chars: code points in each."""
        code = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        sym, word, pos = self.char[code], np.repeat(np.arange(len(n_chars)), n_chars), np.arange(len(code))
        found = self._pairs(sym, word, np.zeros(len(sym), np.int64), np.arange(len(sym)))
        none = len(self.pairs.rank) - 1
        done = []
        while len(sym):
            live = np.zeros(len(n_chars), bool)
            live[word[found != none]] = True
            live = live[word]
            if not live.all():
                done.append((sym[~live], pos[~live]))
                sym, word, pos, found = sym[live], word[live], pos[live], found[live]
            if len(sym):
                sym, word, pos, found = self._round(sym, word, pos, found)
        pos = np.concatenate([p for _, p in done]) if done else np.empty(0, np.int64)
        order = np.argsort(pos)
        sym, pos = np.concatenate([s for s, _ in done])[order] if done else pos, pos[order]
        word = np.repeat(np.arange(len(n_chars)), n_chars)[pos]
        odd = np.flatnonzero(sym < 0)
        size = np.ones(len(sym), np.int64)
        raw = [chr(code[pos[i]]).encode() for i in odd]
        size[odd] = [len(b) for b in raw]
        out = np.repeat(sym, size)
        at = np.cumsum(size) - size
        for i, b in zip(odd, raw):
            out[at[i] : at[i] + len(b)] = self.bytes[list(b)]
        return out, np.concatenate([[0], np.cumsum(np.bincount(word, size, len(n_chars)).astype(np.int64))])

    def _known(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, sorted by hash, and n + 1 offsets. Words met first stay in a table of KNOWN words."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        new = self.known[at] != hashes
        row = self.known_row[at[~new]]
        size = self.known_off[row + 1] - self.known_off[row]
        old_ids = flat.ragged(self.known_ids, self.known_off[row], size)
        fresh = flat.ragged(data, starts[new], (stops - starts)[new])
        lead = (fresh & 0xC0) != 0x80
        head = np.cumsum((stops - starts)[new]) - (stops - starts)[new]
        ids, off = self.words(fresh.tobytes(), np.add.reduceat(lead, head, dtype=np.int64) if len(head) else head)
        short = np.flatnonzero(np.diff(off) <= 32)[: max(0, KNOWN - len(self.known))]
        if len(short):
            kept, n = np.diff(off)[short], len(self.known_off) - 1
            self.known_ids = np.concatenate([self.known_ids, flat.ragged(ids, off[short], kept).astype(np.int32)])
            self.known_off = np.concatenate([self.known_off, self.known_off[-1] + np.cumsum(kept)])
            both = np.concatenate([self.known, hashes[new][short]])
            order = np.argsort(both, kind="stable")
            self.known, self.known_row = both[order], np.concatenate([self.known_row, np.arange(n, n + len(short))])[order]
        sizes, base = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        sizes[~new], sizes[new] = size, np.diff(off)
        base[~new], base[new] = np.cumsum(size) - size, off[:-1] + len(old_ids)
        both = np.concatenate([old_ids.astype(np.int64), ids])
        return flat.ragged(both, base, sizes), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (null: empty) and n + 1 offsets, with the end id behind each if asked for."""
        buf, off = flat.bytes_of(texts)
        raw = buf.tobytes()
        mark = MARK.encode()
        if mark in raw:
            parts = [raw[a:b].replace(mark, b" ") for a, b in zip(off[:-1], off[1:])]
            off, raw = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), b"".join(parts)
            buf = np.frombuffer(raw, np.uint8)
        # A dummy space before each text that isn't empty.
        full = np.diff(off) > 0
        add = np.concatenate([[0], np.cumsum(full)])
        spaced = np.full(len(buf) + add[-1], 32, np.uint8)
        keep = np.ones(len(spaced), bool)
        new_off = off + add
        keep[new_off[:-1][full]] = False
        spaced[keep] = buf
        n = len(off) - 1
        if not len(spaced):
            ids, seg_doc, inverse, word_off = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        else:
            blank = spaced == 32
            head = blank.copy()
            head[1:] &= ~blank[:-1] | flat.edges_of(new_off, len(spaced))[1:-1]
            starts = np.flatnonzero(head)
            stops = np.append(starts[1:], len(spaced))
            hashes, first, inverse = np.unique(flat.span_hashes(spaced, starts, stops), return_index=True, return_inverse=True)
            ids, word_off = self._known(hashes, spaced, starts[first], stops[first])
            seg_doc = np.searchsorted(new_off, starts, "right") - 1
        if end:
            ids = np.append(ids, self.end)
            word_off = np.append(word_off, len(ids))
            inverse, doc = np.append(inverse, np.full(n, len(word_off) - 2)), np.append(seg_doc, np.arange(n))
            order = np.argsort(doc, kind="stable")
            inverse, seg_doc = inverse[order], doc[order]
        size = np.diff(word_off)[inverse]
        return flat.ragged(ids, word_off[:-1][inverse], size), np.concatenate([[0], np.cumsum(np.bincount(seg_doc, size, n).astype(np.int64))])

    # ---- decoding -------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of each id list, as the library's decode(): control ids are silent, one leading space goes."""
        size = self.surface_size[ids]
        data = flat.ragged(self.surface, self.surface_at[ids], size).tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[off].tolist()
        out = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            text = data[a + 1 : b] if data[a : a + 1] == b" " and b > a else data[a:b]
            own = ids[off[i] : off[i + 1]]
            if (self.special[own] & (own != self.end)).any() or not _valid(text):
                text = self.library.decode(own.tolist()).encode()
            out.append(text)
        return out

    def decimal(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Decimal ids joined by one space, of each list."""
        rows = self.digits[ids]
        full = rows != 0
        data = rows[full].tobytes()
        at = np.concatenate([[0], np.cumsum(full.sum(1))])[off].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encoded(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (array<int>, end id last; only if asked for), n_tokens,
    decoded (string), ids_sha256, decoded_sha256.

    path: the model's file, which every executor has at the same place. A null text is an empty one: the end
    id alone, decoded to the empty string. Repeated rows and null doc_ids are encoded like any other; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in flat.slices(batch):
                found, off = own.encode(part.column("text"))
                texts = own.decode(found, off)
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(off))}
                if ids:
                    columns |= {"ids": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(found.astype(np.int32))), "decoded": pa.array(texts, pa.binary()).cast(pa.string())}
                columns |= {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in own.decimal(found, off)], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, " + ("ids array<int>, decoded string, " if ids else "") + "ids_sha256 string, decoded_sha256 string")
