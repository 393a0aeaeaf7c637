"""Suffix-array dedup: bytes inside a 400-byte string that also starts elsewhere.

Each 400-byte window has a minimizer, its least-hashed ``GRAM``-byte substring; equal windows have
equal ones, so windows are compared only within a minimizer's value. Consecutive windows with one
minimizer make a context, their text. Equal contexts are collapsed, which settles copies. The
distinct contexts of a value go to one shard, whose suffix array is built by induced sorting
(``assayer.llm.induced``); windows whose permuted common prefix with a neighbour in it reaches 400
are repeated. Values with more distinct contexts than a shard should hold (a passage in very many
documents, each with other surroundings) are settled exactly by halving: digests of what ever
smaller blocks of their windows have in common, down to single windows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat, induced, sieve
from assayer.llm.lineage import cut, release

LENGTH = 400
GRAM = 64
#: Distinct contexts of a minimizer's value that one shard takes, and bytes of contexts in a shard.
MOST_CONTEXTS = 1024
SHARD_BYTES = 1 << 20
#: Bytes of a shard's contexts that are sorted together, but for the contexts of one value, which stay together. Sorting takes 120 bytes a byte.
SORT_BYTES = 1 << 18
#: Windows in a block, by step, for values above MOST_CONTEXTS.
BLOCKS = (43, 6, 1)
#: Bytes of one text looked at together; longer ones in pieces that overlap by a window.
PIECE = 4 << 20

_FOUND = "slice long, value long, context long, spots array<struct<k_id: long, k_text: long, at: long>>"


def _minimizers(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: first window, number of windows, the minimizer's place and value."""
    gram = min(GRAM, length)
    width = length - gram + 1
    n = len(data) - gram + 1
    total = np.empty(len(data) + 1, flat.U)
    total[0] = 0
    np.cumsum(flat._BYTE[data] * flat._power("up", len(data)), out=total[1:])
    h = flat.mix((total[gram:] - total[:-gram]) * flat._power("down", n))
    key = (h >> flat.U(24) << flat.U(24)) | np.arange(n, dtype=flat.U)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, flat.U)
    padded[:n] = key
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, 1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & flat.U(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first, np.diff(np.append(first, len(place))), place[first], h[place[first]]


def windows(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """_minimizers() of a text of any length, and a hash of each context's bytes."""
    out = []
    for a in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[a : a + PIECE + length - 1]
        first, count, place, value = _minimizers(piece, length)
        out.append((first + a, count, place + a, value, flat.span_hashes(piece, first, first + count + length - 1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(first: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    return first << 20 | (place - first) << 10 | count


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 20, at & 1023, (at >> 20) + (at >> 10 & 1023)


def _find(length: int):
    """The distinct contexts of each slice of texts, with all their spots in it: a passage that very many texts hold
    leaves a task as few rows. Slices are numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in flat.slices(batch):
                number += 1
                buf, off = flat.bytes_of(part.column("text"))
                own = [(i, *windows(buf[a:b], length)) for i, (a, b) in enumerate(zip(off[:-1], off[1:])) if b - a >= length]
                if not own:
                    continue
                row = np.repeat([x[0] for x in own], [len(x[1]) for x in own])
                first, count, place, value, context = (np.concatenate(x) for x in list(zip(*own))[1:])
                order = np.lexsort((row, context, value))
                value, context = value[order], context[order]
                head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (context[1:] != context[:-1])]))
                pick, at = pa.array(row[order]), _pack(first, count, place)[order]
                spot = [part.column("k_id").take(pick), part.column("k_text").take(pick), pa.array(at)]
                spots = pa.StructArray.from_arrays(spot, ["k_id", "k_text", "at"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(value)).astype(np.int32)), spots)
                columns = [pa.array(np.full(len(head), number)), pa.array(flat.signed(value[head])), pa.array(flat.signed(context[head])), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "value", "context", "spots"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each slice's spots, neighbouring contexts of a text as one range of starts."""
    for batch in batches:
        spots = batch.column("spots").flatten().flatten()
        k_id, k_text, at = (spots.field(c).to_numpy(zero_copy_only=False) for c in ("k_id", "k_text", "at"))
        a, count, _ = _unpack(at)
        order = np.lexsort((a, k_text, k_id))
        k_id, k_text, a, b = k_id[order], k_text[order], a[order], (a + count)[order]
        # A text's contexts don't overlap, but for those of repeated rows, which are equal.
        fresh = np.concatenate([[True], (k_id[1:] != k_id[:-1]) | (k_text[1:] != k_text[:-1]) | (a[1:] > b[:-1])])
        head = np.flatnonzero(fresh[: len(a)])
        last = np.append(head[1:], len(a))[: len(head)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k_id[head], k_text[head], a[head], b[last])], names=["k_id", "k_text", "a", "b"])


def _texts(length: int):
    """The bytes of the contexts in each row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch):
                buf, off = flat.bytes_of(part.column("text"))
                lists = part.column("contexts")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                items = lists.flatten()
                first, count, _ = _unpack(items.field("at").to_numpy(zero_copy_only=False))
                a = off[row] + first
                pick = pa.array(row)
                own = pa.array([buf[x : x + n + length - 1].tobytes() for x, n in zip(a.tolist(), count.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("k_id").take(pick), part.column("k_text").take(pick), *(items.field(c) for c in ("at", "value", "many")), own], names=["k_id", "k_text", "at", "value", "many", "own"])

    return run


def repeated(contexts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each context, which of its windows start twice or more in all of them together."""
    size = np.array([len(c) + 1 for c in contexts])
    start = np.cumsum(size) - size
    t = np.ones(int(size.sum()) + 1, np.uint16)  # 1 ends a context, 0 the string
    t[-1] = 0
    for c, a in zip(contexts, start.tolist()):
        t[a : a + len(c)] = c
        t[a : a + len(c)] += 2
    sa = induced.suffix_array(t, 258)
    common = induced.permuted_prefixes(t, sa, length)
    twice = common >= length
    after = np.zeros(len(t), bool)
    after[sa[:-1]] = twice[sa[1:]]
    twice |= after
    return [twice[a : a + n - length] for a, n in zip(start.tolist(), size.tolist())]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sorted_parts(value: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The rows of a shard in parts whose values begin in the same SORT_BYTES of its contexts; a value is in one part."""
    order = np.argsort(value, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    fresh = np.concatenate([[True], value[order][1:] != value[order][:-1]])
    part = np.maximum.accumulate(np.where(fresh, before, 0)) // SORT_BYTES
    return np.split(order, np.flatnonzero(np.diff(part)) + 1)


def _sorted_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("own")]
        first, _, _ = _unpack(table.column("at").to_numpy())
        many = table.column("many").to_numpy()
        out = []
        for part in _sorted_parts(table.column("value").to_numpy(), np.array([len(x) for x in own], np.int64)):
            for i, mask in zip(part.tolist(), repeated([own[i] for i in part.tolist()], length)):
                if many[i] == 1:
                    out += [(i, int(first[i]) + a, int(first[i]) + b) for a, b in _runs(mask)]
        flat.give_back()
        i, a, b = (list(x) for x in zip(*out)) if out else ([], [], [])
        pick = pa.array(i, pa.int64())
        return pa.table([table.column("k_id").take(pick), table.column("k_text").take(pick), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["k_id", "k_text", "a", "b"])

    return run


def _blocks(length: int, size: int):
    """For each window range of each row's list, its blocks of ``size`` windows by the distance to the minimizer, and a
    digest of what all windows of a block have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch):
                buf, off = flat.bytes_of(part.column("text"))
                lists = part.column("contexts")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                items = lists.flatten()
                place, a, b, value = (items.field(c).to_numpy(zero_copy_only=False) for c in ("place", "a", "b", "value"))
                out = []
                for i in range(len(row)):
                    for k in range((place[i] - b[i] + 1) // size, (place[i] - a[i]) // size + 1):
                        # Windows at distances size*k .. size*k + size - 1 before the minimizer all hold these bytes.
                        lo, hi = place[i] - size * k, place[i] - size * k - size + 1 + length
                        base = off[row[i]]
                        mark = np.frombuffer(hashlib.blake2b(buf[base + lo : base + hi].tobytes(), digest_size=8).digest(), np.int64)[0]
                        out.append((row[i], place[i], max(a[i], place[i] - size * k - size + 1), min(b[i], place[i] - size * k + 1), value[i], k, mark))
                r, *rest = (np.array(x, np.int64) for x in zip(*out)) if out else [np.empty(0, np.int64)] * 7
                yield pa.RecordBatch.from_arrays([part.column("k_id").take(pa.array(r)), part.column("k_text").take(pa.array(r)), *map(pa.array, rest)], names=["k_id", "k_text", "place", "a", "b", "value", "k", "mark"])

    return run


def _listed(base: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """The texts with a list of ``items`` each; texts without one are left out before the join."""
    lists = cut(items.groupBy("k_id", "k_text").agg(F.collect_list(F.struct(*columns)).alias("contexts")))
    texts = sieve.through(base, "k_text", sieve.of(lists.select("k_text")))
    return texts.join(lists, ["k_id", "k_text"])


def repeated_windows(base: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k_id, k_text, runs): start ranges [a, b) of the repeated windows of each text that has any. base: k_id, k_text, text."""
    spark = base.sparkSession
    found = cut(base.mapInArrow(_find(length), _FOUND))
    many = F.sum(F.size("spots")).alias("many")
    distinct = cut(found.groupBy("value", "context").agg(many, F.min(F.array_min("spots")).alias("one")))
    release(spark)
    copies = distinct.where("many > 1").select("value", "context")
    copied = found.join(copies, ["value", "context"], "left_semi").groupBy("slice").agg(F.collect_list("spots").alias("spots"))
    copied = copied.select("spots").mapInArrow(_joined, "k_id long, k_text long, a long, b long")

    per_value = cut(distinct.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))
    release(spark)
    open_ = cut(distinct.join(per_value, "value").select("one.k_id", "one.k_text", "one.at", "value", F.when(F.col("many") > 1, 2).otherwise(1).alias("many"), "n"))
    few, many = open_.where(F.col("n") <= MOST_CONTEXTS), open_.where(F.col("n") > MOST_CONTEXTS)
    volume, crowded = open_.agg(F.sum(F.when(F.col("n") <= MOST_CONTEXTS, F.col("at").bitwiseAND(1023) + length)), F.count(F.when(F.col("n") > MOST_CONTEXTS, 1))).first()
    shards = max(1, math.ceil((volume or 0) / SHARD_BYTES))
    texts = _listed(base, few, ["at", "value", "many"]).mapInArrow(_texts(length), "k_id long, k_text long, at long, value long, many int, own binary")
    # Texts with repeated rows give their contexts once for each row; one is enough.
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards)))
    runs = cut(texts.groupBy("shard").applyInArrow(_unique(_sorted_shard(length)), "k_id long, k_text long, a long, b long"))
    release(spark)
    runs = runs.union(copied)
    if crowded:
        runs = runs.union(_crowded(base, many, length))
    return cut(runs.distinct().groupBy("k_id", "k_text").agg(F.collect_list(F.struct("a", "b")).alias("runs")))


def _unique(run):
    def once(table: pa.Table) -> pa.Table:
        seen, keep = set(), []
        for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("k_id", "k_text", "at")))):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        return run(table.take(pa.array(keep, pa.int64())))

    return once


def _crowded(base: DataFrame, many: DataFrame, length: int) -> DataFrame:
    """Repeated windows of values with too many distinct contexts for one shard. A context that stands for copies
    counts, but its own windows are settled."""
    first, place = F.shiftright("at", 20), F.shiftright("at", 20) + F.shiftright("at", 10).bitwiseAND(1023)
    live = many.select("k_id", "k_text", "value", place.alias("place"), first.alias("a"), (first + F.col("at").bitwiseAND(1023)).alias("b"))
    for size in BLOCKS:
        parts = cut(_listed(base, live, ["place", "a", "b", "value"]).mapInArrow(_blocks(length, size), "k_id long, k_text long, place long, a long, b long, value long, k long, mark long").distinct())
        twice = parts.groupBy("value", "k", "mark").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        live = cut(parts.join(cut(twice), ["value", "k", "mark"], "left_semi").select("k_id", "k_text", "value", "place", "a", "b"))
        release(base.sparkSession)
    return live.select("k_id", "k_text", "a", "b")


def _removed(runs: list[dict], size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    spans: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length - 1) for r in runs or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, min(b, size)) for a, b in spans]


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch):
                buf, off = flat.bytes_of(part.column("text"))
                kept, spans = [], []
                for i, runs in enumerate(part.column("runs").to_pylist()):
                    own, out, at = buf[off[i] : off[i + 1]], [], 0
                    gone = _removed(runs, len(own), length)
                    for a, b in gone:
                        out.append(own[at:a].tobytes())
                        at = b
                    kept.append(b"".join([*out, own[at:].tobytes()]))
                    spans.append(gone)
                sizes = [sum(b - a for a, b in x) for x in spans]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(sizes, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def stripped(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): row (all its columns), kept (binary), n_bytes, n_removed, n_spans, kept_sha256.

    Every byte inside a ``length``-byte string that starts twice or more in the corpus goes, all copies alike;
    matches don't cross documents and are judged on the input. Null and short texts lose nothing. Two rows with the
    same doc_id and text are two documents, so they lose all that is long enough. Rows with a null doc_id take part.
    """
    if length > 1023 or length < 16:
        raise ValueError("a length from 16 to 1023 bytes is supported")
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("k_id"), F.xxhash64("text").alias("k_text"), F.col("text").cast("string").alias("text"))
    runs = repeated_windows(base.select("k_id", "k_text", "text"), length)
    bits = sieve.of(runs.select("k_text"))
    touched = sieve.through(base, "k_text", bits).join(runs, ["k_id", "k_text"], "left").select("row", "text", "runs")
    kind = base.schema["row"].dataType.simpleString()
    touched = touched.mapInArrow(_strip(length), f"row {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = F.coalesce("text", F.lit(""))
    none = F.lit(0).cast("long")
    others = sieve.through(base, "k_text", bits, wanted=False).select("row", whole.cast("binary").alias("kept"), F.octet_length(whole).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"))
    return touched.union(others)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    return stripped(docs.select("doc_id", "text"), length).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([x.as_py().decode("utf-8", "ignore") for x in batch.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pc.if_else(pc.greater(batch.column("n_removed"), 0), texts, batch.column("text"))], names=["row", "text"])


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes in text, all other columns as they were.

    A character that is cut in two goes with the cut. Rows that lose their whole text go; empty ones stay.
    """
    out = stripped(docs, length).where("n_removed = 0 or n_removed < n_bytes").select("row", "kept", "n_removed", F.col("row.text").cast("string").alias("text"))
    kind = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).schema["row"].dataType.simpleString()
    return out.mapInArrow(_decode, f"row {kind}, text string").select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")
