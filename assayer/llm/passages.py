"""Repeated passages of words, wherever they begin and end.

Any run of ``LENGTH`` words (A-Z lower-cased) that stands before, in the order of (doc_id, text, word), is
repeated; one in the same document once it starts ``LENGTH`` words later and in another paragraph (a
paragraph that repeats itself is one paragraph). Each window of ``LENGTH`` words names one seed, its ``SEED``-word run of
least hash: equal windows name equal seeds. Consecutive windows with one seed make a context, its words; equal contexts are
settled as wholes, and only where a seed has several distinct contexts are the windows of one of each compared. Seeds,
contexts and windows are compared by 64-bit hashes, always two of them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat, sieve
from assayer.llm.lineage import cut, release

LENGTH = 50
SEED = 25

_SPOT = "struct<k_id: long, k_text: long, at: int, n: int>"
RUNS = "array<struct<a: int, n: int, back: int>>"


def _span_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run of words [first, last), from one prefix sum over the words' hashes."""
    total = np.zeros(len(h) + 1, flat.U)
    np.cumsum(h * flat._power("up", len(h)), out=total[1:])
    return flat.mix((total[last] - total[first]) * flat._power("down", len(h) + 1)[first] + (last - first).astype(flat.U))


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = flat._LOWER[buf]
    starts, ends, at = flat.words(low, off)
    return flat.span_hashes(low, starts, ends), at


def _contexts(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one seed: first words, numbers of windows, texts, hashes of the seeds."""
    if len(h) < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, flat.U),)
    every = np.arange(len(h) - SEED + 1)
    seeds = _span_hashes(h, every, every + SEED)
    first = np.arange(len(h) - LENGTH + 1)
    doc = np.searchsorted(at, first, "right") - 1
    inside = first + LENGTH <= at[doc + 1]
    first, doc, seed = first[inside], doc[inside], flat.least_in_windows(seeds, LENGTH - SEED + 1)[inside]
    if not len(first):
        return first, first, doc, seeds[:0]
    head = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])]))
    return first[head], np.diff(np.append(head, len(first))), doc[head], seeds[seed[head]]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct contexts of each slice of texts, with all their spots in it."""
    for batch in batches:
        for part in flat.slices(batch):
            h, at = _words(*flat.bytes_of(part.column("text")))
            first, n, doc, value = _contexts(h, at)
            context = _span_hashes(h, first, first + n - 1 + LENGTH) if len(first) else value
            order = np.lexsort((context, value))
            value, context = value[order], context[order]
            head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (context[1:] != context[:-1])])[: len(value)])
            pick = pa.array(doc[order])
            numbers = [pa.array(x[order].astype(np.int32)) for x in (first - at[doc], n)]
            spots = [part.column("k_id").take(pick), part.column("k_text").take(pick), *numbers]
            lists = pa.StructArray.from_arrays(spots, ["k_id", "k_text", "at", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(value)).astype(np.int32)), lists)
            yield pa.RecordBatch.from_arrays([pa.array(flat.signed(value[head])), pa.array(flat.signed(context[head])), lists], names=["value", "context", "spots"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the contexts that a row's list names, with their hashes."""
    for batch in batches:
        for part in flat.slices(batch):
            h, at = _words(*flat.bytes_of(part.column("text")))
            wanted = part.column("wanted")
            row = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            items = wanted.flatten()
            a, n, value = (items.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "value"))
            each = np.repeat(np.arange(len(row)), n)
            place = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            first = at[row[each]] + place
            pick = pa.array(row[each])
            columns = [part.column("k_id").take(pick), part.column("k_text").take(pick), pa.array(place.astype(np.int32))]
            columns += [pa.array(value[each]), pa.array(flat.signed(_span_hashes(h, first, first + LENGTH)) if len(first) else first)]
            yield pa.RecordBatch.from_arrays(columns, names=["k_id", "k_text", "at", "value", "h"])


def repeated_passages(keyed: DataFrame) -> DataFrame:
    """(k_id, k_text, runs): of each document with windows that stand before, runs of ``n`` windows from word ``a`` on. A run that stands
    ``back`` words before in the same document is to be judged by removed_words(). keyed: k_id, k_text, text.

    Rows with the same id and text are one document."""
    spark = keyed.sparkSession
    keyed = keyed.where("k_id is not null and length(text) > 0")
    found = cut(keyed.mapInArrow(_find, f"value long, context long, spots array<{_SPOT}>"))
    # Most seeds stand once: they go before anything is grouped by context.
    values = found.groupBy("value").agg(F.sum(F.size("spots")).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    values = cut(values.where("n > 1").select("value", F.when(F.col("low") < F.col("high"), 2).otherwise(1).alias("contexts")))
    release(spark)
    found = cut(sieve.through(found, "value", sieve.of(values.select("value"))).join(values, "value"))
    known = found.groupBy("value", "context", "contexts").agg(F.sum(F.size("spots")).alias("many"), F.min(F.array_min("spots")).alias("one"))
    known = cut(known)
    del values

    copies = found.join(known.where("many > 1").select("value", "context", "one"), ["value", "context"])
    copies = copies.select("value", "contexts", "one", F.explode("spots").alias("s")).where("s <> one")
    within = (F.col("s.k_id") == F.col("one.k_id")) & (F.col("s.k_text") == F.col("one.k_text"))
    copies = copies.select("value", "contexts", "s.*", F.when(within, F.col("s.at") - F.col("one.at")).otherwise(0).alias("back"))
    copies = cut(copies)
    runs = copies.where("back = 0 or contexts = 1").select("k_id", "k_text", F.col("at").alias("a"), "n", "back")

    # One of each distinct context of a seed; and what repeats in a document, which may stand before in another one too.
    mixed = known.where("contexts > 1").select("value", "one.*").union(copies.where("back <> 0 and contexts > 1").select("value", "k_id", "k_text", "at", "n"))
    lists = cut(mixed.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("at", "n", "value")).alias("wanted")))
    texts = sieve.through(keyed, "k_text", sieve.of(lists.select("k_text"))).dropDuplicates(["k_id", "k_text"])
    windows = texts.join(lists, ["k_id", "k_text"]).mapInArrow(_windows, "k_id long, k_text long, at int, value long, h long")
    windows = cut(windows)
    del known, found, mixed, lists, texts
    release(spark)
    first = windows.groupBy("value", "h").agg(F.count("*").alias("many"), F.min(F.struct("k_id", "k_text", "at")).alias("first"))
    again = windows.join(first.where("many > 1").select("value", "h", "first"), ["value", "h"]).where(F.struct("k_id", "k_text", "at") != F.col("first"))
    within = (F.col("k_id") == F.col("first.k_id")) & (F.col("k_text") == F.col("first.k_text"))
    back = F.when(within, F.col("at") - F.col("first.at")).otherwise(0)
    runs = runs.union(again.select("k_id", "k_text", F.col("at").alias("a"), F.lit(1).alias("n"), back.alias("back")))
    return cut(runs.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("a", "n", "back")).cast(RUNS).alias("runs")))


def removed_words(runs: pa.StructArray, at: int, starts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends (exclusive) of what goes of a text whose first word has number ``at`` in its slice. starts: all words' places;
    edges: all paragraphs'."""
    a, n, back = (runs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "n", "back"))
    plain = back == 0
    first, size = at + a[plain], n[plain]
    if not plain.all():
        many = n[~plain]
        own = at + flat.ragged(np.arange(int((a + n).max())), a[~plain], many)
        far = np.repeat(back[~plain], many)
        heads = np.searchsorted(starts, edges)[np.searchsorted(edges, starts[own], "right") - 1]
        keep = (far >= LENGTH) & (own - far < heads)
        first, size = np.concatenate([first, own[keep]]), np.concatenate([size, np.ones(int(keep.sum()), np.int64)])
    return first, first + size - 1 + LENGTH
