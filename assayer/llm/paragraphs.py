"""Substring dedup by paragraph MinHash banding.

A paragraph is a text's words up to a newline. Paragraphs of ``LEAST_WORDS`` words or more with equal shingle sets are
copies. The others are hashed into bands; paragraphs that collide are verified by the exact Jaccard
similarity of their 5-word shingles, and of each component only the first in the order of (doc_id, text,
paragraph) stays. Shorter paragraphs, and the parts of those that a passage's edges cut, are compared as words of
whole passages (``passages.py``), so a short line that many clean texts share (a licence, a greeting) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat, sieve
from assayer.llm.lineage import cut, release
from assayer.llm.links import link_components
from assayer.llm.minhash import matched
from assayer.llm.passages import RUNS, removed_words, repeated_passages

PERCENT = 75
LEAST_WORDS = 25
RECALL = 0.999
#: Hashes of a paragraph at most.
HASHES = 64


def tune_bands(threshold: float, recall: float, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with at least this probability, with ``most`` hashes at most: the
    most rows in a band, as dissimilar pairs collide the less the more rows there are."""
    best = None
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


BANDS, ROWS = tune_bands(PERCENT / 100, RECALL)
_TURN = flat.mix(np.arange(1, BANDS * ROWS + 1, dtype=flat.U) * flat.U(0x9E3779B97F4A7C15)) | flat.U(1)


def split(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 offsets of the paragraphs, which tile the buffer, and the text that each is in."""
    starts, ends, at = flat.words(buf, off)
    if not len(starts):
        full = np.flatnonzero(np.diff(off))
        return np.unique(off), full
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    first = np.flatnonzero(breaks[starts[1:]] > breaks[ends[:-1]]) + 1
    inner = np.ones(len(starts) + 1, bool)
    inner[at[:-1]] = False  # a text's first word starts no paragraph of its own: the text's start does
    edges = np.unique(np.concatenate([off, starts[first[inner[first]]]]))
    return edges, np.searchsorted(off, edges[:-1], "right") - 1


def _parts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' paragraphs: shingle hashes, n + 1 offsets into them, word counts, and the text that each is in."""
    edges, doc = split(buf, off)
    h, to, n_words = flat.shingles(buf, edges)
    return h, to, n_words, doc


def _sets(h: np.ndarray, to: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sorted hashes of some paragraphs, one after the other, and where each begins; none is empty."""
    size = (to[1:] - to[:-1])[use]
    h, own = flat.ragged(h, to[:-1][use], size), np.repeat(np.arange(len(use)), size)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
    return h[new], np.searchsorted(own[new], np.arange(len(use)))


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.slices(batch):
            h, to, n_words, doc = _parts(*flat.bytes_of(part.column("text")))
            use = np.flatnonzero(n_words >= LEAST_WORDS)
            if not len(use):
                continue
            h, head = _sets(h, to, use)
            mark = np.add.reduceat(flat.mix(h ^ flat.U(0x5851F42D4C957F2D)), head)  # of the set
            keys = []
            for band in range(BANDS):
                key = np.full(len(use), band + 1, flat.U)
                for turn in _TURN[band * ROWS : (band + 1) * ROWS]:
                    key = flat.mix(key * flat.U(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(h * turn, head))
                keys.append(flat.signed(key))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(keys, 1).ravel()), BANDS).cast(pa.list_(pa.int64()))
            pick = pa.array(doc[use])
            number = (np.arange(len(doc)) - np.searchsorted(doc, doc))[use]
            n = np.diff(np.append(head, len(h)))
            columns = [part.column("k_id").take(pick), part.column("k_text").take(pick), *map(pa.array, (number, n, flat.signed(mark))), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["k_id", "k_text", "number", "n", "mark", "keys"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the paragraphs that a row's list names."""
    for batch in batches:
        for part in flat.slices(batch):
            h, to, _, doc = _parts(*flat.bytes_of(part.column("text")))
            wanted = part.column("wanted")
            row = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            items = wanted.flatten()
            use = np.searchsorted(doc, row) + items.field("number").to_numpy(zero_copy_only=False)
            found, head = _sets(h, to, use)
            off = pa.array(np.append(head, len(found)).astype(np.int32))
            hashes = pa.ListArray.from_arrays(off, pa.array(flat.signed(found)))
            yield pa.RecordBatch.from_arrays([items.field("id"), hashes], names=["id", "hashes"])


def _listed(alike: np.ndarray, met: np.ndarray | None):
    """A row for each key, of those that pass the sieve ``met``, of the paragraphs whose mark is null or not in ``alike``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~sieve.passes(alike, batch.column("mark"))))
            keys = batch.column("keys").flatten()
            ids = pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))
            if met is not None:
                keep = pa.array(sieve.passes(met, keys))
                keys, ids = keys.filter(keep), ids.filter(keep)
            yield pa.RecordBatch.from_arrays([ids, keys], names=["id", "key"])

    return run


def repeated_paragraphs(keyed: DataFrame) -> DataFrame:
    """(k_id, k_text, gone): for each document with repeated paragraphs, the numbers of those that go. keyed: k_id, k_text, text."""
    spark = keyed.sparkSession
    keyed = keyed.where("k_id is not null and length(text) > 0")
    marked = keyed.mapInArrow(_band, "k_id long, k_text long, number long, n long, mark long, keys array<long>")
    marked = cut(marked.withColumn("id", F.monotonically_increasing_id()))
    place = F.struct("k_id", "k_text", "number")
    same = marked.groupBy("mark", "n").agg(F.count("*").alias("many"), F.min(place).alias("first"))
    same = cut(same.where("many > 1").select("mark", "n", "first"))
    bits = sieve.of(same.select("mark"))
    alike = sieve.through(marked, "mark", bits).join(same, ["mark", "n"], "left")
    copy = F.coalesce(place != F.col("first"), F.lit(False))
    alike = cut(alike.select("k_id", "k_text", "number", "id", "keys", copy.alias("copy")))
    first = alike.where("not copy")
    single = sieve.through(marked.select("k_id", "k_text", "number", "id", "mark"), "mark", bits, wanted=False).drop("mark")
    single = single.union(first.select("k_id", "k_text", "number", "id"))
    banded = marked.select("id", "mark", "keys").union(first.select("id", F.lit(None).cast("long"), "keys"))

    def lists(met: np.ndarray | None = None) -> DataFrame:
        rows = banded.mapInArrow(_listed(bits, met), "id long, key long")
        return rows.select("id", F.lit(0).cast("long").alias("own"), F.lit(BANDS).alias("n_keys"), "key")

    sets: list[DataFrame] = []

    def whole(pairs: DataFrame) -> DataFrame:
        """The sets of all paragraphs that can link with any, which are those of the first pairs."""
        if not sets:
            ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            named = cut(single.join(ids, "id"))
            listed = cut(named.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("number", "id")).alias("wanted")))
            texts = sieve.through(keyed, "k_text", sieve.of(listed.select("k_text")))
            texts = texts.dropDuplicates(["k_id", "k_text"]).join(listed, ["k_id", "k_text"])
            sets.extend([cut(texts.mapInArrow(_whole, "id long, hashes array<long>")), named])
        return sets[0]

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        full = whole(pairs)
        release(spark)
        return matched(pairs, full, PERCENT)

    def elements(items: DataFrame) -> DataFrame:
        own = sets[0].join(items, "id")
        return own.select("id", "part", F.lit(0).alias("own"), "hashes")

    near = link_components(lists(), verify, elements, None, PERCENT, lists)
    near = cut(near.union(near.select("component", "component")).distinct().join(sets[1], "id"))
    first = near.groupBy("component").agg(F.min(place).alias("first"))
    near = near.join(first, "component").where(place != F.col("first")).select("k_id", "k_text", "number")
    gone = alike.where("copy").select("k_id", "k_text", "number").union(near)
    return cut(gone.groupBy("k_id", "k_text").agg(F.collect_set("number").alias("gone")))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.slices(batch):
            buf, off = flat.bytes_of(part.column("text"))
            edges, doc = split(buf, off)
            span = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
            starts, _, at = flat.words(buf, off)
            heads = np.append(starts, len(buf))  # a word reaches to the next one, and those at a text's ends to them
            full = np.flatnonzero(np.diff(at))
            heads[at[full]] = off[full]
            lost = np.zeros(len(buf) + 1, np.int64)
            removed, touched = [], []
            for i, (gone, runs) in enumerate(zip(part.column("gone").to_pylist(), part.column("runs"))):
                removed.append(len(gone or ()))
                touched.append(bool(gone) or runs.is_valid)
                for k in gone or ():
                    lost[edges[span[i] + k]] += 1
                    lost[edges[span[i] + k + 1]] -= 1
                if runs.is_valid:
                    first, last = removed_words(runs.values, int(at[i]), starts, edges)
                    np.add.at(lost, heads[first], 1)
                    np.add.at(lost, np.where(last < at[i + 1], heads[last], off[i + 1]), -1)
            keep = np.cumsum(lost[:-1]) == 0
            words = np.concatenate([[0], np.cumsum(~keep[starts])])[at]
            cuts = zip(off[:-1].tolist(), off[1:].tolist(), touched)
            kept = pa.array([buf[x:y][keep[x:y]].tobytes() if t else None for x, y, t in cuts], pa.binary()).cast(pa.string())
            texts = pc.if_else(pa.array(touched, pa.bool_()), kept, part.column("text"))
            columns = [part.column("row"), texts, pa.array(np.diff(np.array(span))), pa.array(removed, pa.int64()), pa.array(np.diff(words))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "kept", "n_paragraphs", "n_removed_paragraphs", "n_removed_words"])


def stripped(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): row (all its columns), kept (the text left), n_paragraphs,
    n_removed_paragraphs, n_removed_words (in removed paragraphs and passages).

    Of paragraphs of LEAST_WORDS words that link (100 * |A & B| >= 75 * |A | B| over distinct 5-word shingles, A-Z
    lower-cased), directly or through others, within a document too, the first stays. Shorter paragraphs, and parts of
    paragraphs, go where they lie in a passage of passages.LENGTH words that stands before. Null and empty texts stay; rows
    with a null doc_id take no part. Rows with the same doc_id and text are one document and lose the same; rows that repeat
    a doc_id with another text are documents of their own. Texts may have any length.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keys = F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_text")
    base = docs.select(row, *keys, F.col("text").cast("string").alias("text"))
    runs = repeated_passages(base.select("k_id", "k_text", "text"))
    release(docs.sparkSession)
    gone = repeated_paragraphs(base.select("k_id", "k_text", "text"))
    release(docs.sparkSession)
    lost = cut(gone.join(runs, ["k_id", "k_text"], "full"))
    bits = sieve.of(lost.select("k_text"))
    touched = sieve.through(base, "k_text", bits).join(lost, ["k_id", "k_text"], "left").select("row", "text", "gone", "runs")
    none = F.lit(None).cast("array<long>").alias("gone"), F.lit(None).cast(RUNS).alias("runs")
    others = sieve.through(base, "k_text", bits, wanted=False).select("row", "text", *none)
    kind = base.schema["row"].dataType.simpleString()
    return touched.union(others).mapInArrow(
        _strip, f"row {kind}, kept string, n_paragraphs long, n_removed_paragraphs long, n_removed_words long"
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_removed_paragraphs, n_removed_words, n_bytes, n_removed_bytes, kept_sha256 for each row of
    docs (doc_id, text)."""
    out = stripped(docs.select("doc_id", "text"))
    before, after = (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("row.text", "kept"))
    return out.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_paragraphs", "n_removed_paragraphs", "n_removed_words",
        before.alias("n_bytes"), (before - after).alias("n_removed_bytes"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )
