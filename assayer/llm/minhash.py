"""MinHash near-dedup: bottom-k sketches from one hash function.

A document's set holds its distinct 5-word shingles, hashed once to 64 bits. Its sketch is the
``K`` smallest hashes. Documents with equal sets are one class. The inverted lists of the retained
values give classes that overlap; the smallest K values of two sketches' union estimate their
Jaccard similarity and drop what can't reach the threshold; the full sets decide the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat, sieve
from assayer.llm.lineage import cut, release
from assayer.llm.links import link_components

K = 64
PERCENT = 75
#: Of K retained values two documents at the threshold share fewer with a probability under 1e-6 (binomial tail).
SHARED_OF_K = 28
#: Likewise for a union sketch: an estimate below this share of its K values is no near copy.
ESTIMATE = SHARED_OF_K / K


def need(n_keys: Column) -> Column:
    """Retained values that two linked documents share: exact while the sketch is the whole set."""
    return F.when(n_keys <= 48, F.ceil(n_keys * PERCENT / 100.0)).when(n_keys < K, F.lit(36)).otherwise(F.lit(SHARED_OF_K))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.slices(batch):
            found = flat.sets(*flat.bytes_of(part.column("text")))
            marks = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found), np.int64).reshape(-1, 2)
            low = [flat.signed(x[:K]) for x in found]
            off = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*low, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array([len(x) for x in found], np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), kept], names=["doc_id", "n", "d1", "d2", "sketch"])


def _full(bits: np.ndarray):
    """(id, hashes) of the documents that the sieve lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch.filter(pa.array(sieve.passes(bits, batch.column("doc_id"))))):
                found = flat.sets(*flat.bytes_of(part.column("text")))
                off = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                whole = flat.signed(np.concatenate([*found, np.empty(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(whole))], names=["id", "hashes"])

    return run


def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose union sketch holds enough common values."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        (va, oa), (vb, ob) = (_lists(batch.column(c)) for c in ("sketch_a", "sketch_b"))
        for i in range(batch.num_rows):
            a, b = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            both = np.concatenate([a, b])
            both.sort()
            twice = both[1:] == both[:-1]
            union = len(both) - int(twice.sum())
            if union > K:  # values up to the K-th of the union; a sketch shorter than K is a whole set
                rank = np.concatenate([[0], np.cumsum(~twice)])[1:]
                common, of = int((twice & (rank < K)).sum()), K
                keep[i] = common >= ESTIMATE * of
            else:
                keep[i] = 100 * int(twice.sum()) >= PERCENT * union if len(a) < K and len(b) < K else int(twice.sum()) >= ESTIMATE * union
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()


def confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([flat.jaccard_reaches(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def matched(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), the pairs whose full sets reach the threshold. full: id, hashes (distinct, in unsigned order)."""
    x, y = full.select(F.col("id").alias("a"), F.col("hashes").alias("x")), full.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A & B| >= 75 * |A | B| over their distinct 5-word shingles (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer words than five: the whole sequence is the one
    shingle). component_id is the smallest doc_id reachable by links; kept marks that document.
    Null and wordless texts have no shingles and link with nothing. Rows that repeat a doc_id are one
    document that links by any of their texts; each has a row in the result with the shingles of its own text. A null
    doc_id links with nothing: its component is null and it is kept. Texts may have any length. Other columns are not
    read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = cut(docs.mapInArrow(_sketch, "doc_id long, n long, d1 long, d2 long, sketch array<long>"))
    known = marked.where("n > 0 and doc_id is not null")
    classes = cut(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")))
    lists = classes.select("id", F.col("d1").alias("own"), F.size("sketch").alias("n_keys"), F.explode("sketch").alias("key"))

    def whole(ids: DataFrame) -> DataFrame:
        return docs.mapInArrow(_full(sieve.of(ids)), "id long, hashes array<long>")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        likely = pairs.join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b")
        likely = cut(likely.mapInArrow(estimates, "a long, b long"))
        full = cut(whole(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id")))))
        release(docs.sparkSession)
        return matched(likely, full, PERCENT).distinct()

    def elements(items: DataFrame) -> DataFrame:
        own = whole(items.select("id")).join(items, "id")
        return own.select("id", "part", F.xxhash64("hashes").alias("own"), "hashes")

    parts = link_components(lists, verify, elements, need, PERCENT)
    low = parts.select(F.col("id").alias("p_id"), "component")
    named = cut(classes.select("d1", "d2", "id").join(low, F.col("id") == F.col("p_id"), "left").select("d1", "d2", F.coalesce("component", "id").alias("component")))
    out = marked.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns as they were.

    That with the smallest doc_id stays; rows that repeat its doc_id stay with it, as do null doc_ids.
    """
    found = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("gone")))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    bits = sieve.of(gone)
    doubtful = sieve.through(base, "id", bits).join(gone, F.col("id") == F.col("gone"), "left_anti")
    return doubtful.union(sieve.through(base, "id", bits, wanted=False)).select("row.*")
