"""Best-fit packing of token ids into bins of a fixed capacity under conflicts.

A document's ids are cut into pieces of the capacity, each a bin of its own, and a rest that is packed. Two documents of one source, or of one cluster of duplicates, don't share a bin. Open bins are
ordered by residual capacity and carry a bitmap of the sources and clusters in them. An item goes
to the tightest compatible bin: the search starts at the residual that just holds it and goes on
through its successors; a tree over the residuals holds the AND of the bitmaps below each node, so
stretches in which every bin conflicts are passed over in one step.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat, pieces
from assayer.llm.lineage import small_batches

CAPACITY = 2048  # token ids
#: Rests that are packed together. Shards are drawn by hash, so each has the corpus' mix of sources and sizes.
SHARD = 2048
PIECES = "doc_id long, piece long, start long, n_tokens long, source string, cluster long, copy long, ids array<int>"
SCHEMA = "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_start long, ids array<int>"


class Bins:
    """Open bins by residual capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.common: list[int | None] = [None] * (2 * self.leaves)  # None: no bin below
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.leaves)]

    def _refresh(self, residual: int) -> None:
        node = residual + self.leaves
        common = None
        for mask in self.at[residual]:
            common = mask if common is None else common & mask
        self.common[node] = common
        node >>= 1
        while node:
            a, b = self.common[2 * node], self.common[2 * node + 1]
            new = b if a is None else a if b is None else a & b
            self.common[node] = new
            node >>= 1

    def put(self, residual: int, mask: int, number: int) -> None:
        self.at[residual].setdefault(mask, []).append(number)
        self._refresh(residual)

    def take(self, need: int, item: int) -> tuple[int, int, int] | None:
        """Removes the tightest bin of at least ``need`` that shares no bit with ``item``: (residual, mask, number)."""
        node = need + self.leaves
        while True:
            if (common := self.common[node]) is not None and not common & item:
                if node >= self.leaves:
                    residual = node - self.leaves
                    for mask, numbers in self.at[residual].items():
                        if not mask & item:
                            number = numbers.pop(0)
                            if not numbers:
                                del self.at[residual][mask]
                            self._refresh(residual)
                            return residual, mask, number
                else:
                    node *= 2
                    continue
            while node & 1:  # the last below its parent: on to what follows the parent
                node >>= 1
                if node == 0 or node & (node + 1) == 0 and node == 1:
                    return None
            node += 1


def pack(sizes: list[int], masks: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each item, in the given order; every size is from 1 to capacity."""
    bins, out, opened = Bins(capacity), [], 0
    for size, item in zip(sizes, masks):
        found = bins.take(size, item)
        if found is None:
            found, opened = (capacity, 0, opened), opened + 1
        residual, mask, number = found
        out.append((number, capacity - residual))
        if residual > size:
            bins.put(residual - size, mask | item, number)
    return out


def _shard(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = [("n_tokens", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending"), ("piece", "ascending")]
        table = table.sort_by([*order, ("copy", "ascending")])
        shard, sizes = key[0].as_py() << 32, table.column("n_tokens").to_pylist()
        if shard < 0:  # full pieces
            place = [(k, 0) for k in range(len(sizes))]
        else:
            source, cluster = (table.column(c).to_pylist() for c in ("source", "cluster"))
            many: dict = {}
            for c in cluster:
                many[c] = many.get(c, 0) + 1
            bits: dict = {}
            masks = []
            for s, c in zip(source, cluster):
                names = [("s", s)] * (s is not None) + [("c", c)] * (c is not None and many[c] > 1)
                masks.append(sum(1 << bits.setdefault(name, len(bits)) for name in names))
            filled = sum(n > 0 for n in sizes)  # those without ids come last
            place = pack(sizes[:filled], masks[:filled], capacity)
        number, start = ([x[i] for x in place] for i in (0, 1))
        none = [None] * (len(sizes) - len(place))
        columns = {c: table.column(c) for c in ("doc_id", "piece", "start", "n_tokens")}
        columns |= {"bin_id": pa.array([shard + n for n in number] + none, pa.int64()), "bin_start": pa.array(start + none, pa.int64())}
        return pa.table(columns | {"ids": table.column("ids")})

    return run


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (PIECES) of documents (doc_id, text, source), encoded with the model at ``path``, with an end id each.

    The cluster of a text is that of its exact copies. A null or empty text is one piece without ids. copy tells apart
    rows that an Arrow slice repeats.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    source, cluster = F.col("source").cast("string").alias("source"), F.xxhash64(F.md5("text")).alias("cluster")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, source, cluster)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.model(path)
        for batch in batches:
            for part in flat.slices(batch):
                ids, off = model.encode(part.column("text"))
                size = np.diff(off)
                blank = pc.equal(pc.fill_null(pc.binary_length(part.column("text")), 0), 0).to_numpy(zero_copy_only=False)
                size[blank] = 0
                count = np.maximum(1, -(-size // capacity))
                row = np.repeat(np.arange(len(size)), count)
                number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                n = np.minimum(size[row] - number * capacity, capacity)
                own_ids = flat.ragged(ids, off[:-1][row] + number * capacity, n).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(own_ids))
                copy, seen = np.zeros(len(size), np.int64), Counter()
                for i, k in enumerate(zip(part.column("doc_id").to_pylist(), part.column("cluster").to_pylist())):
                    copy[i] = seen[k]
                    seen[k] += 1
                pick = pa.array(row)
                columns = [part.column("doc_id").take(pick), pa.array(number), pa.array(number * capacity), pa.array(n)]
                columns += [part.column("source").take(pick), part.column("cluster").take(pick), pa.array(copy[row]), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return own.mapInArrow(run, PIECES)


def packed(parts: DataFrame, shards: int, full_shards: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start (in the document), n_tokens, bin_id, bin_start, ids.

    parts: PIECES, of ``capacity`` ids at most. Pieces of the capacity are bins of their own (with negative ids), dealt over full_shards; the
    others are packed in ``shards`` shards. A piece without ids has no bin. A null source or cluster conflicts with nothing.
    Ties in size go by doc_id, cluster, source. Copies that one slice repeats go to different shards.
    """
    place = F.xxhash64("doc_id", "cluster", "copy", F.when(F.col("n_tokens") == capacity, F.col("piece")))
    shard = F.when(F.col("n_tokens") == capacity, -1 - F.pmod(place, F.lit(full_shards))).otherwise(F.pmod(place, F.lit(shards)))
    return parts.withColumn("shard", shard).groupBy("shard").applyInArrow(_shard(capacity), SCHEMA)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """packed() of the documents (doc_id, text, source), which are encoded with the model at ``path``.

    Null, empty and repeated rows: see tokenised() and packed(). Texts may have any length: what a task holds are
    pieces, ``shard`` of them in the mean. Other columns are not read.
    """
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    # A byte is one id at most, and mostly far less; so many shards hold no more than ``shard`` full pieces each.
    full = max(1, math.ceil((size or 0) / (2 * capacity * shard)))
    return packed(tokenised(docs, path, capacity), max(1, math.ceil(n / shard)), full, capacity)
