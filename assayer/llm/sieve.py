"""A sieve of keys: a bit table that lets every given key pass, and few others.

It saves texts a shuffle: rows whose key can't be wanted are left out before a join, which then
decides exactly. The table has about ``PER_KEY`` bits a key and 16 MB at most, so what is sent to the executors is
bounded; beyond ten million keys it fills up, and only the saving is lost. Tasks mark their own keys in
blocks of the table; a block's marks are joined on the executors, and the driver gets each block once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm import flat

PER_KEY = 12
#: Binary logarithms of the table's least and greatest size, and of a block's size, in bits.
LEAST, MOST, BLOCK = 17, 27, 17


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (flat.mix(keys.astype(np.int64).view(flat.U)) >> flat.U(64 - size)).astype(np.int64)


def _mark(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.unique(_slot(batch.column(0).drop_null().to_numpy(), size))
            for k in np.unique(slot >> BLOCK).tolist():
                seen.setdefault(k, np.zeros(1 << BLOCK, bool))[slot[slot >> BLOCK == k] & ((1 << BLOCK) - 1)] = True
        for k, marks in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _either(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of all tasks that a partition got, as one for each block."""
    seen: dict[int, np.ndarray] = {}
    for batch in groups:
        for k, bits in zip(batch.column("block").to_pylist(), batch.column("bits")):
            own = np.frombuffer(bits.as_buffer(), np.uint8)
            seen[k] = seen[k] | own if k in seen else own
    for k, own in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "bits"])


def of(keys: DataFrame) -> np.ndarray:
    """The sieve of a frame with one long column, which is read twice."""
    size = min(max((PER_KEY * keys.count()).bit_length(), LEAST), MOST)
    table = np.zeros(1 << size >> 3, np.uint8)
    marks = keys.mapInArrow(_mark(size), "block int, bits binary")
    step = 1 << BLOCK >> 3
    for row in marks.repartition("block").mapInArrow(_either, "block int, bits binary").collect():
        table[row.block * step : (row.block + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return table


def passes(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which keys may be wanted; a null isn't."""
    slot = _slot(keys.fill_null(0).to_numpy(zero_copy_only=False), len(bits).bit_length() + 2)
    found = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
    return found & keys.is_valid().to_numpy(zero_copy_only=False)


def through(rows: DataFrame, key: str, bits: np.ndarray, wanted: bool = True) -> DataFrame:
    """The rows whose key passes (or, with wanted=False, the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = passes(bits, batch.column(key)) == wanted
            if keep.any():
                yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)
