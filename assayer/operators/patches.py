"""A small convolutional network over patches (bands by frames): fitted on a bounded sample, scored in Arrow batches.

One layer of 3 x 3 filters, the positive part, means of neighbouring bands, and a linear head. With 24 x 7 patches and 8
filters that is 521 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a network is fitted on at most: those with the smallest hash of their key.
FIT_ROWS = 20_000


@dataclass
class Network:
    """filters: channels x 3 x 3. head: channels x pooled bands x frames. centre, spread: of each band."""

    filters: np.ndarray
    offsets: np.ndarray
    head: np.ndarray
    bias: float
    centre: np.ndarray
    spread: np.ndarray

    @property
    def size(self) -> int:
        return self.filters.size + self.offsets.size + self.head.size + 1


def _sums(z: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Each filter's response at all places that it fits into: n x channels x bands - 2 x frames - 2."""
    bands, frames = z.shape[1] - 2, z.shape[2] - 2
    return sum(filters[None, :, i, j, None, None] * z[:, None, i : i + bands, j : j + frames] for i in range(3) for j in range(3))


def _forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    z = (x - net.centre[:, None]) / net.spread[:, None]
    response = _sums(z, net.filters) + net.offsets[None, :, None, None]
    active = np.maximum(response, 0)
    pooled = (active[:, :, 0::2] + active[:, :, 1::2]) / 2
    return np.einsum("ncbf,cbf->n", pooled, net.head) + net.bias, (z, response, pooled)


def margins(net: Network, x: np.ndarray) -> np.ndarray:
    return _forward(net, x)[0]


def loss_and_slopes(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, list]:
    """Mean weighted log loss with a penalty on filters and head, and its derivatives by filters, offsets, head and bias."""
    margin, (z, response, pooled) = _forward(net, x)
    loss = float((weight * (np.logaddexp(0, margin) - y * margin)).mean() + decay / 2 * ((net.filters**2).sum() + (net.head**2).sum()))
    d = weight * (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y) / len(y)
    d_head = np.einsum("n,ncbf->cbf", d, pooled) + decay * net.head
    d_active = np.repeat(d[:, None, None, None] * net.head[None], 2, axis=2) / 2 * (response > 0)
    bands, frames = response.shape[2:]
    d_filters = decay * net.filters
    for i in range(3):
        for j in range(3):
            d_filters[:, i, j] += np.einsum("ncbf,nbf->c", d_active, z[:, i : i + bands, j : j + frames])
    return loss, [d_filters, d_active.sum((0, 2, 3)), d_head, float(d.sum())]


def start(x: np.ndarray, seed: int, channels: int = 8) -> Network:
    """Random filters and head of a usual size; bands standardised by the sample."""
    if x.shape[1] % 2 or min(x.shape[1:]) < 3:
        raise ValueError("patches need an even number of bands, and three frames at least")
    rng = np.random.default_rng(seed)
    spread = x.std((0, 2))
    shape = channels, (x.shape[1] - 2) // 2, x.shape[2] - 2
    head = rng.standard_normal(shape) / np.sqrt(np.prod(shape))
    filters = rng.standard_normal((channels, 3, 3)) * np.sqrt(2 / 9)
    return Network(filters, np.zeros(channels), head, 0.0, x.mean((0, 2)), np.where(spread > 1e-8, spread, 1.0))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 0, epochs: int = 20, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam over shuffled batches. weight: of each row, all alike where there is none."""
    weight = np.ones(len(y)) if weight is None else weight
    net, rng = start(x, seed), np.random.default_rng([seed, 1])
    state, step = [[0.0, 0.0] for _ in range(4)], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick, step = order[at : at + batch], step + 1
            _, slopes = loss_and_slopes(net, x[pick], y[pick], weight[pick], decay)
            values = [net.filters, net.offsets, net.head, net.bias]
            for k, slope in enumerate(slopes):
                state[k] = [0.9 * state[k][0] + 0.1 * slope, 0.999 * state[k][1] + 0.001 * slope**2]
                first, second = state[k][0] / (1 - 0.9**step), state[k][1] / (1 - 0.999**step)
                values[k] = values[k] - rate * first / (np.sqrt(second) + 1e-8)
            net = Network(*values, net.centre, net.spread)
    return net


def _patches(column: pa.Array, bands: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), bands, -1)


def fit_on(df: DataFrame, key: str, patch: str, label: str, bands: int, rows: int = FIT_ROWS, **options) -> Network:
    """A network from at most ``rows`` rows. patch: array of bands times frames numbers, a band's frames together."""
    sample = df.where(F.col(patch).isNotNull() & F.col(label).isin(0, 1)).orderBy(F.xxhash64(key), key).limit(rows)
    found = sample.select(F.col(patch).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).toArrow()
    if not found.num_rows:
        raise ValueError("nothing to fit on")
    return fit(_patches(found.column("x").combine_chunks(), bands), found.column("y").to_numpy(), **options)


def score(df: DataFrame, net: Network, keys: list[str], patch: str) -> DataFrame:
    """keys and margin of each row that has a patch."""
    bands = len(net.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margin = margins(net, _patches(batch.column("x"), bands))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(margin)], names=[*keys, "margin"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.where(F.col(patch).isNotNull()).select(*keys, F.col(patch).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, f"{kinds}, margin double")
