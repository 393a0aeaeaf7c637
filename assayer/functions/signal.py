"""Signal kernels over array columns, vectorised in numpy and applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FLOOR = 1e-12


def band_edges(rate: int, bands: int, top: float | None = None) -> np.ndarray:
    return np.linspace(0, top or rate / 2, bands + 1)


def psd(x: np.ndarray, window: np.ndarray) -> np.ndarray:
    """One-sided power spectrum of each row."""
    s = np.abs(np.fft.rfft(x * window, axis=-1)) ** 2 / (window**2).sum()
    s[..., 1 : (-1 if x.shape[-1] % 2 == 0 else None)] *= 2
    return s


def window_features(x: np.ndarray, rate: int, bands: int = 24) -> np.ndarray:
    """For each row: log energy of equal bands below 8 kHz, centroid, spread, 85 % roll-off, flatness, slope, log RMS and
    zero-crossing rate."""
    power = psd(x, np.hanning(x.shape[1]))
    f = np.fft.rfftfreq(x.shape[1], 1 / rate)
    edge = band_edges(rate, bands, min(8000.0, rate / 2))
    which = np.clip(np.searchsorted(edge, f, "right") - 1, 0, bands)
    energy = np.stack([power[:, which == b].sum(1) for b in range(bands)], 1)
    total = np.maximum(power.sum(1), FLOOR)
    centre = (power * f).sum(1) / total
    width = np.sqrt(np.maximum((power * (f - centre[:, None]) ** 2).sum(1) / total, 0))
    roll = f[np.argmax(np.cumsum(power, 1) >= 0.85 * total[:, None] - FLOOR, axis=1)]
    log = np.log(np.maximum(power, FLOOR))
    flat = np.exp(log.mean(1)) / np.maximum(power.mean(1), FLOOR)
    g = f - f.mean()
    slope = (log * g).sum(1) / (g * g).sum()
    rms = np.log(np.maximum(np.sqrt((x * x).mean(1)), FLOOR))
    cross = (np.diff(np.signbit(x), axis=1)).mean(1)
    return np.concatenate([np.log(np.maximum(energy, FLOOR)), np.stack([centre, width, roll, flat, slope, rms, cross], 1)], 1)


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Complete frames; a shorter signal is repeated to one."""
    if len(x) < size:
        x = np.resize(x, size) if len(x) else np.zeros(size)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def clip_statistics(x: np.ndarray, rate: int, bands: int = 32, size: int = 1024, hop: int = 256) -> np.ndarray:
    """Mean and population deviation over frames of the log energy in ``bands`` bands."""
    power = psd(framed(x, size, hop), np.hanning(size))
    f = np.fft.rfftfreq(size, 1 / rate)
    which = np.clip(np.searchsorted(band_edges(rate, bands), f, "right") - 1, 0, bands - 1)
    log = np.log(np.maximum(np.stack([power[:, which == b].sum(1) for b in range(bands)], 1), FLOOR))
    return np.concatenate([log.mean(0), log.std(0)])


def mel_triangles(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangles equally spaced in mel, each of sum 1."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(0.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f[None] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - f[None]) / (edge[2:] - edge[1:-1])[:, None]
    t = np.maximum(np.minimum(up, down), 0)
    return t / np.maximum(t.sum(1, keepdims=True), FLOOR)


def log_mel(x: np.ndarray, rate: int, bands: int = 24, size: int = 512, hop: int = 256) -> np.ndarray:
    return np.log(np.maximum(psd(framed(x, size, hop), np.hanning(size)) @ mel_triangles(rate, size, bands).T, FLOOR))


def high_fraction(x: np.ndarray, rate: int, cutoff: float) -> float:
    """Share of energy strictly above the cutoff (Blackman window); 0 for silence."""
    s = np.abs(np.fft.rfft(x * np.blackman(len(x)))) ** 2
    total = s.sum()
    return float(s[np.fft.rfftfreq(len(x), 1 / rate) > cutoff].sum() / total) if total > 0 else 0.0


def chebyshev_order(rate: int, passband: float, stopband: float, loss: float, attenuation: float) -> int:
    """Least order of a type II design that loses at most ``loss`` dB up to the passband edge and ``attenuation`` dB from the stopband edge on."""
    if not 0 < passband < stopband < rate / 2:
        raise ValueError("edges must rise within half the rate")
    ratio = np.tan(np.pi * stopband / rate) / np.tan(np.pi * passband / rate)
    return int(np.ceil(np.arccosh(np.sqrt((10 ** (attenuation / 10) - 1) / (10 ** (loss / 10) - 1))) / np.arccosh(ratio) - 1e-9))


def chebyshev_power(f: np.ndarray, rate: int, stopband: float, order: int, attenuation: float) -> np.ndarray:
    """Squared magnitude of a type II design (bilinear transform) at frequencies f."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        v = np.tan(np.pi * stopband / rate) / np.tan(np.pi * np.minimum(f, rate / 2 * (1 - 1e-12)) / rate)
        t = np.where(np.abs(v) <= 1, np.cos(order * np.arccos(np.clip(v, -1, 1))), np.cosh(order * np.arccosh(np.maximum(np.abs(v), 1))))
        e = t * t / (10 ** (attenuation / 10) - 1)
        return np.where(np.isinf(e), 1.0, e / (1 + e))


def low_pass(x: np.ndarray, rate: int, cutoff: float, width: float = 200.0, loss: float = 0.5, attenuation: float = 60.0) -> np.ndarray:
    """Zero-phase band limit: a Chebyshev II design of derived order, run forwards and backwards. Passband edge cutoff - width (``loss``
    dB for both runs), stopband edge cutoff (``attenuation`` dB a run). Both runs together multiply the spectrum by the
    design's squared magnitude, which is what is done here; ends are treated as periodic."""
    order = chebyshev_order(rate, cutoff - width, cutoff, loss / 2, attenuation)
    gain = chebyshev_power(np.fft.rfftfreq(len(x), 1 / rate), rate, cutoff, order, attenuation)
    return np.fft.irfft(np.fft.rfft(x) * gain, len(x))


def quantised(x: np.ndarray) -> np.ndarray:
    """On the grid of 16-bit PCM, downwards."""
    return np.floor(np.clip(x, -1, 1 - 1 / 32768) * 32768) / 32768


def analysed(x: np.ndarray, rate: int, cutoff: float, least: int) -> np.ndarray:
    """The common path of a comparison: repeated to a least length, band-limited, and on the 16-bit grid."""
    return quantised(low_pass(np.resize(x, max(len(x), least)), rate, cutoff))


#: Stress conditions by name: gains in dB, band limits in Hz, seconds that are kept.
STRESS = {"clean": None, "gain_minus6": ("gain", -6.0), "gain_minus12": ("gain", -12.0), "lowpass4000": ("limit", 4000.0), "lowpass6000": ("limit", 6000.0), "first2": ("first", 2.0), "first5": ("first", 5.0)}


def stressed(x: np.ndarray, rate: int, cell: str) -> np.ndarray:
    """A signal under one stress condition; all members of a comparison go through the same one."""
    rule = STRESS[cell]
    if rule is None:
        return x.copy()
    kind, value = rule
    if kind == "gain":
        return x * 10 ** (value / 20)
    return low_pass(x, rate, value) if kind == "limit" else x[: int(rate * value)].copy()


def core_measures(x: np.ndarray, rate: int, threshold: float, size: int, hop: int) -> np.ndarray:
    """rms, peak, share of active frames, and mean and deviation of the window features over all frames, and over active ones (NaN if none)."""
    frames = framed(x, size, hop)
    levels = np.sqrt((frames * frames).mean(1))
    active = levels >= threshold
    features = window_features(frames, rate)
    parts = [np.array([np.sqrt((x * x).mean()), np.abs(x).max(), active.mean()]), features.mean(0), features.std(0)]
    for f in (np.mean, np.std):
        parts.append(f(features[active], 0) if active.any() else np.full(features.shape[1], np.nan))
    return np.concatenate(parts)


def boundary_step(x: np.ndarray, at: int, reach: int) -> float:
    """How far the level (rms, in dB) changes from the ``reach`` samples before a place to those behind it."""
    before, after = (np.sqrt((part * part).mean()) if len(part) else 0.0 for part in (x[max(0, at - reach) : at], x[at : at + reach]))
    return float(20 * np.log10(max(after, FLOOR) / max(before, FLOOR)))


def spectral_distance(x: np.ndarray, ref: np.ndarray, rate: int, cuts: tuple[float, ...], size: int = 1024, hop: int = 256) -> np.ndarray:
    """Root mean square difference in dB between two aligned signals, by band."""
    n = min(len(x), len(ref))
    a, b = (10 * np.log10(np.maximum(psd(framed(s[:n], size, hop), np.hanning(size)), FLOOR)) for s in (x, ref))
    f = np.fft.rfftfreq(size, 1 / rate)
    edge = np.array([0.0, *cuts, np.inf])
    return np.array([np.sqrt(((a - b)[:, (f >= lo) & (f < hi)] ** 2).mean()) for lo, hi in zip(edge[:-1], edge[1:])])


def lag(x: np.ndarray, ref: np.ndarray, most: int = 2048) -> tuple[int, float]:
    """Lag (positive: x is delayed) with the largest absolute correlation within bounds, and that correlation."""
    n = max(len(x), len(ref))
    size = 1 << (2 * n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(ref, size)), size)
    norm = np.sqrt((x * x).sum() * (ref * ref).sum())
    lags = np.arange(-min(most, n - 1), min(most, n - 1) + 1)
    r = c[lags] / norm if norm > 0 else np.zeros(len(lags))
    best = int(np.argmax(np.abs(r)))
    return int(lags[best]), float(r[best])


def envelope(x: np.ndarray, frame: int = 256) -> np.ndarray:
    n = len(x) // frame
    return np.sqrt((x[: n * frame].reshape(n, frame) ** 2).mean(1))


def periodicity(x: np.ndarray, rate: int, low: float = 50.0, high: float = 500.0) -> float:
    """Largest normalised autocorrelation at lags of low to high Hz."""
    size = 1 << (2 * len(x) - 1).bit_length()
    c = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)
    span = c[int(rate / high) : int(rate / low) + 1]
    return float(span.max() / c[0]) if c[0] > 0 and len(span) else 0.0


def cepstral_smooth(power: np.ndarray, lifter: int = 22) -> np.ndarray:
    """Log spectra with the cepstrum cut behind ``lifter`` coefficients."""
    c = np.fft.irfft(np.log(np.maximum(power, FLOOR)), axis=-1)
    c[..., lifter:-lifter] = 0
    return np.fft.rfft(c, axis=-1).real


def splice(x: np.ndarray, donor: np.ndarray, start: int, fade: int) -> np.ndarray:
    """donor in place of x[start : start + len(donor)], with linear crossfades of k / (fade + 1), on the 16-bit grid."""
    w = np.ones(len(donor))
    ramp = np.arange(1, fade + 1) / (fade + 1)
    if fade:
        w[:fade], w[-fade:] = ramp, ramp[::-1]
    out = x.astype(np.float64).copy()
    own = out[start : start + len(donor)]
    out[start : start + len(donor)] = np.where(own == donor, own, (1 - w) * own + w * donor)
    return np.floor(out * 32768) / 32768


def mel_cepstral_distortion(a: np.ndarray, b: np.ndarray) -> float:
    """Of two aligned cepstra (frames by coefficients, without the energy), in dB."""
    return float(10 / np.log(10) * np.sqrt(2 * ((a - b) ** 2).sum(1)).mean())


def apply(df: DataFrame, column: str, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray | list], name: str) -> DataFrame:
    """keys and the kernel's values (array<double>) for each row's array; null and empty arrays give null."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x.as_py() is None or not len(x) else np.atleast_1d(np.asarray(kernel(np.asarray(x.values, np.float64)), np.float64)) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.list_(pa.float64()))], names=[*keys, name])

    return df.select(*keys, column).mapInArrow(run, f"{kinds}, `{name}` array<double>")
