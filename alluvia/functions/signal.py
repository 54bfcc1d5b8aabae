"""Spectra, filters and interpolation of array columns, by Arrow-batched functions on stacked rows of equal length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from alluvia.functions.lists import col, doubles


def fft_freqs(n: int, fs: float) -> list[float]:
    """The frequencies of n bins of a real spectrum at a sample rate."""
    return [i * fs / (2 * (n - 1)) for i in range(n)]


def fft_freqs_linspace(fnum: int, fmax: float) -> list[float]:
    """fnum values from 0 to fmax, both included."""
    return np.linspace(0.0, fmax, fnum).tolist()


def hann_window(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))


def hamming_window(n: int) -> np.ndarray:
    """Symmetric; one point is NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / np.float64(n - 1))


WINDOWS: dict[str, Callable[[int], np.ndarray]] = {"hanning": hann_window, "hamming": hamming_window}


def band_kind(fs: float, low: float | None, high: float | None) -> tuple[str, float, float]:
    """pass (everything), low, high or band, and the limits."""
    nyquist = fs / 2
    low, high = 0.0 if low is None else float(low), nyquist if high is None else float(high)
    if low < 0:
        raise ValueError("the lower limit is negative")
    if high < low:
        raise ValueError("the upper limit is below the lower one")
    if high > nyquist:
        raise ValueError("the upper limit is above the Nyquist frequency")
    kind = "pass" if low == 0 and high == nyquist else "low" if low == 0 else "high" if high == nyquist else "band"
    return kind, low, high


def butterworth(order: int, fs: float, kind: str, low: float, high: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter: analogue poles, band transform with pre-warped limits, bilinear
    transform, conjugates paired; the gain is 1 in the middle of the pass band."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if kind == "low":
        p, z, at = poles * warp(high), np.zeros(0), 0.0
    elif kind == "high":
        p, z, at = warp(low) / poles, np.zeros(order), fs / 2
    else:
        a, b = warp(low), warp(high)
        centre, half = np.sqrt(a * b), poles * (b - a) / 2
        root = np.sqrt(half**2 - centre**2)
        p, z = np.concatenate([half + root, half - root]), np.zeros(order)
        at = fs / np.pi * np.arctan(centre / (2 * fs))
    digital = lambda s: (2 * fs + s) / (2 * fs - s)
    pz, zz = digital(p), np.concatenate([digital(z).real, -np.ones(len(p) - len(z))])
    upper = sorted(pz[pz.imag > 1e-12], key=abs)
    real = sorted(pz[np.abs(pz.imag) <= 1e-12].real)
    pairs = [(x, x.conjugate()) for x in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    zeros = sorted(zz)
    taken = [zeros.pop(0 if i % 2 == 0 else -1) for i in range(len(zeros))] if kind == "band" else list(zeros)
    sections, i = [], 0
    for pair in pairs:
        own = taken[i : i + len(pair)]
        i += len(pair)
        b, a = np.poly(own), np.real(np.poly(pair))
        sections.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    sos = np.array(sections)
    w = np.exp(-2j * np.pi * at / fs)
    gain = np.abs(np.prod((sos[:, 0] + sos[:, 1] * w + sos[:, 2] * w**2) / (1 + sos[:, 4] * w + sos[:, 5] * w**2)))
    sos[0, :3] /= gain
    return sos


def run_sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter the rows of x, from the state that a constant first value would have settled to."""
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        steady = (b0 + b1 + b2) / (1 + a1 + a2)
        first = y[:, 0]
        s2 = (b2 - a2 * steady) * first
        s1 = (b1 - a1 * steady) * first + s2
        for t in range(y.shape[1]):
            v = y[:, t].copy()
            o = b0 * v + s1
            s1 = b1 * v - a1 * o + s2
            s2 = b2 * v - a2 * o
            y[:, t] = o
    return y


def bandpass(x: np.ndarray, fs: float, order: int, low: float | None, high: float | None) -> np.ndarray:
    """Zero-phase band limit of the rows of x: forwards, then backwards, on ends extended by odd reflection (published method; edge samples
    depend on the length of the extension, here three times the order of the whole filter plus one)."""
    kind, low, high = band_kind(fs, low, high)
    if kind == "pass":
        return x
    sos = butterworth(order, fs, kind, low, high)
    pad = min(3 * (2 * len(sos) + 1), x.shape[1] - 1)
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad else x
    y = run_sections(sos, run_sections(sos, ext)[:, ::-1])[:, ::-1]
    return y[:, pad : pad + x.shape[1]]


def spectra(x: np.ndarray, sample_rate: float, window: str | None, low: float | None, high: float | None, order: int, norm: str | None, skip_fft: bool) -> np.ndarray:
    n = x.shape[1]
    x = bandpass(x, sample_rate, order, low, high)
    shape = WINDOWS.get(window, np.ones)
    if window is not None:
        x = x * shape(n)
    if skip_fft:
        return x
    by = {"length": n / 2 + 1, "window": shape(n // 2 + 1).sum()}.get(norm, 1.0)
    return np.abs(np.fft.rfft(x, axis=1)) / by


def apply_fft(list_column: str | Column, sample_rate: int, window: str | None = None, bp_min: float | None = None, bp_max: float | None = None, bp_ord: int | None = None, norm: str | None = None, skip_fft: bool = False) -> Column:
    """Magnitudes of the real spectrum: band limit, window (hanning, hamming; any other name is flat), transform, division by the length (N/2 + 1)
    or by the sum of a window of that length. A null, NaN or infinite sample, or a length that is no power of two (0 is none), fails the query; a null list is null."""
    band_kind(sample_rate, bp_min, bp_max)

    @F.pandas_udf("array<double>")
    def transform(column: pd.Series) -> pd.Series:
        out = np.empty(len(column), dtype=object)
        present = [i for i, v in enumerate(column) if v is not None]
        sizes: dict[int, list[int]] = {}
        for i in present:
            n = len(column.iloc[i])
            if n < 1 or n & (n - 1):
                raise ValueError(f"apply_fft: {n} samples are not a power of two")
            sizes.setdefault(n, []).append(i)
        for rows in sizes.values():
            x = np.array([np.asarray(column.iloc[i], dtype=np.float64) for i in rows])
            if not np.isfinite(x).all():
                raise ValueError("apply_fft: a sample is null, NaN or infinite")
            for i, y in zip(rows, spectra(x, sample_rate, window, bp_min, bp_max, bp_ord or 4, norm, skip_fft)):
                out[i] = y
        return pd.Series(out)

    return transform(doubles(list_column))


def interpolate_columns(x_data: str | Column, y_data: str | Column, x_interp: str | Column) -> Column:
    """y at the points of x_interp, linear between those of x_data (ascending) and constant beyond them. Null elements are NaN; a null list gives
    null; of unequal lists the shorter counts; no points at all give null."""

    @F.pandas_udf("array<double>")
    def at(x: pd.Series, y: pd.Series, p: pd.Series) -> pd.Series:
        out = np.empty(len(x), dtype=object)
        for i, (a, b, c) in enumerate(zip(x, y, p)):
            if a is None or b is None or c is None:
                continue
            n = min(len(a), len(b))
            if n:
                out[i] = np.interp(np.asarray(c, dtype=np.float64), np.asarray(a[:n], dtype=np.float64), np.asarray(b[:n], dtype=np.float64))
        return pd.Series(out)

    return at(doubles(x_data), doubles(y_data), doubles(col(x_interp)))
