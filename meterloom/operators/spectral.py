"""Spectra and wavelets of resampled series.

Meters of one length are transformed as one matrix per batch; results leave as
flat columns, never as Python objects per value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meterloom.functions import kernels
from meterloom.operators.distance import series_arrays

CELLS = 1 << 20  # results held at once


def _transformed(series: DataFrame, columns: str, fan: int, transform: Callable[[np.ndarray], Iterator[tuple]]) -> DataFrame:
    """``id`` and ``columns`` from ``transform``, which turns a matrix of series into tuples of arrays.

    The arrays of a tuple have one leading axis for the series (or 1) and are
    spread to a common shape. ``fan`` is about the number of results per value.
    """
    schema = T.StructType([series.schema["id"], *T.StructType.fromDDL(columns).fields])
    names = schema.names[1:]

    def run(batches):
        for batch in batches:
            sizes = batch["values"].map(len).to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                step = max(1, CELLS // (int(size) * fan))
                for s in range(0, len(own), step):
                    part = batch.iloc[own[s : s + step]]
                    x = np.stack(part["values"].to_numpy()).astype(float)
                    for arrays in transform(x):
                        shape = np.broadcast_shapes((len(x),), *[a.shape[:1] for a in arrays]) + np.broadcast_shapes(*[a.shape[1:] for a in arrays])
                        flat = {c: np.broadcast_to(a, shape).reshape(-1) for c, a in zip(names, arrays)}
                        yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), int(np.prod(shape[1:]))), **flat})

    return series_arrays(series).mapInPandas(run, schema)


def lowpass_fft(series: DataFrame, divisor: int = 20) -> DataFrame:
    """Replace each series by the magnitude of its first ``n div divisor`` frequencies: ``id, idx, usage``."""
    return _transformed(series, "idx long, usage double", 2, lambda x: iter([(np.arange(x.shape[1])[None], kernels.lowpass(x, divisor))]))


def wavelet_dwt(series: DataFrame, levels: int = 4) -> DataFrame:
    """db3 decomposition: ``id, level, part, pos, value`` with part ``approx`` or ``detail``."""

    def decompose(x):
        approx = x
        for level in range(levels):
            approx, detail = kernels.dwt_step(approx)
            for part, values in (("approx", approx), ("detail", detail)):
                yield np.array([[level]]), np.array([[part]], dtype=object), np.arange(values.shape[1])[None], values

    return _transformed(series, "level int, part string, pos int, value double", 8, decompose)


def spectrogram(series: DataFrame, window: int = 256, overlap: int = 32) -> DataFrame:
    """Short-time power density: ``id, f, t, power``."""

    def density(x):
        f, t, power = kernels.spectrogram(x, window, overlap)
        yield f[None, :, None], t[None, None, :], power

    return _transformed(series, "f double, t double, power double", 2, density)


def scalogram(series: DataFrame, voices: int = 4) -> DataFrame:
    """Morlet magnitudes: ``id, scale, t, magnitude``."""

    def magnitudes(x):
        scales, magnitude = kernels.scalogram(x, voices)
        yield scales[None, :, None], np.arange(x.shape[1])[None, None, :], magnitude

    return _transformed(series, "scale double, t int, magnitude double", 16 * voices, magnitudes)
