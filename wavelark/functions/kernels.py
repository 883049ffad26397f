"""numpy kernels of the same functions, for wide vectors, and their Arrow entry points."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_matrix(x: np.ndarray, width: int, step: int) -> np.ndarray:
    if len(x) < width:
        return np.zeros((0, width))
    return np.lib.stride_tricks.sliding_window_view(x, width)[::step]


@functools.lru_cache
def _hamming(width: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(width) / max(width - 1, 1))


def preprocess(frames: np.ndarray, factor: float = 0.95) -> np.ndarray:
    """Mean removal, pre-emphasis and Hamming window of each row."""
    y = frames - frames.mean(axis=1, keepdims=True)
    y[:, 1:] -= factor * y[:, :-1]  # the right side is whole before y changes
    y *= _hamming(frames.shape[1])
    return y


#: Rows wider than this are correlated through their power spectrum.
SPECTRAL_WIDTH = 256


@functools.lru_cache
def _power_to_lags(width: int, order: int) -> tuple[int, np.ndarray]:
    """A transform's size that keeps the lags from wrapping around, and the matrix from power spectrum to lags 0..order."""
    least = width + order
    size = min(f << max(1, (-(-least // f) - 1).bit_length()) for f in (1, 3, 9))
    k = np.arange(size // 2 + 1)
    weight = np.full(len(k), 2.0)
    weight[[0, -1]] = 1
    return size, weight[:, None] * np.cos(2 * np.pi * (np.outer(k, np.arange(order + 1)) % size) / size) / size


def autocorrelation(x: np.ndarray, order: int) -> np.ndarray:
    width = x.shape[1]
    if width > SPECTRAL_WIDTH and order < width:
        size, lags = _power_to_lags(width, order)
        spectrum = np.fft.rfft(x, size)
        return (spectrum.real**2 + spectrum.imag**2) @ lags
    return np.stack([np.einsum("ij,ij->i", x[:, : width - lag], x[:, lag:]) if lag < width else np.zeros(len(x)) for lag in range(order + 1)], axis=1)


def levinson(r: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row by row: reflections (column 0 is 0), predictor, prediction error, status (see hof.levinson)."""
    if len(r) > rows:
        parts = [levinson(r[i : i + rows], rows) for i in range(0, len(r), rows)]
        return tuple(np.concatenate(p) for p in zip(*parts))
    v = np.ascontiguousarray(r.T, float)  # a coefficient of all rows is contiguous
    size, n = v.shape
    rc, a = np.zeros((size, n)), np.zeros((size, n))
    a[0] = 1
    pe = v[0].copy()
    status = np.where(pe == 0, 1, 0)
    for k in range(1, size):
        drive = (a[:k] * v[k:0:-1]).sum(axis=0)
        q = np.where(status == 0, -drive / np.where(pe == 0, 1, pe), 0.0)
        a[1 : k + 1] += q * a[:k][::-1].copy()
        rc[k] = q
        pe = pe * (1 - q * q)
        status = np.where((status == 0) & (pe <= 0), 2, status)
    return rc.T, a.T, pe, status


def step_up(rc: np.ndarray) -> np.ndarray:
    a = np.zeros_like(rc)
    a[:, 0] = 1
    for k in range(1, rc.shape[1]):
        a[:, 1 : k + 1] += rc[:, k : k + 1] * a[:, :k][:, ::-1].copy()
    return a


def reflections_to_raa(rc: np.ndarray) -> np.ndarray:
    return autocorrelation(step_up(rc), rc.shape[1] - 1)


def distortions(r: np.ndarray, raa: np.ndarray) -> np.ndarray:
    """Of every frame under every codeword, as one matrix product."""
    weight = np.full(r.shape[1], 2.0)
    weight[0] = 1
    return (r * weight) @ raa.T


def forward(o: np.ndarray, pi: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> float:
    lp, al = 0.0, None
    for s in o:
        al = (pi if al is None else al @ trans) * emit[:, s]
        c = al.sum()
        if not c > 0:
            return float("-inf")
        al = al / c
        lp += float(np.log(c))
    return lp


def viterbi(o: np.ndarray, pi: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[float, list[int]]:
    with np.errstate(divide="ignore"):
        lpi, lt, le = np.log(pi), np.log(trans), np.log(emit)
    phi, back = lpi + le[:, o[0]], []
    for s in o[1:]:
        arrive = phi[:, None] + lt
        psi = arrive.argmax(axis=0)  # the first of equal values
        phi = arrive[psi, np.arange(len(pi))] + le[:, s]
        back.append(psi)
    path = [int(phi.argmax())]
    for psi in reversed(back):
        path.append(int(psi[path[-1]]))
    return float(phi.max()), path[::-1]


def expected_counts(o: np.ndarray, pi: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of one sequence: transitions i to j, emissions of each symbol by state, state visits before the last place, log P.

    Memory is in the number of places times states: the transition counts are summed while the backward pass runs.
    """
    size, n = len(o), len(pi)
    al, scale = np.empty((size, n)), np.empty(size)
    row = pi * emit[:, o[0]]
    for t in range(size):
        if t:
            row = (al[t - 1] @ trans) * emit[:, o[t]]
        scale[t] = row.sum()
        if not scale[t] > 0:
            return np.zeros((n, n)), np.zeros(emit.shape), np.zeros(n), float("-inf")
        al[t] = row / scale[t]
    trans_n, emit_n = np.zeros((n, n)), np.zeros(emit.shape)
    be = np.ones(n)
    emit_n[:, o[-1]] += al[-1]
    for t in range(size - 2, -1, -1):
        ahead = emit[:, o[t + 1]] * be / scale[t + 1]
        trans_n += al[t][:, None] * trans * ahead[None, :]
        be = trans @ ahead
        emit_n[:, o[t]] += al[t] * be
    return trans_n, emit_n, trans_n.sum(axis=1), float(np.log(scale).sum())


# --- Arrow entry points ------------------------------------------------------------------------


#: Frames that are held as a matrix at once, small enough for a core's cache, and frames that are sent on together.
CHUNK, SENT = 64, 8192


def frame_features(x: np.ndarray, order: int, width: int, step: int) -> Iterator[pa.RecordBatch]:
    """A signal's t, r (gain-normalised) and status, in batches; memory is bounded by the signal and one batch."""
    frames = frame_matrix(x, width, step)
    for first in range(0, len(frames), SENT):
        n = min(SENT, len(frames) - first)
        r = np.empty((n, order + 1))
        for a in range(0, n, CHUNK):
            r[a : a + CHUNK] = autocorrelation(preprocess(frames[first + a : first + min(n, a + CHUNK)]), order)
        _, _, pe, status = levinson(r)
        r /= np.where((pe != 0) & (status != 1), pe, 1)[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (order + 1)), pa.array(r.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n, dtype=np.int32)), lists, pa.array(status.astype(np.int32))], ["t", "r", "status"])


def beside(row: list[pa.Array], names: list[str], features: pa.RecordBatch) -> pa.RecordBatch:
    """The one-row arrays, repeated, before the features."""
    every = pa.array(np.zeros(features.num_rows, np.int64))
    return pa.RecordBatch.from_arrays([*(c.take(every) for c in row), *features.columns], [*names, *features.schema.names])


def lpc_frames(signals: DataFrame, order: int, width: int, step: int, samples_col: str = "samples") -> DataFrame:
    """Arrow twin of operators.lpc.lpc_frames: columns other than the samples, t, r (gain-normalised), status.

    Samples and coefficients cross as Arrow buffers without Python objects.
    """
    keep = [f for f in signals.schema.fields if f.name != samples_col]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", t int, r array<double>, status int"
    places = [signals.columns.index(f.name) for f in keep]
    names = [f.name for f in keep]
    at = signals.columns.index(samples_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                for features in frame_features(values[offsets[i] : offsets[i + 1]], order, width, step):
                    yield beside([batch.column(p).slice(i, 1) for p in places], names, features)

    return signals.mapInArrow(run, out)


def nearest_codeword(codebook: np.ndarray):
    """pandas UDF twin of hof.nearest_codeword; codebook (raa rows) is a constant of the function."""
    codebook = np.asarray(codebook, float)

    @F.pandas_udf("struct<d:double,i:int>")
    def assign(r: pd.Series) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame({"d": pd.Series(dtype=float), "i": pd.Series(dtype="int32")})
        d = distortions(np.stack(r.to_numpy()), codebook)
        i = d.argmin(axis=1)
        return pd.DataFrame({"d": d[np.arange(len(d)), i], "i": i.astype(np.int32)})

    return assign


def log_likelihood(models: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """pandas UDF: array of log-likelihoods of a symbol array under each model."""

    @F.pandas_udf("array<double>")
    def score(symbols: pd.Series) -> pd.Series:
        return pd.Series([[forward(np.asarray(o), *m) for m in models] for o in symbols])

    return score


def with_spectrum(df: DataFrame, column: str, size: int, envelope: bool = False, out: str = "db") -> DataFrame:
    """Adds the magnitude spectrum in dB of an array column, floored at -240.

    envelope: the column is a predictor, and the spectrum is that of its all-pole model, the inverse of the predictor's own.
    """
    sign = -20.0 if envelope else 20.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = [sign * np.log10(np.maximum(np.abs(np.fft.rfft(v, size)), 1e-12)) for v in pdf[column]]
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, `{out}` array<double>")
