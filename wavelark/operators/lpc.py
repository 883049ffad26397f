"""Framing and linear-prediction features of signals."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions import hof, kernels
from wavelark.sources import wav

#: Frames wider than this go through Arrow and numpy; narrower ones stay in the JVM.
NATIVE_WIDTH = 128


def frame_signals(signals: DataFrame, width: int, step: int, samples_col: str = "samples") -> DataFrame:
    """One row per full frame: the other columns, t, frame."""
    others = [c for c in signals.columns if c != samples_col]
    return signals.select(*others, F.posexplode(hof.frames_of(F.col(samples_col), width, step)).alias("t", "frame"))


def frame_rows(samples: DataFrame, keys: list[str], width: int, step: int, pos_col: str = "pos", value_col: str = "x") -> DataFrame:
    """The same from a long table of samples (keys, pos, x): one row per full frame, t and frame."""
    ahead = Window.partitionBy(*keys).orderBy(pos_col).rowsBetween(0, width - 1)
    framed = samples.withColumn("frame", F.collect_list(value_col).over(ahead))
    return framed.where((F.col(pos_col) % step == 0) & (F.size("frame") == width)).select(*keys, (F.col(pos_col) / step).cast("int").alias("t"), "frame")


def preprocessed(frame: Column, width: int) -> Column:
    return hof.apply_window(hof.preemphasize(hof.remove_mean(frame)), hof.hamming_window(width))


def features(frames: DataFrame, order: int, frame_col: str = "frame", normalize: bool = True) -> DataFrame:
    """Adds r (gain-normalised unless told otherwise) and lp: struct(rc, a, pe, status). A silent frame keeps its zeros."""
    out = frames.withColumn("r", hof.autocorrelation(F.col(frame_col), order)).withColumn("lp", hof.levinson(F.col("r"), order))
    return out.withColumn("r", hof.gain_normalized(F.col("r"), F.col("lp.pe"))) if normalize else out


def lpc_frames(signals: DataFrame, order: int, width: int, step: int, samples_col: str = "samples", native: bool | None = None) -> DataFrame:
    """Normalised autocorrelations of the pre-processed frames of each signal: the other columns, t, r, status."""
    if native if native is not None else width <= NATIVE_WIDTH:
        framed = frame_signals(signals, width, step, samples_col)
        done = features(framed.withColumn("frame", preprocessed(F.col("frame"), width)), order)
        return done.select(*[c for c in signals.columns if c != samples_col], "t", "r", F.col("lp.status").alias("status"))
    return kernels.lpc_frames(signals, order, width, step, samples_col)


def window_of(sample_rate: float, window_ms: int, offset_ms: int) -> tuple[int, int]:
    return int(window_ms * sample_rate / 1000), int(offset_ms * sample_rate / 1000)


def lpc_files(files: DataFrame, order: int, window_ms: int = 45, offset_ms: int = 15, mode: str = "PERMISSIVE") -> DataFrame:
    """Features straight from WAV files (path, content, as binaryFile gives them): path, class_name, sample_rate, t, r, status.

    A file is decoded where its features are found, so its samples never cross from Python to the JVM and back. Files that
    can't be read are skipped (FAILFAST: raise); the window follows each file's own rate.
    """
    names = ["path", "class_name", "sample_rate"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rate, x = wav.decode(raw.as_py() or b"")
                except (wav.WavError, struct.error):
                    if mode == "FAILFAST":
                        raise
                    continue
                row = [pa.array([path], pa.string()), pa.array([wav.class_of(path)], pa.string()), pa.array([rate], pa.float64())]
                for features in kernels.frame_features(x, order, *window_of(rate, window_ms, offset_ms)):
                    yield kernels.beside(row, names, features)

    return files.select("path", "content").mapInArrow(run, "path string, class_name string, sample_rate double, t int, r array<double>, status int")


def split_train_test(signals: DataFrame, fraction: float, class_col: str = "class_name", key_col: str = "path", min_per_class: int = 0, seed: str = "0") -> DataFrame:
    """Adds split: TRAIN, TEST, or predictors where a class is too small for the fraction.

    Within a class, in the order of a hash of key and seed, the rows up to and including place int(fraction * n) are TRAIN.
    Classes with fewer than min_per_class rows are left out. The ranks come from counts of hash buckets and ranks within
    a bucket, so a class that holds most rows does not meet in one task.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key_col).cast("string")))
    bucketed = signals.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    counts = bucketed.groupBy(class_col, "_b").agg(F.count("*").alias("_n"))
    cls = Window.partitionBy(class_col)
    ahead = counts.select(class_col, "_b", F.coalesce(F.sum("_n").over(cls.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(cls).alias("_total"))
    placed = bucketed.withColumn("_place", F.row_number().over(Window.partitionBy(class_col, "_b").orderBy("_h")) - 1).join(ahead, [class_col, "_b"])
    train = F.floor(F.lit(fraction) * F.col("_total"))
    split = F.when(train == 0, "predictors").when(F.col("_place") + F.col("_ahead") <= train, "TRAIN").otherwise("TEST")
    return placed.where(F.col("_total") >= min_per_class).select(*signals.columns, split.alias("split"))


def lpc_signals(signals: DataFrame, order: int, window_ms: int = 45, offset_ms: int = 15, sample_rate: float = 16000.0, fraction: float = 0.0, min_per_class: int = 0) -> DataFrame:
    """Grouping, minimum class size, split and features in one plan; write it with partitionBy("split", "class_name")."""
    width, step = window_of(sample_rate, window_ms, offset_ms)
    return lpc_frames(split_train_test(signals, fraction, min_per_class=min_per_class), order, width, step)


def show_frames(frames: DataFrame, first: int, last: int, reflections: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Coefficients first..last of each frame as text with 5 decimals (r columns, or k columns for reflections), after the columns to keep."""
    source, name = (hof.levinson(F.col("r"), last)["rc"], "k") if reflections else (F.col("r"), "r")
    first = max(first, 1) if reflections else first
    return frames.withColumn("_v", source).select(*(keep or []), *[F.format_string("%.5f", hof.at(F.col("_v"), i)).alias(f"{name}{i}") for i in range(first, last + 1)])
