"""Structured Streaming: symbols scored online, and frames quantized as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavelark.operators.hmm import Hmm
from wavelark.operators.vq import Codebook, assigned


def online_log_likelihood(symbols: DataFrame, model: Hmm, key: str, order: str, symbol: str = "o") -> DataFrame:
    """key, n, lp after each micro-batch. The state of a key is its scaled forward vector, so it does not grow with the stream."""
    pi, trans, emit = model.pi, model.trans, model.emit

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, lp, al = state.get if state.exists else (0, 0.0, None)
        al = None if al is None else np.array(al)
        for o in pd.concat(list(batches)).sort_values(order)[symbol]:
            raw = (pi if al is None else al @ trans) * emit[:, int(o)]
            c = raw.sum()
            lp, al, n = (lp + float(np.log(c)), raw / c, n + 1) if c > 0 else (float("-inf"), np.zeros_like(raw), n + 1)
        state.update((n, lp, None if al is None else al.tolist()))
        yield pd.DataFrame({key: [k[0]], "n": [n], "lp": [lp]})

    kind = symbols.schema[key].dataType.simpleString()
    return symbols.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, lp double", "n long, lp double, al array<double>", "update", GroupStateTimeout.NoTimeout)


def quantized(frames: DataFrame, book: Codebook, r_col: str = "r") -> DataFrame:
    """A stream of frames with codeword and distortion: stateless, so it runs as the batch plan does."""
    return assigned(frames, book, r_col).withColumn("codeword", F.col("near.i")).withColumn("d", F.col("near.d")).drop("near")


def block_energy(samples: DataFrame, key: str, time: str, value: str, length: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Magnitude sums of tumbling blocks of event time, with a watermark for late samples."""
    return samples.withWatermark(time, late).groupBy(key, F.window(time, length).alias("block")).agg(F.sum(F.abs(F.col(value))).alias("mag"), F.count("*").alias("n")).select(key, F.col("block.start").alias("start"), "mag", "n")
