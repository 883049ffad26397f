"""Endpoint detection on 10 ms blocks: magnitudes and zero crossings against thresholds taken from the first 10 blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions import hof

LEAD = 10
REACH = 25


def blocks(signals: DataFrame, key: str = "path", samples_col: str = "samples") -> DataFrame:
    """key, block, mag (sum of magnitudes), zc (sign changes), len, n_blocks, of signals of a fifth of a second or more."""
    x = F.col(samples_col)
    scaled = hof.let(F.array_max(x), lambda big: F.transform(x, lambda v, i: F.when((i == 0) | (big >= 4096) | (big == 0), v).otherwise(4096.0 * v / F.nullif(big, F.lit(0.0)))))
    size = F.floor(F.col("sample_rate").cast("int") / 100).cast("int")
    ready = signals.where(F.size(x) >= F.floor(F.col("sample_rate").cast("long") / 5)).select(key, F.size(x).alias("n"), size.alias("len"), hof.preemphasize(scaled).alias("y"))
    ready = ready.withColumn("n_blocks", F.floor(F.col("n") / F.col("len")).cast("int") - 1).where("n_blocks > 0")
    cut = hof.let(F.struct("y", "len"), lambda s: F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: F.slice(s["y"], b * s["len"] + 1, s["len"])))
    mag = F.aggregate("v", F.lit(0.0), lambda s, v: s + F.abs(v))
    sign = F.transform("v", lambda v: (v >= 0).cast("int"))
    zc = F.aggregate(F.zip_with(F.slice(sign, F.lit(1), F.size("v") - 1), F.slice(sign, F.lit(2), F.size("v") - 1), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    return ready.select(key, "len", "n_blocks", F.posexplode(cut).alias("block", "v")).select(key, "block", "len", "n_blocks", mag.alias("mag"), zc.alias("zc"))


def thresholds(block_rows: DataFrame, key: str = "path") -> DataFrame:
    """key, len, n_blocks, izct, itl, itu."""
    lead = F.col("block") < LEAD

    def two_sigma(c: str):  # noqa: ANN202
        total, squares = F.sum(F.when(lead, F.col(c).cast("double"))), F.sum(F.when(lead, F.col(c).cast("double") * F.col(c)))
        mean = total / LEAD
        return mean + 2 * F.sqrt(F.greatest(squares / LEAD - mean * mean, F.lit(0.0)))

    per = block_rows.groupBy(key).agg(F.first("len").alias("len"), F.first("n_blocks").alias("n_blocks"), two_sigma("zc").alias("z"), F.greatest(F.lit(12.0), two_sigma("mag")).alias("imn"), F.max(F.when(~lead, F.col("mag"))).alias("imx"))
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    itl = F.least(half_up(0.03 * (F.col("imx") - F.col("imn")) + F.col("imn")), half_up(4 * F.col("imn")))
    return per.where("imx is not null").select(key, "len", "n_blocks", F.least(F.lit(25), F.greatest(F.lit(9), half_up(F.col("z")))).alias("izct"), itl.alias("itl"), (5 * itl).alias("itu"))


def endpoints(signals: DataFrame, key: str = "path", samples_col: str = "samples") -> DataFrame:
    """key, izct, itl, itu, start, length in samples, for signals in which an utterance is found.

    Blocks at or above the lower threshold form islands; the first and the last island that reach the upper threshold bound
    the utterance, and runs of many zero crossings just outside widen it.
    """
    rows = blocks(signals, key, samples_col)
    limits = thresholds(rows, key)
    after = rows.drop("len", "n_blocks").join(limits, key).where(F.col("block") >= LEAD).withColumn("m", F.col("block") - LEAD).withColumn("last", F.col("n_blocks") - LEAD - 1)
    by_signal = Window.partitionBy(key).orderBy("m")
    islands = after.where("mag >= itl").withColumn("island", F.col("m") - F.row_number().over(by_signal))
    islands = islands.groupBy(key, "island").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.min(F.when(F.col("mag") >= F.col("itu"), F.col("m"))).alias("first_loud"), F.max(F.when(F.col("mag") >= F.col("itu"), F.col("m"))).alias("last_loud"), F.first("last").alias("last"))
    loud = islands.where("first_loud is not null")
    first = loud.groupBy(key).agg(F.min_by(F.struct("a", "first_loud"), "a").alias("s"))
    last = loud.where("b > 0 and last_loud > 0").groupBy(key).agg(F.max_by(F.struct("b", "last_loud", "last"), "b").alias("e"))
    n1 = F.when((F.col("s.a") == F.col("s.first_loud")) & (F.col("s.a") > 0), F.col("s.a") - 1).otherwise(F.col("s.a"))
    n2 = F.when((F.col("e.b") == F.col("e.last_loud")) & (F.col("e.b") < F.col("e.last") - 1), F.col("e.b") + 1).otherwise(F.col("e.b"))
    rough = first.join(last, key).select(key, n1.alias("n1"), n2.alias("n2"))
    near = after.join(rough, key)
    crossing = F.col("zc") >= F.col("izct")
    before = crossing & F.col("m").between(F.greatest(F.col("n1") - REACH, F.lit(0)), F.col("n1"))
    behind = crossing & F.col("m").between(F.col("n2"), F.least(F.col("n2") + REACH, F.col("last")))
    fine = near.groupBy(key, "len", "izct", "itl", "itu", "n1", "n2").agg(F.count_if(before).alias("nb"), F.min(F.when(before, F.col("m"))).alias("mb"), F.count_if(behind).alias("ne"), F.max(F.when(behind, F.col("m"))).alias("me"))
    a, b = F.when(F.col("nb") >= 3, F.col("mb")).otherwise(F.col("n1")), F.when(F.col("ne") >= 3, F.col("me")).otherwise(F.col("n2"))
    return fine.select(key, "izct", "itl", "itu", (F.col("len") * (a + LEAD)).cast("long").alias("start"), (F.col("len") * (b - a)).cast("long").alias("length"))


def trimmed(signals: DataFrame, key: str = "path", samples_col: str = "samples") -> DataFrame:
    """Signals cut to their utterance, with start, length, percent kept and the output name."""
    found = endpoints(signals, key, samples_col).select(key, "start", "length")
    cut = F.slice(samples_col, (F.col("start") + 1).cast("int"), F.greatest(F.col("length"), F.lit(0)).cast("int"))
    out = signals.join(found, key).withColumn("percent", 100.0 * F.col("length") / F.size(samples_col))
    return out.withColumn(samples_col, cut).withColumn("out_name", F.format_string("%s__S%d_L%d$.wav", F.regexp_replace(key, r"\.[^./]*$", ""), "start", "length"))


def summary(cut: DataFrame) -> DataFrame:
    return cut.agg(F.count("*").alias("n"), F.avg("percent").alias("avg_percent"), F.min("percent").alias("min_percent"), F.max("percent").alias("max_percent"))


def signal_stats(signals: DataFrame, first: int, last: int, key: str = "path", samples_col: str = "samples", compat: bool = True) -> DataFrame:
    """Mean, maximum and minimum of samples first..last. compat: the mean divides by the whole number of samples."""
    rows = signals.select(key, F.size(samples_col).alias("n"), F.posexplode(samples_col).alias("pos", "v")).where(F.col("pos").between(first, last))
    mean = F.sum("v") / (F.first("n") if compat else F.count("*"))
    return rows.groupBy(key).agg(mean.alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))
