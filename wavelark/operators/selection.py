"""Selections of quantized signals: intervals, segments, masks, labels, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions import hof


def codeword_counts(codewords: DataFrame) -> DataFrame:
    return codewords.groupBy("codeword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "codeword")


def codebook_size(codewords: DataFrame) -> DataFrame:
    return codewords.agg((F.max("codeword") + 1).alias("size"))


def interval_frames(frames: DataFrame, start_ms: int, duration_ms: int, offset_ms: int, sample_rate: float) -> DataFrame:
    """Frames idx of an interval, with the time of each: a range predicate on idx, which a scan can push down."""
    step = int(offset_ms * sample_rate / 1000)
    first = int(start_ms * sample_rate / 1000 // 1) // step
    n = -(-duration_ms // offset_ms)
    return frames.where((F.col("idx") >= first) & (F.col("idx") < first + n)).withColumn("ms", F.lit(start_ms) + (F.col("idx") - first) * offset_ms)


def frames_in_intervals(frames: DataFrame, intervals: DataFrame, keys: list[str], offset_s: float) -> DataFrame:
    """Frames (keys, idx) with each interval (keys, begin_s, end_s) of a table that their start lies in, and its columns.

    An interval is expanded into the frame numbers it holds, so the range condition is an equi-join on keys and idx.
    """
    first, last = F.ceil(F.round(F.col("begin_s") / F.lit(offset_s), 9)).cast("long"), F.ceil(F.round(F.col("end_s") / F.lit(offset_s), 9)).cast("long") - 1
    held = intervals.withColumn("idx", F.explode(F.when(last >= first, F.sequence(first, last))))
    return frames.withColumn("idx", F.col("idx").cast("long")).join(held, [*keys, "idx"])


def contained(rows: DataFrame, begin_s: float, end_s: float) -> DataFrame:
    """Rows whose interval lies within begin_s and end_s, ends included."""
    return rows.where((F.col("begin_s") >= begin_s) & (F.col("end_s") <= end_s))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a selection number, which is above 0."""
    return rows.where(F.col("selection") > 0)


def sample_rows(rows: DataFrame, most: int = 8000, seed: int = 0) -> DataFrame:
    """All rows, or `most` random ones: the least by a seeded hash of the row, so each task keeps that many at most."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.orderBy(F.xxhash64(F.lit(seed), row), F.to_json(row)).limit(most)


def unique_codewords(frames: DataFrame) -> DataFrame:
    return frames.select("codeword").distinct()


def range_of_samples(samples: Column, start_ms: Column | int, duration_ms: Column | int, sample_rate: float) -> Column:
    """The samples from floor(start) on, ceil(duration) many."""
    ms = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.slice(samples, (F.floor(ms(start_ms) * F.lit(sample_rate) / 1000) + 1).cast("int"), F.ceil(ms(duration_ms) * F.lit(sample_rate) / 1000).cast("int"))


def masked_samples(samples: DataFrame, frames: DataFrame, codewords: list[int], step: int, width: int, keys: list[str]) -> DataFrame:
    """Samples that no frame of the wanted codewords covers become 0.

    A sample lies in at most ceil(width / step) frames, so a frame is expanded into the steps it covers and the range
    condition becomes an equi-join on keys and step, with an exact check at the edges.
    """
    reach = -(-width // step)
    wanted = frames.where(F.col("codeword").isin(codewords)).select(*keys, "idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + reach - 1)).alias("_step"))
    tail = width - (reach - 1) * step
    wanted = wanted.select(*keys, "_step", F.when(F.col("_step") == F.col("idx") + reach - 1, tail).otherwise(step).alias("_upto")).groupBy(*keys, "_step").agg(F.max("_upto").alias("_upto"))
    placed = samples.withColumn("_step", F.floor(F.col("pos") / step).cast("int"))
    joined = placed.join(wanted, [*keys, "_step"], "left")
    return joined.withColumn("x", F.when((F.col("pos") % step) < F.col("_upto"), F.col("x")).otherwise(0.0)).drop("_step", "_upto")


def with_segments(cases: DataFrame, segments: DataFrame, path_col: str = "seq_filename") -> DataFrame:
    """Cases with their segment, found by the selection number in the path; cases without one keep nulls."""
    first = segments.withColumn("_n", F.row_number().over(Window.partitionBy("selection").orderBy("begin_s", "end_s"))).where("_n = 1").drop("_n")
    return cases.withColumn("selection", hof.selection_number(F.col(path_col))).join(first, "selection", "left")


def cover(rows: DataFrame) -> DataFrame:
    """The least and greatest selection, and the time from the first one's begin to the last one's end."""
    out = rows.agg(F.min("selection").alias("min_selection"), F.max("selection").alias("max_selection"), F.min_by("begin_s", "selection").alias("begin_s"), F.max_by("end_s", "selection").alias("end_s"))
    return out.withColumn("duration_s", F.col("end_s") - F.col("begin_s"))


def times(rows: DataFrame, order: str, key: str) -> DataFrame:
    """Start of each row when rows follow each other without gaps, and its begin relative to the first one."""
    w = Window.partitionBy(key).orderBy(order)
    elapsed = F.col("end_s") - F.col("begin_s")
    return rows.withColumn("concat_s", F.coalesce(F.sum(elapsed).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("offset_s", F.col("begin_s") - F.first("begin_s").over(w))


def labels(cases: DataFrame, key: str, class_given: bool = False, most: int = 140) -> DataFrame:
    """selection, rank, color, height of the bar, label."""
    w = Window.partitionBy(key)
    short = F.lit("") if class_given else F.col("actual")
    long = F.concat(F.col("predicted"), F.lit(">"), F.col("rank").cast("string"), *([] if class_given else [F.lit(":"), F.col("actual")]))
    text = F.concat(F.when(F.col("rank") == 1, short).otherwise(long), F.lit("#"), F.col("selection").cast("string"))
    return cases.select(key, "selection", "rank", hof.rank_color(F.col("rank")).alias("color"), (F.max("rank").over(w) - F.col("rank") + 1).alias("height"), F.when(F.count("*").over(w) > most, "").otherwise(text).alias("label"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between the least and greatest value; the last bin is closed."""
    edges = values.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    return values.crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # edges: one row


def dense_ranks(rows: DataFrame, first: int, last: int) -> DataFrame:
    """selection, rank for every selection first..last; 0 where there is none, the last value where there are several."""
    grid = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("selection"))
    return grid.join(rows.groupBy("selection").agg(F.max_by("rank", "ordinal").alias("rank")), "selection", "left").fillna(0, ["rank"])


def positional_join(left: DataFrame, right: DataFrame, on: str = "ordinal") -> DataFrame:
    """Tables of equal length side by side, by an explicit ordinal."""
    return left.join(right, on)


def expand_ranges(spark, parts: list[str]) -> DataFrame:  # noqa: ANN001
    """`3` and `5-9` to sorted selection numbers."""
    rows = [tuple(int(x) for x in (p.split("-") * 2)[:2]) if "-" not in p else tuple(map(int, p.split("-"))) for p in parts]
    return spark.createDataFrame(rows, "a int, b int").select(F.explode(F.sequence("a", "b")).alias("selection")).orderBy("selection")


def individual(cases: DataFrame, segments: DataFrame, spark, ranges: list[str], class_name: str | None = None, most: int | None = None) -> DataFrame:  # noqa: ANN001
    """The first cases of the wanted selections, with their segments."""
    wanted = F.broadcast(expand_ranges(spark, ranges))
    rows = with_segments(cases, segments).join(wanted, "selection", "left_semi")
    if class_name is not None:
        rows = rows.where(F.col("seq_class_name") == class_name)
    rows = rows.orderBy("selection")
    return rows.limit(most) if most is not None else rows


def concatenated(rows: DataFrame, key: str, ordinal: str, samples: str) -> DataFrame:
    """One array of the rows' samples, in order."""
    return rows.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, samples))), lambda x: x[samples])).alias(samples))


def share_correct(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"), (100.0 * F.count_if("correct") / F.nullif(F.count("*"), F.lit(0))).alias("percent"))


def by_distortion(rows: DataFrame, limit: float, above: bool = False) -> DataFrame:
    return rows.where(F.col("min_distortion") > limit if above else F.col("min_distortion") <= limit)


def signal_intervals(rows: DataFrame, signals: DataFrame, on: list[str], sample_rate: float, samples_col: str = "samples") -> DataFrame:
    """The samples of each row's interval (begin_s, end_s); intervals that do not end within the signal are left out."""
    # in samples and rounded: 0.036 + 0.045 s is a little under 0.081 s
    joined = rows.join(signals, on).where(F.round(F.col("end_s") * F.lit(sample_rate), 6) < F.size(samples_col))
    return joined.withColumn(samples_col, range_of_samples(F.col(samples_col), F.round(F.col("begin_s") * 1000, 6), F.round((F.col("end_s") - F.col("begin_s")) * 1000, 6), sample_rate))


def covering_interval(rows: DataFrame, max_seconds: float | None = None) -> DataFrame:
    """begin_s and duration_s of the interval from the first selection's begin to the last one's end, cut at max_seconds."""
    out = cover(rows)
    if max_seconds is not None:
        out = out.withColumn("duration_s", F.least("duration_s", F.lit(float(max_seconds))))
    return out.select("begin_s", "duration_s")


def title(cases: DataFrame) -> DataFrame:
    """The models ranked down to the right one, as text."""
    return cases.withColumn("title", F.array_join(F.slice("ranked", F.lit(1), F.col("rank")), ", "))
