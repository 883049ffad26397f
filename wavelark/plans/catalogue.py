"""The registered queries, one or more for each operator family, over the driver's tables. Doubles are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelark.functions import hof, kernels
from wavelark.operators import endpoint, evaluation, hmm, lpc, selection, vq
from wavelark.plans import fixtures as fx

P = fx.ORDER
_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _registry[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)


def r6(c: Column | str) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, r (gain-normalised), lp."""
    return lpc.features(fx.embedding_frames(spark, sf_dir), P)


# --- linear prediction ----------------------------------------------------------------------------


@_query
def lpc_autocorr(spark, d):  # noqa: ANN001, ANN201
    f = fx.embedding_frames(spark, d)
    return f.select("vec_id", F.posexplode(hof.autocorrelation(F.col("frame"), P)).alias("i", "r")).select("vec_id", "i", r6("r").alias("r"))


@_query
def lpc_levinson(spark, d):  # noqa: ANN001, ANN201
    f = features(spark, d)
    return f.select("vec_id", r6("lp.pe").alias("pe"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(P)), lambda k: F.struct(k.alias("k"), hof.at(F.col("lp.rc"), k).alias("rc"), hof.at(F.col("lp.a"), k).alias("a")))).alias("x")).select("vec_id", "x.k", r6("x.rc").alias("rc"), r6("x.a").alias("a"), "pe")


@_query
def lpc_stepup_raa(spark, d):  # noqa: ANN001, ANN201
    f = features(spark, d)
    return f.select("vec_id", F.posexplode(hof.reflections_to_raa(F.col("lp.rc"))).alias("n", "raa")).select("vec_id", "n", r6("raa").alias("raa"))


@_query
def lpc_gain_norm(spark, d):  # noqa: ANN001, ANN201
    return features(spark, d).select("vec_id", F.posexplode("r").alias("n", "v")).select("vec_id", "n", r6("v").alias("v"))


@_query
def lpc_show(spark, d):  # noqa: ANN001, ANN201
    return lpc.show_frames(features(spark, d), 0, 2, keep=["vec_id"])


@_query
def lpc_envelope(spark, d):  # noqa: ANN001, ANN201
    e = kernels.with_spectrum(features(spark, d).select("vec_id", F.col("lp.a").alias("a")), "a", 16, envelope=True, out="e")
    return e.select("vec_id", F.posexplode("e").alias("bin", "db")).select("vec_id", "bin", r6("db").alias("db"))


@_query
def frame_spectrum(spark, d):  # noqa: ANN001, ANN201
    e = kernels.with_spectrum(fx.embedding_frames(spark, d), "frame", 64, out="e")
    return e.select("vec_id", F.posexplode("e").alias("bin", "db")).select("vec_id", "bin", r6("db").alias("db"))


# --- framing -----------------------------------------------------------------------------------


def _frame_rows(frames: DataFrame) -> DataFrame:
    return frames.select("user_id", "t", r6(hof.at(F.col("frame"), 0)).alias("first"), r6(F.element_at("frame", -1)).alias("last"), F.size("frame").alias("cnt"))


@_query
def frame_sliding(spark, d):  # noqa: ANN001, ANN201
    return _frame_rows(lpc.frame_signals(fx.user_signals(spark, d), fx.WIDTH, fx.STEP))


@_query
def frame_sliding_window_fn(spark, d):  # noqa: ANN001, ANN201
    return _frame_rows(lpc.frame_rows(fx.user_samples(spark, d), ["user_id"], fx.WIDTH, fx.STEP))


@_query
def frame_preprocess(spark, d):  # noqa: ANN001, ANN201
    f = lpc.frame_signals(fx.user_signals(spark, d), fx.WIDTH, fx.STEP).withColumn("y", lpc.preprocessed(F.col("frame"), fx.WIDTH))
    return f.select("user_id", "t", r6(hof.sum_of(F.col("y"))).alias("total"), r6(F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v)).alias("energy"))


@_query
def preemphasis_lag(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("user_id").orderBy("pos")
    return fx.user_samples(spark, d).select("event_id", r6(F.col("x") - 0.95 * F.coalesce(F.lag("x").over(w), F.lit(0.0))).alias("y"))


# --- vector quantization -----------------------------------------------------------------------

BOOK2 = vq.initial_codebook(P)
BOOK4 = vq.grow(BOOK2)


@_query
def vq_distortion(spark, d):  # noqa: ANN001, ANN201
    ds = hof.let(F.col("r"), lambda r: F.transform(hof.matrix(BOOK2.raa), lambda c: hof.distortion(r, c)))
    return features(spark, d).select("vec_id", F.posexplode(ds).alias("codeword", "d")).select("vec_id", "codeword", r6("d").alias("d"))


@_query
def vq_initial_assign(spark, d):  # noqa: ANN001, ANN201
    return vq.cells(features(spark, d), BOOK2).select("codeword", "cardinality", r6("distortion").alias("distortion"))


@_query
def vq_min_dists(spark, d):  # noqa: ANN001, ANN201
    return vq.min_distances(features(spark, d), BOOK2, ["vec_id"]).select("vec_id", "codeword", r6("min_distortion").alias("min_distortion"))


@_query
def vq_quantize_seq(spark, d):  # noqa: ANN001, ANN201
    s = vq.quantize(features(spark, d), BOOK2, ["label"], t_col="vec_id")
    text = F.array_join(F.transform("symbols", lambda x: x.cast("string")), "")
    return s.select(F.col("label").cast("string").alias("label"), text.alias("symbols"), r6("avg_distortion").alias("avg_distortion")).unionByName(vq.overall_distortion(s).select(F.lit("all").alias("label"), F.lit("").alias("symbols"), r6("avg_distortion").alias("avg_distortion")))


@_query
def vq_cell_stats(spark, d):  # noqa: ANN001, ANN201
    # a codeword far from all frames stays empty
    book = vq.Codebook.of(np.vstack([BOOK2.rc, np.where(np.arange(P + 1) == 1, 0.999, 0.0)]))
    return vq.cell_report(features(spark, d), book).select("index", "cardinality", F.when(F.isnan("distortion"), None).otherwise(r6("distortion")).alias("distortion"))


@_query
def vq_centroid_update(spark, d):  # noqa: ANN001, ANN201
    book, _ = vq.centroids(BOOK2, vq.cells(features(spark, d), BOOK2).collect())  # a row a codeword
    return book.to_frame(spark).select("codeword", F.posexplode("rc").alias("k", "rc")).where("k > 0").select("codeword", "k", r6("rc").alias("rc"))


@_query
def vq_grow(spark, d):  # noqa: ANN001, ANN201
    return vq.grow(BOOK2).to_frame(spark).select("codeword", F.posexplode("raa").alias("n", "raa")).where("n < 3").select("codeword", "n", r6("raa").alias("raa"))


@_query
def vq_show(spark, d):  # noqa: ANN001, ANN201
    return vq.show_codebook(spark, BOOK4, 0, 3)


@_query
def vq_sigma(spark, d):  # noqa: ANN001, ANN201
    """All pairs of a cell and another codeword."""
    cells = vq.cells(features(spark, d), BOOK2).collect()  # a row a codeword
    book, sums = vq.centroids(BOOK2, cells)
    sigma = vq.sigma_ratio(sums, book, sum(c["distortion"] for c in cells) / sum(c["cardinality"] for c in cells))
    return spark.createDataFrame([(len(book) * (len(book) - 1), sigma)], "pairs long, sigma double").select("pairs", r6("sigma").alias("sigma"))


@_query
def vq_inertia(spark, d):  # noqa: ANN001, ANN201
    return vq.inertia(features(spark, d), BOOK2).select(r6("inertia").alias("inertia"))


@_query
def vq_lbg(spark, d):  # noqa: ANN001, ANN201
    out = list(vq.learn_codebook(features(spark, d), P, eps=0.05, max_size=16))
    return vq.training_report(spark, out).select("M", "passes", r6("avg_distortion").alias("avg_distortion"), r6("sigma").alias("sigma"), r6("inertia").alias("inertia"))


CLASS_BOOKS = [vq.Codebook.of(np.stack([np.where(np.arange(P + 1) == 1, s * a, 0.0) for s in (-1, 1)]), str(i)) for i, a in enumerate((0.1, 0.3, 0.6))]


@_query
def vq_classify(spark, d):  # noqa: ANN001, ANN201
    return vq.classify(features(spark, d), CLASS_BOOKS, ["label"]).select("label", "model_id", r6("score").alias("score"), "rank")


# --- Markov models ------------------------------------------------------------------------------


@_query
def seq_symbols(spark, d):  # noqa: ANN001, ANN201
    return fx.user_sequences(spark, d).select("user_id", "class_name", F.array_join(F.transform("symbols", lambda x: x.cast("string")), "").alias("symbols"))


@_query
def hmm_forward(spark, d):  # noqa: ANN001, ANN201
    return fx.user_sequences(spark, d).select("user_id", *[r6(hmm.log_likelihood(m)).alias(f"lp{i}") for i, m in enumerate(fx.MODELS)])


@_query
def hmm_viterbi(spark, d):  # noqa: ANN001, ANN201
    one = fx.user_sequences(spark, d).select("user_id", F.posexplode(F.array(*[hmm.viterbi(m) for m in fx.MODELS])).alias("model_id", "v"))
    return one.select("user_id", "model_id", r6("v.lp").alias("lp"), F.array_join(F.transform("v.path", lambda x: x.cast("string")), "").alias("path"))


@_query
def hmm_state_symbol_counts(spark, d):  # noqa: ANN001, ANN201
    return hmm.state_symbol_counts(fx.user_sequences(spark, d), fx.MODELS[1])


@_query
def hmm_estimate_b(spark, d):  # noqa: ANN001, ANN201
    return hmm.estimate_emissions(fx.user_sequences(spark, d), fx.MODELS[1]).select("state", "symbol", r6("p").alias("p"))


FLOOR_ROWS = [[0.0, 0.5, 0.5, 0.0], [0.001, 0.009, 0.49, 0.5], [0.25, 0.25, 0.25, 0.25], [1.0, 0.0, 0.0, 0.0], [0.01, 0.01, 0.01, 0.97]]


@_query
def hmm_floor_b(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame(list(enumerate(FLOOR_ROWS)), "state int, p array<double>")
    return rows.select("state", F.posexplode(hof.floor_row(F.col("p"), 0.01)).alias("symbol", "p")).select("state", "symbol", r6("p").alias("p"))


@_query
def hmm_em_step(spark, d):  # noqa: ANN001, ANN201
    return hmm.em_counts(fx.user_sequences(spark, d), fx.MODELS[0]).select("kind", "i", "j", r6("v").alias("v"))


@_query
def hmm_learn(spark, d):  # noqa: ANN001, ANN201
    _, history = hmm.learn(fx.user_sequences(spark, d), fx.MODELS[0], max_iterations=5, auto=0, estimate=False)
    return spark.createDataFrame([(i, float(round(lp, 6))) for i, lp in enumerate(history)], "iteration int, sum_log_prob double")


@_query
def hmm_check_stochastic(spark, d):  # noqa: ANN001, ANN201
    return hmm.stochastic_check(spark, fx.MODELS).select("model_id", "part", "row", r6("total").alias("total"), "bad")


def cases(spark: SparkSession, d: str) -> DataFrame:
    return hmm.classify(fx.user_sequences(spark, d), fx.MODELS, ["user_id"])


@_query
def hmm_classify(spark, d):  # noqa: ANN001, ANN201
    return cases(spark, d).select("user_id", "actual", "predicted", "correct", "rank", F.array_join("ranked", ">").alias("ranked"))


@_query
def hmm_show(spark, d):  # noqa: ANN001, ANN201
    return hmm.show_models(spark, fx.MODELS, "%.3f ")


@_query
def seq_show(spark, d):  # noqa: ANN001, ANN201
    out = hmm.show_sequences(fx.user_sequences(spark, d), ["user_id"], fx.MODELS[1])
    return out.withColumn("lp", r6("lp"))


@_query
def hmm_generate(spark, d):  # noqa: ANN001, ANN201
    g = hmm.generate(spark, fx.MODELS[1], 100, 40, seed=11)
    return g.select("seq", *[F.array_join(F.transform(c, lambda x: x.cast("string")), "").alias(c) for c in ("states", "symbols")])


# --- evaluation --------------------------------------------------------------------------------

CLASSES = [m.class_name for m in fx.MODELS]


@_query
def eval_confusion(spark, d):  # noqa: ANN001, ANN201
    out = evaluation.confusion(cases(spark, d), CLASSES)
    return out.select("actual", *[F.col(c).alias(f"as_{c}") for c in CLASSES], "tests", "errors")


@_query
def eval_candidate_order(spark, d):  # noqa: ANN001, ANN201
    return evaluation.candidate_order(cases(spark, d), len(CLASSES))


@_query
def eval_accuracy(spark, d):  # noqa: ANN001, ANN201
    c = cases(spark, d)
    per = evaluation.accuracy_by_class(c).select("class_name", "tests", "hits", r6("accuracy").alias("accuracy"), F.lit("").alias("json"))
    return per.unionByName(evaluation.accuracy(c).select(F.lit("TOTAL").alias("class_name"), "tests", "hits", r6("avg_accuracy").alias("accuracy"), "json"))


@_query
def eval_ranked_misses(spark, d):  # noqa: ANN001, ANN201
    return evaluation.ranked_misses(cases(spark, d), ["user_id"]).withColumn("candidates", F.array_join("candidates", ">"))


@_query
def eval_c12n(spark, d):  # noqa: ANN001, ANN201
    return evaluation.case_table(cases(spark, d), "user_id", len(CLASSES))


@_query
def eval_unmatched(spark, d):  # noqa: ANN001, ANN201
    s = fx.user_sequences(spark, d).withColumn("class_name", (F.col("user_id") % 5).cast("string"))
    return hmm.unmatched(s, fx.MODELS)


@_query
def split_train_test(spark, d):  # noqa: ANN001, ANN201
    rows = fx.embedding_frames(spark, d).select("vec_id", F.col("label").cast("string").alias("class_name"))
    return lpc.split_train_test(rows, 0.7, key_col="vec_id", min_per_class=5, seed="s").groupBy("class_name", "split").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


# --- endpoint detection ---------------------------------------------------------------------------


@_query
def epd_blocks(spark, d):  # noqa: ANN001, ANN201
    return endpoint.blocks(fx.typed_signals(spark, d)).select("path", "block", r6("mag").alias("mag"), "zc")


@_query
def epd_thresholds(spark, d):  # noqa: ANN001, ANN201
    return endpoint.thresholds(endpoint.blocks(fx.typed_signals(spark, d))).select("path", "izct", "itl", "itu")


@_query
def endpoint_detection(spark, d):  # noqa: ANN001, ANN201
    t = endpoint.trimmed(fx.typed_signals(spark, d))
    return t.select("path", "start", "length", r6("percent").alias("percent"))


@_query
def epd_summary(spark, d):  # noqa: ANN001, ANN201
    return endpoint.summary(endpoint.trimmed(fx.typed_signals(spark, d))).select("n", *[r6(c).alias(c) for c in ("avg_percent", "min_percent", "max_percent")])


@_query
def signal_stats(spark, d):  # noqa: ANN001, ANN201
    s = fx.user_signals(spark, d).withColumnRenamed("user_id", "path")
    return endpoint.signal_stats(s, 5, 30).select(F.col("path").alias("user_id"), *[r6(c).alias(c) for c in ("mean", "max", "min")])


# --- selections ----------------------------------------------------------------------------------


def codeword_rows(spark: SparkSession, d: str) -> DataFrame:
    """idx, codeword: the events' symbols in the order of time, as one quantized signal."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in fx.SYMBOLS.items() for x in kv]), F.col("event_type"))
    return fx.table(spark, d, "events").select(F.col("event_id").alias("idx"), code.alias("codeword"))


@_query
def sel_codeword_counts(spark, d):  # noqa: ANN001, ANN201
    return selection.codeword_counts(codeword_rows(spark, d))


@_query
def sel_interval_frames(spark, d):  # noqa: ANN001, ANN201
    return selection.interval_frames(codeword_rows(spark, d), 1234, 605, 15, 16000.0).select("idx", "codeword", long("ms").alias("ms"))


@_query
def sel_mask_samples(spark, d):  # noqa: ANN001, ANN201
    s = fx.user_samples(spark, d)
    frames = s.where("pos % 4 = 0").select("user_id", F.floor(F.col("pos") / 4).cast("int").alias("idx"), F.element_at(F.create_map(*[F.lit(x) for kv in fx.SYMBOLS.items() for x in kv]), F.col("event_type")).alias("codeword"))
    masked = selection.masked_samples(s.select("user_id", "pos", "x"), frames, [1, 3], 4, 6, ["user_id"])
    return masked.groupBy("user_id").agg(r6(F.sum("x")).alias("total"), F.count_if(F.col("x") == 0).alias("zeros"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    start = e.agg(F.min("ts").alias("t0"))
    s = e.crossJoin(F.broadcast(start))  # one row
    begin = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("ts")) / F.lit(1e6)
    return s.select((F.col("event_id") + 1).cast("int").alias("selection"), begin.alias("begin_s"), (begin + 1).alias("end_s"), F.col("event_type").alias("type"), "user_id")


def numbered_cases(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).withColumn("seq_filename", F.concat(F.lit("data/s/"), (F.col("user_id") * 7).cast("string"), F.lit(".seq")))


@_query
def sel_segments_join(spark, d):  # noqa: ANN001, ANN201
    j = selection.with_segments(numbered_cases(spark, d), segments(spark, d).drop("user_id"))
    return j.select("user_id", "selection", "rank", "type", r6("begin_s").alias("begin_s"))


@_query
def sel_cover(spark, d):  # noqa: ANN001, ANN201
    s = segments(spark, d)
    return selection.cover(s).select("min_selection", "max_selection", r6("begin_s").alias("begin_s"), r6("end_s").alias("end_s"), r6("duration_s").alias("duration_s"))


@_query
def sel_contained(spark, d):  # noqa: ANN001, ANN201
    return selection.contained(segments(spark, d), 3600.0, 864000.0).select("selection", r6("begin_s").alias("begin_s"))


@_query
def sel_interval_join(spark, d):  # noqa: ANN001, ANN201
    """Each user's symbols as frames of 0.01 s, and the frames that start within each of the user's five intervals."""
    frames = fx.user_samples(spark, d).select("user_id", F.col("pos").alias("idx"), "event_type")
    marks = fx.user_samples(spark, d).where("pos < 5").select("user_id", (F.col("pos") * 0.05).alias("begin_s"), (F.col("pos") * 0.05 + 0.123).alias("end_s"), F.col("pos").alias("mark"))
    return selection.frames_in_intervals(frames, marks, ["user_id"], 0.01).select("user_id", "mark", "idx", "event_type")


@_query
def eval_error_rate(spark, d):  # noqa: ANN001, ANN201
    return evaluation.accuracy(cases(spark, d)).select(r6("error_rate").alias("error_rate"))


@_query
def vq_report(spark, d):  # noqa: ANN001, ANN201
    f = features(spark, d).withColumn("class_name", (F.col("label") % 3).cast("string")).withColumnRenamed("label", "seq")
    scored = vq.classify(f, CLASS_BOOKS, ["seq", "class_name"])
    return evaluation.candidate_order(vq.classified(scored, CLASS_BOOKS, ["seq"]), len(CLASS_BOOKS))


@_query
def sel_times(spark, d):  # noqa: ANN001, ANN201
    return selection.times(segments(spark, d), "selection", "user_id").select("selection", r6("concat_s").alias("concat_s"), r6("offset_s").alias("offset_s"))


@_query
def sel_label(spark, d):  # noqa: ANN001, ANN201
    return selection.labels(cases(spark, d).withColumn("selection", F.col("user_id")), "actual")


@_query
def sel_hist(spark, d):  # noqa: ANN001, ANN201
    return selection.histogram(fx.table(spark, d, "events"), "value", 20)


@_query
def sel_dense_ranks(spark, d):  # noqa: ANN001, ANN201
    rows = cases(spark, d).select((F.col("user_id") % 50).cast("int").alias("selection"), "rank", F.col("user_id").alias("ordinal"))
    return selection.dense_ranks(rows, 0, 60)


@_query
def sel_signal_interval(spark, d):  # noqa: ANN001, ANN201
    rows = fx.user_signals(spark, d).select("user_id", ((F.col("user_id") % 20) * 0.002).alias("begin_s"))
    rows = rows.withColumn("end_s", F.col("begin_s") + 0.045)
    out = selection.signal_intervals(rows, fx.user_signals(spark, d), ["user_id"], 1000.0)
    return out.select("user_id", F.size("samples").alias("n"), r6(hof.sum_of(F.col("samples"))).alias("total"))


@_query
def sel_title(spark, d):  # noqa: ANN001, ANN201
    return selection.title(cases(spark, d)).select("user_id", "title")


@_query
def pos_join(spark, d):  # noqa: ANN001, ANN201
    f = features(spark, d)
    refl = f.select(F.col("vec_id").alias("ordinal"), hof.at(F.col("lp.rc"), 1).alias("k1"), hof.at(F.col("lp.rc"), 2).alias("k2"))
    dist = vq.min_distances(f, BOOK2, ["vec_id"]).withColumnRenamed("vec_id", "ordinal")
    return selection.by_distortion(selection.positional_join(refl, dist), 0.25).select("ordinal", r6("k1").alias("k1"), r6("k2").alias("k2"), "codeword")


# --- strings ------------------------------------------------------------------------------------


@_query
def path_functions(spark, d):  # noqa: ANN001, ANN201
    u = F.col("url")
    return fx.table(spark, d, "pages").select("page_id", hof.class_of_path(u).alias("class_name"), hof.simple_name(u).alias("simple"), hof.change_extension(u, ".prd").alias("renamed"), hof.output_path(u, "predictors/P8", ".prd").alias("out"))


DURATIONS = ["1h57m39.828s", "2m", "15s", "0.25s", "3h", "1h5s", "abc", "", "10m30s", "59.999s", "7", "1m1h"]


@_query
def duration_parse(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(DURATIONS)], "i int, text string")
    ms = hof.duration_ms(F.col("text"))
    return rows.select("i", "text", ms.alias("ms"), hof.elapsed_text(ms / 1000.0).alias("elapsed"))


@_query
def seq_render(spark, d):  # noqa: ANN001, ANN201
    return fx.user_sequences(spark, d).select("user_id", hof.abbreviated(F.col("symbols")).alias("text"))
