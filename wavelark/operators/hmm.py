"""Discrete hidden Markov models: initial models, scoring, decoding, training, classification, sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions import hof, kernels

EPSILON = 1e-5
#: Models with more states go through Arrow.
NATIVE_STATES = 8


@dataclass
class Hmm:
    pi: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    class_name: str = ""
    kind: str = ""

    @classmethod
    def of(cls, pi, trans, emit, class_name: str = "", kind: str = "") -> Hmm:  # noqa: ANN001
        return cls(np.asarray(pi, float), np.asarray(trans, float), np.asarray(emit, float), class_name, kind)

    @property
    def columns(self) -> tuple[Column, Column, Column]:
        return hof.doubles(self.pi), hof.matrix(self.trans), hof.matrix(self.emit)

    @property
    def log_columns(self) -> tuple[Column, Column, Column]:
        """The C library's logarithms: Java's differ in the last bit for some numbers (0.18), and paths of equal likelihood with them."""
        ln = np.vectorize(lambda p: math.log(p) if p > 0 else -math.inf, otypes=[float])
        return hof.doubles(ln(self.pi)), hof.matrix(ln(self.trans)), hof.matrix(ln(self.emit))


def random_rows(rng: np.random.Generator, rows: int, size: int) -> np.ndarray:
    """Rows of 1 + a uniform number, normalised: nothing is near 0."""
    x = rng.random((rows, size)) + 1
    return x / x.sum(axis=1, keepdims=True)


def initial_transitions(rng: np.random.Generator, kind: str, states: int, i: int) -> np.ndarray:
    """Row i of a new model's transitions."""
    row = np.zeros(states)
    if kind == "uniform":
        return np.full(states, 1.0 / states)
    end = min(states, i + {"cascade2": 2, "cascade3": 3}[kind]) if kind in ("cascade2", "cascade3") else states
    first = i if kind in ("cascade2", "cascade3") else 0
    row[first:end] = random_rows(rng, 1, end - first)[0]
    return row


def initial_model(states: int, symbols: int, kind: str = "cascade3", seed: int = 0, class_name: str = "") -> Hmm:
    """kind: random, uniform, cascade2 or cascade3 (from a state only to itself and the next one or two)."""
    rng = np.random.default_rng(seed)
    if kind == "uniform":
        flat = lambda n: np.full(n, 1.0 / n)
        return Hmm.of(flat(states), np.tile(flat(states), (states, 1)), np.tile(flat(symbols), (states, 1)), class_name, kind)
    emit = random_rows(rng, states, symbols)
    if kind == "random":
        return Hmm.of(random_rows(rng, 1, states)[0], random_rows(rng, states, states), emit, class_name, kind)
    width = {"cascade2": 2, "cascade3": 3}[kind]
    trans = np.zeros((states, states))
    for i in range(states):
        n = min(states - i, width)
        trans[i, i : i + n] = random_rows(rng, 1, n)[0]
    pi = np.zeros(states)
    pi[: min(states, width)] = random_rows(rng, 1, min(states, width))[0]
    return Hmm.of(pi, trans, emit, class_name, kind)


def floor_emissions(emit: np.ndarray, eps: float = EPSILON) -> np.ndarray:
    """No emission below eps; the excess comes from those above it, in proportion."""
    if eps <= 0:
        return emit
    if emit.shape[1] * eps >= 1:
        raise ValueError("eps is too large for so many symbols")
    low, spare = np.maximum(eps - emit, 0).sum(axis=1), np.maximum(emit - eps, 0).sum(axis=1)
    q = np.where(spare > 0, low / np.where(spare > 0, spare, 1), 0)[:, None]
    return np.where(emit <= eps, eps, emit - (emit - eps) * q)


def log_likelihood(model: Hmm, symbols: Column | str = "symbols", native: bool | None = None) -> Column:
    symbols = F.col(symbols) if isinstance(symbols, str) else symbols
    if native if native is not None else len(model.pi) <= NATIVE_STATES:
        return hof.log_likelihood(symbols, *model.columns)
    return hof.at(kernels.log_likelihood([(model.pi, model.trans, model.emit)])(symbols), 0)


def viterbi(model: Hmm, symbols: Column | str = "symbols") -> Column:
    return hof.viterbi(F.col(symbols) if isinstance(symbols, str) else symbols, *model.log_columns)


def conforming(sequences: DataFrame, n_symbols: int, symbols_col: str = "symbols") -> DataFrame:
    """Sequences that are not empty, have no symbol beyond the alphabet and, where they tell theirs (n_symbols), have that one."""
    if "n_symbols" in sequences.columns:
        sequences = sequences.where(F.col("n_symbols") == n_symbols)
    return sequences.where((F.size(symbols_col) > 0) & (F.array_max(symbols_col) < n_symbols) & (F.array_min(symbols_col) >= 0))


def state_symbol_counts(sequences: DataFrame, model: Hmm, symbols_col: str = "symbols") -> DataFrame:
    """state, symbol, n over the most likely paths."""
    path = viterbi(model, symbols_col)["path"]
    return sequences.select(F.explode(F.arrays_zip(path.alias("state"), F.col(symbols_col).alias("symbol"))).alias("x")).groupBy(F.col("x.state").alias("state"), F.col("x.symbol").alias("symbol")).agg(F.count("*").alias("n"))


def estimate_emissions(sequences: DataFrame, model: Hmm, symbols_col: str = "symbols") -> DataFrame:
    """state, symbol, p for the whole grid; a state that emits nothing is uniform."""
    n, m = model.emit.shape
    spark = sequences.sparkSession
    grid = spark.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("state"), (F.col("id") % m).cast("int").alias("symbol"))
    counts = grid.join(F.broadcast(state_symbol_counts(sequences, model, symbols_col)), ["state", "symbol"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("state"))
    return counts.select("state", "symbol", F.when(total == 0, F.lit(1.0 / m)).otherwise(F.col("n") / F.nullif(total, F.lit(0))).alias("p"))


def _estep(model: Hmm):
    pi, trans, emit = model.pi, model.trans, model.emit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = emit.shape
        ta, tb, da, lp, dead = np.zeros((n, n)), np.zeros((n, m)), np.zeros(n), 0.0, 0
        for batch in batches:
            for o in batch.column(0).to_pylist():
                a, b, d, one = kernels.expected_counts(np.asarray(o), pi, trans, emit)
                if one == float("-inf"):
                    dead += 1
                    continue
                ta, tb, da, lp = ta + a, tb + b, da + d, lp + one
        i, j = np.indices(ta.shape)
        si, sj = np.indices(tb.shape)
        kind = ["a"] * ta.size + ["b"] * tb.size + ["lp", "dead"]
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array([*i.ravel(), *si.ravel(), 0, 0], pa.int32()), pa.array([*j.ravel(), *sj.ravel(), 0, 0], pa.int32()), pa.array([*ta.ravel(), *tb.ravel(), lp, float(dead)], pa.float64())], ["kind", "i", "j", "v"])

    return run


def em_counts(sequences: DataFrame, model: Hmm, symbols_col: str = "symbols") -> DataFrame:
    """Expected counts over all sequences: kind (a, b, lp, dead), i, j, v. A partition sends one partial sum."""
    return sequences.select(symbols_col).mapInArrow(_estep(model), "kind string, i int, j int, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v"))


def _spread(rng: np.random.Generator, row: np.ndarray) -> np.ndarray:
    """Random shares for what the row allows."""
    new = np.where(row > 0, rng.random(len(row)) + 1, 0.0)
    return new / new.sum() if new.any() else np.full(len(row), 1.0 / len(row))


def em_step(sequences: DataFrame, model: Hmm, eps: float = EPSILON, symbols_col: str = "symbols", seed: int = 0) -> tuple[Hmm, float, int]:
    """The re-estimated model (pi stays), log P of the data under the old one, and the number of sequences it can't emit."""
    n, m = model.emit.shape
    ta, tb, lp, dead = np.zeros((n, n)), np.zeros((n, m)), 0.0, 0
    for r in em_counts(sequences, model, symbols_col).collect():  # n * n + n * m rows
        if r["kind"] == "a":
            ta[r["i"], r["j"]] = r["v"]
        elif r["kind"] == "b":
            tb[r["i"], r["j"]] = r["v"]
        elif r["kind"] == "lp":
            lp = r["v"]
        else:
            dead = int(r["v"])
    rng = np.random.default_rng(seed)
    da, db = ta.sum(axis=1), tb.sum(axis=1)
    # a state that is never left gets a new row, of the model's kind where that is known
    again = np.array([initial_transitions(rng, model.kind, n, i) if model.kind else _spread(rng, model.trans[i]) for i in range(n)])
    trans = np.where((da > 0)[:, None], ta / np.where(da > 0, da, 1)[:, None], again)
    emit = np.where((db > 0)[:, None], tb / np.where(db > 0, db, 1)[:, None], random_rows(rng, n, m))
    return replace(model, trans=trans, emit=floor_emissions(emit, eps)), lp, dead


def learn(sequences: DataFrame, model: Hmm, eps: float = EPSILON, auto: float = 0.3, max_iterations: int = 100, estimate: bool = True, symbols_col: str = "symbols", callback=None) -> tuple[Hmm, list[float]]:  # noqa: ANN001
    """Trains a model; returns it and the log P before each step and after the last one.

    Stops after max_iterations steps, where log P reaches 0, or where it changes by no more than |ln auto| (auto of 0 or less:
    never for that reason). The sequences are read from memory; a step is one job and returns one row a parameter.
    """
    kept = conforming(sequences, model.emit.shape[1], symbols_col).select(symbols_col).persist()
    try:
        if estimate:
            emit = np.zeros_like(model.emit)
            for r in estimate_emissions(kept, model, symbols_col).collect():
                emit[r["state"], r["symbol"]] = r["p"]
            model = replace(model, emit=floor_emissions(emit, eps))
        history: list[float] = []
        limit = abs(math.log(auto)) if auto > 0 else -1.0
        for step in range(max_iterations + 1):
            new, lp, _ = em_step(kept, model, eps, symbols_col, seed=step)
            history.append(lp)
            if callback:
                callback("sum_log_prob", lp)
            if step == max_iterations or lp >= 0 or (len(history) > 1 and abs(history[-1] - history[-2]) <= limit):
                break
            model = new
        return model, history
    finally:
        kept.unpersist()


def training_history(spark, history: list[float]) -> DataFrame:  # noqa: ANN001
    """I, sum_log_prob: a row for each step, for a table or its file."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "I int, sum_log_prob double")


def training_summary(model: Hmm, n_sequences: int, history: list[float], eps: float = EPSILON, auto: float = 0.3) -> str:
    """What was trained and how it went, as lines of text."""
    n, m = model.emit.shape
    facts = {"class": model.class_name, "states": n, "symbols": m, "type": model.kind or "given", "least emission": f"{eps:g}" if eps > 0 else "none", "sequences": n_sequences, "auto": f"{auto:g}", "refinements": len(history) - 1, "sum of log P": f"{history[-1]:g}" if history else ""}
    return "".join(f"{k}: {v}\n" for k, v in facts.items())


def learn_by_class(sequences: DataFrame, states: int, n_symbols: int, kind: str = "cascade3", seed: int = 0, max_iterations: int = 20, class_col: str = "class_name", symbols_col: str = "symbols", **options) -> list[Hmm]:  # noqa: ANN003
    """A model for each class; classes are few, each trains data-parallel."""
    names = [r[0] for r in sequences.select(class_col).distinct().orderBy(class_col).collect()]
    return [learn(sequences.where(F.col(class_col).eqNullSafe(F.lit(c))), initial_model(states, n_symbols, kind, seed, c), max_iterations=max_iterations, symbols_col=symbols_col, **options)[0] for c in names]


def ranked_models(models: list[Hmm], symbols_col: str = "symbols") -> Column:
    """Array of struct(model_id, score, rank), best first, the higher model on ties. Models are constants of the plan."""
    if all(len(m.pi) <= NATIVE_STATES for m in models):
        lps = F.array(*[log_likelihood(m, symbols_col, True) for m in models])
    else:
        lps = kernels.log_likelihood([(m.pi, m.trans, m.emit) for m in models])(F.col(symbols_col))
    order = F.reverse(F.array_sort(F.transform(lps, lambda v, i: F.struct(v.alias("score"), i.alias("model_id")))))
    return F.transform(order, lambda x, n: F.struct(x["model_id"].alias("model_id"), x["score"].alias("score"), (n + 1).alias("rank")))


def scores(sequences: DataFrame, models: list[Hmm], keys: list[str], symbols_col: str = "symbols") -> DataFrame:
    """keys, model_id, predicted, score, rank. A sequence's scores are ranked in its row, so nothing is shuffled."""
    names = F.array(*[F.lit(m.class_name) for m in models])
    return sequences.select(*keys, F.explode(ranked_models(models, symbols_col)).alias("x")).select(*keys, "x.model_id", hof.at(names, F.col("x.model_id")).alias("predicted"), "x.score", "x.rank")


def classify(sequences: DataFrame, models: list[Hmm], keys: list[str], class_col: str = "class_name", symbols_col: str = "symbols") -> DataFrame:
    """One row per sequence of a class that has a model: keys, actual, predicted, correct, rank (of its class), ranked (class names).

    Of several models of one class the first stands for the class. A projection: no shuffle.
    """
    home: dict[str, int] = {}
    for i, m in enumerate(models):
        home.setdefault(m.class_name, i)
    first = F.create_map(*[x for k, v in home.items() for x in (F.lit(k), F.lit(v))])
    names = F.array(*[F.lit(m.class_name) for m in models])
    fit = conforming(sequences, models[0].emit.shape[1], symbols_col).withColumn("_home", F.try_element_at(first, F.col(class_col))).where("_home is not null")
    ids = fit.select(*keys, class_col, "_home", F.transform(ranked_models(models, symbols_col), lambda x: x["model_id"]).alias("_ids"))
    order = F.array_position("_ids", F.col("_home"))
    return ids.select(*keys, F.col(class_col).alias("actual"), hof.at(names, hof.at(F.col("_ids"), 0)).alias("predicted"), (order == 1).alias("correct"), order.cast("int").alias("rank"), F.transform("_ids", lambda i: hof.at(names, i)).alias("ranked"))


def unmatched(sequences: DataFrame, models: list[Hmm], class_col: str = "class_name") -> DataFrame:
    """Classes without a model, once each."""
    names = sequences.sparkSession.createDataFrame([(m.class_name,) for m in models], f"{class_col} string").distinct()
    return sequences.select(class_col).distinct().join(F.broadcast(names), class_col, "left_anti")


def stochastic_check(spark, models: list[Hmm], tolerance: float = 1e-10) -> DataFrame:  # noqa: ANN001
    """Row sums of pi, A and B, with a flag where they are not 1: model_id, part, row, total, bad."""
    rows = [(i, part, k, [float(x) for x in row]) for i, m in enumerate(models) for part, block in (("pi", [m.pi]), ("A", m.trans), ("B", m.emit)) for k, row in enumerate(block)]
    out = spark.createDataFrame(rows, "model_id int, part string, row int, p array<double>").withColumn("total", hof.sum_of(F.col("p")))
    return out.select("model_id", "part", "row", "total", (F.abs(F.col("total") - 1) > tolerance).alias("bad"))


def show_models(spark, models: list[Hmm], fmt: str = "%g ") -> DataFrame:  # noqa: ANN001
    """A row of text for each row of pi, A and B: model_id, part, row, text."""
    rows = [(i, part, k, "".join(fmt % float(v) for v in row)) for i, m in enumerate(models) for part, block in (("pi", [m.pi]), ("A", m.trans), ("B", m.emit)) for k, row in enumerate(block)]
    return spark.createDataFrame(rows, "model_id int, part string, row int, text string")


def show_sequences(sequences: DataFrame, keys: list[str], model: Hmm | None = None, symbols_col: str = "symbols") -> DataFrame:
    """Sequences as abbreviated text; with a model also their log-likelihood and most likely states."""
    out = sequences.select(*keys, hof.abbreviated(F.col(symbols_col)).alias("text"), symbols_col)
    if model is not None:
        best = viterbi(model, symbols_col)
        out = out.withColumn("lp", log_likelihood(model, symbols_col)).withColumn("states", hof.abbreviated(best["path"]))
    return out.drop(symbols_col)


def classify_features(frames: DataFrame, book, models: list[Hmm], keys: list[str], class_col: str = "class_name", t_col: str = "t") -> DataFrame:  # noqa: ANN001
    """Quantization and classification in one plan."""
    from wavelark.operators.vq import quantize

    return classify(quantize(frames, book, [*keys, class_col], t_col), models, keys, class_col)


def generate(spark, model: Hmm, count: int, length: int, seed: int = 0, partitions: int | None = None) -> DataFrame:  # noqa: ANN001
    """Seeded samples: seq, states, symbols. A sequence depends on the seed and its number only, not on the partitioning."""
    pi, trans, emit = np.cumsum(model.pi), np.cumsum(model.trans, axis=1), np.cumsum(model.emit, axis=1)

    def draw(cdf: np.ndarray, u: float) -> int:
        return min(int(np.searchsorted(cdf, u, "right")), len(cdf) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, states, symbols = batch.column(0).to_pylist(), [], []
            for i in ids:
                u = np.random.default_rng([seed, i]).random((length, 2))
                q, o = [], []
                for a, b in u:
                    q.append(draw(trans[q[-1]] if q else pi, a))
                    o.append(draw(emit[q[-1]], b))
                states.append(q)
                symbols.append(o)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.list_(pa.int32())), pa.array(symbols, pa.list_(pa.int32()))], ["seq", "states", "symbols"])

    rows = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    return rows.mapInArrow(run, "seq long, states array<int>, symbols array<int>")


def model_directory(states: int, symbols: int, kind: int, auto: float, max_iterations: int | None = None) -> str:
    return f"N{states}__M{symbols}_t{kind}__a{auto:g}" + (f"_I{max_iterations}" if max_iterations else "")
