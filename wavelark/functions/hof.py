"""Signal, linear-prediction and Markov-model functions as native column expressions (higher-order functions, no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values) -> Column:  # noqa: ANN001
    return F.array(*[F.lit(float(v)) for v in values])


def matrix(rows) -> Column:  # noqa: ANN001
    return F.array(*[doubles(r) for r in rows])


def at(array: Column, index: Column | int) -> Column:
    """0-based element; null beyond the end."""
    return F.get(array, F.lit(index) if isinstance(index, int) else index)


def sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """Evaluates value once and gives it to body."""
    return at(F.transform(F.array(value), body), 0)


# --- frames -------------------------------------------------------------------------------


def hamming_window(width: int) -> Column:
    """A literal, so it is computed once for the plan."""
    return doubles(0.54 - 0.46 * math.cos(2 * math.pi * n / max(1, width - 1)) for n in range(width))


def remove_mean(x: Column) -> Column:
    return let(sum_of(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))


def preemphasize(x: Column, factor: float = 0.95) -> Column:
    return let(x, lambda y: F.transform(y, lambda v, i: v - F.lit(factor) * F.coalesce(at(y, i - 1), F.lit(0.0))))


def apply_window(x: Column, window: Column) -> Column:
    return F.zip_with(x, window, lambda a, b: a * b)


def frames_of(samples: Column, width: int, step: int) -> Column:
    """Array of the full frames of a signal; the incomplete tail is left out."""

    def cut(x: Column) -> Column:
        count = F.floor((F.size(x) - width) / step).cast("int") + 1
        return F.when(F.size(x) >= width, F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.slice(x, t * step + 1, F.lit(width)))).otherwise(F.array().cast("array<array<double>>"))

    return let(samples, cut)


# --- linear prediction -----------------------------------------------------------------------


def autocorrelation(x: Column, order: int) -> Column:
    return let(x, lambda y: F.transform(F.sequence(F.lit(0), F.lit(order)), lambda lag: _lagged(y, lag)))


def _lagged(x: Column, lag: Column) -> Column:
    n = F.size(x) - lag
    return sum_of(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, lag + 1, n), lambda a, b: a * b))


def _longer(a: Column, k: Column, reflection: Column) -> Column:
    """The predictor of order k from that of order k - 1 and the k-th reflection coefficient."""
    return F.transform(F.sequence(F.lit(0), k), lambda j: F.when(j == 0, F.lit(1.0)).when(j == k, reflection).otherwise(at(a, j) + reflection * at(a, k - j)))


def levinson(r: Column, order: int) -> Column:
    """struct(rc, a, pe, status): reflections (rc[0] is 0), predictor, prediction error.

    Status 1: no energy (all zero); 2: the error became 0 or less, later reflections are 0.
    """
    return let(r, lambda v: _levinson(v, order))


def _levinson(r: Column, order: int) -> Column:
    nothing = F.struct(doubles([1.0]).alias("a"), doubles([0.0]).alias("rc"), at(r, 0).alias("pe"), F.when(at(r, 0) == 0, 1).otherwise(0).alias("status"))

    def step(s: Column, k: Column) -> Column:
        drive = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda t, j: t + at(s["a"], j) * at(r, k - j))
        return let(F.when(s["status"] == 0, -drive / F.nullif(s["pe"], F.lit(0.0))).otherwise(F.lit(0.0)), lambda q: let(s["pe"] * (1 - q * q), lambda pe: F.struct(_longer(s["a"], k, q).alias("a"), F.concat(s["rc"], F.array(q)).alias("rc"), pe.alias("pe"), F.when((s["status"] == 0) & (pe <= 0), 2).otherwise(s["status"]).alias("status"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), nothing, step, lambda s: F.struct(s["rc"].alias("rc"), s["a"].alias("a"), s["pe"].alias("pe"), s["status"].alias("status")))


def step_up(rc: Column) -> Column:
    """Predictor from reflections (rc[0] is not used)."""
    return let(rc, lambda v: F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), doubles([1.0]), lambda a, k: _longer(a, k, at(v, k))))


def predictor_autocorrelation(a: Column) -> Column:
    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda lag: _lagged(v, lag)))


def reflections_to_raa(rc: Column) -> Column:
    return let(step_up(rc), predictor_autocorrelation)


def gain_normalized(r: Column, pe: Column) -> Column:
    return let(pe, lambda e: F.when((e != 0) & e.isNotNull(), F.transform(r, lambda v: v / e)).otherwise(r))


def distortion(r: Column, raa: Column) -> Column:
    """Likelihood ratio of a frame (its normalised autocorrelation) and a codeword."""
    n = F.size(r) - 1
    return at(r, 0) * at(raa, 0) + 2 * sum_of(F.zip_with(F.slice(r, F.lit(2), n), F.slice(raa, F.lit(2), n), lambda p, q: p * q))


def nearest_codeword(r: Column, codebook: Column) -> Column:
    """struct(d, i): least distortion and its codeword, the lowest on ties. codebook: array of raa arrays."""
    return let(r, lambda v: F.array_min(F.transform(codebook, lambda c, i: F.struct(distortion(v, c).alias("d"), i.alias("i")))))


# --- hidden Markov models ----------------------------------------------------------------------


def log_or_minus_inf(p: Column) -> Column:
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))


def log_likelihood(symbols: Column, pi: Column, trans: Column, emit: Column) -> Column:
    """Scaled forward pass; minus infinity for a sequence that the model can't emit, 0 for an empty one."""
    states = F.sequence(F.lit(0), F.size(pi) - 1)
    start = F.struct(F.array().cast("array<double>").alias("al"), F.lit(0.0).alias("lp"))

    def step(s: Column, o: Column) -> Column:
        reached = lambda j: F.when(F.size(s["al"]) == 0, at(pi, j)).otherwise(F.aggregate(states, F.lit(0.0), lambda t, i: t + at(s["al"], i) * at(at(trans, i), j)))
        raw = F.transform(states, lambda j: reached(j) * at(at(emit, j), o))
        return let(raw, lambda v: let(sum_of(v), lambda c: F.struct(F.transform(v, lambda p: F.when(c > 0, p / F.nullif(c, F.lit(0.0))).otherwise(F.lit(0.0))).alias("al"), (s["lp"] + log_or_minus_inf(c)).alias("lp"))))

    return F.aggregate(symbols, start, step, lambda s: s["lp"])


def viterbi(symbols: Column, log_pi: Column, log_trans: Column, log_emit: Column) -> Column:
    """struct(lp, path) of the most likely states, from logarithms; ties go to the lowest state."""
    states = F.sequence(F.lit(0), F.size(log_pi) - 1)
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array().cast("array<array<int>>").alias("psi"))
    best = lambda values: F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))

    def over(lt: Column) -> Column:
        def step(s: Column, o: Column) -> Column:
            arrive = F.transform(states, lambda j: best(F.transform(states, lambda i: at(s["phi"], i) + at(at(lt, i), j))))
            first = F.struct(F.transform(states, lambda j: at(log_pi, j) + at(at(log_emit, j), o)).alias("phi"), s["psi"].alias("psi"))
            later = let(arrive, lambda b: F.struct(F.transform(b, lambda v, j: v["v"] + at(at(log_emit, j), o)).alias("phi"), F.concat(s["psi"], F.array(F.transform(b, lambda v: -v["i"]))).alias("psi")))
            return F.when(F.size(s["phi"]) == 0, first).otherwise(later)

        def finish(s: Column) -> Column:
            end = lambda e: F.aggregate(F.reverse(s["psi"]), F.array(-e["i"]), lambda path, back: F.concat(F.array(at(back, at(path, 0))), path))
            return let(best(s["phi"]), lambda e: F.struct(e["v"].alias("lp"), end(e).alias("path")))

        return F.aggregate(symbols, start, step, finish)

    return let(log_trans, over)


def floor_row(row: Column, eps: float) -> Column:
    """Raises entries below eps to eps, at the cost of the others in proportion to what they have above it."""
    low = F.aggregate(row, F.lit(0.0), lambda s, v: s + F.greatest(F.lit(eps) - v, F.lit(0.0)))
    spare = F.aggregate(row, F.lit(0.0), lambda s, v: s + F.greatest(v - F.lit(eps), F.lit(0.0)))
    share = F.coalesce(low / F.nullif(spare, F.lit(0.0)), F.lit(0.0))
    return let(share, lambda q: F.transform(row, lambda v: F.when(v <= eps, F.lit(eps)).otherwise(v - (v - F.lit(eps)) * q)))


# --- strings --------------------------------------------------------------------------------


def class_of_path(path: Column) -> Column:
    """Parent directory, where another separator precedes it; else empty."""
    return F.regexp_extract(path, "^(?:.*)/([^/]*)/[^/]*$", 1)


def simple_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def change_extension(path: Column, ext: str) -> Column:
    """Replaces what follows the last dot; without a dot the path stays; an ext of under 3 characters is appended."""
    if len(ext) < 3:
        return F.concat(path, F.lit(ext))
    return F.when(F.instr(path, ".") > 0, F.concat(F.regexp_extract(path, r"^(.*)\.[^.]*$", 1), F.lit(ext))).otherwise(path)


def output_path(path: Column, base: str, ext: str, class_name: Column | None = None) -> Column:
    cls = class_of_path(path) if class_name is None else class_name
    return F.concat_ws("/", F.lit("data"), F.lit(base), F.when(F.coalesce(cls, F.lit("")) == "", F.lit("_")).otherwise(cls), change_extension(simple_name(path), ext))


def selection_number(path: Column) -> Column:
    """The number before `.seq`; -1 where there is none."""
    return F.coalesce(F.regexp_extract(path, r"([^/]+)\.seq$", 1).try_cast("int"), F.lit(-1))


def sequence_dir(base: str, size: int) -> str:
    """Where sequences of a codebook of this size go."""
    return f"{base}/M{size}"


def has_suffix(text: Column, suffix: str) -> Column:
    return F.endswith(text, F.lit(suffix))


def fixed_width(text: Column, width: int, pad: str = "_") -> Column:
    """The text cut to width - 1 characters, an end mark, and padding: the class field of the binary formats (end mark as NUL)."""
    return F.rpad(F.concat(F.substring(text, 1, width - 1), F.lit("\0")), width, pad)


def duration_ms(text: Column) -> Column:
    """Milliseconds of `1h57m39.828s`, any part optional but one; null where it can't be read."""
    part = lambda n: F.nullif(F.regexp_extract(text, r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+(?:\.\d+)?)s)?$", n), F.lit(""))
    h, m, s = part(1).cast("bigint"), part(2).cast("bigint"), part(3).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero(h) * 3600000 + zero(m) * 60000 + F.floor(F.coalesce(s, F.lit(0.0)) * 1000 + 0.5)
    return F.when(h.isNotNull() | m.isNotNull() | s.isNotNull(), total.cast("bigint"))


def elapsed_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("int")
    return F.when(seconds >= 60, F.format_string("%dm:%.1fs", minutes, seconds - minutes * 60.0)).when(seconds.isNotNull(), F.format_string("%.3fs", seconds))


def abbreviated(symbols: Column, head: int = 10, longest: int = 40) -> Column:
    """A sequence as text, its middle left out where it is long."""
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ", ")
    return F.when(F.size(symbols) > longest, F.concat(text(F.slice(symbols, 1, head)), F.lit(", ..., "), text(F.slice(symbols, -head, head)))).otherwise(text(symbols))


def rank_color(rank: Column) -> Column:
    # fixed values
    colors = ["lightgreen", "lightblue", "blue", "yellow", "orange", "red"]
    return F.when(rank.between(1, 6), F.element_at(F.array(*map(F.lit, colors)), F.greatest(F.least(rank, F.lit(6)), F.lit(1)).cast("int"))).otherwise("brown")
