"""The driver's tables as signals, sequences and models, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelark.operators.hmm import Hmm

ORDER = 8
SYMBOLS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
WIDTH, STEP = 16, 8

#: Constant models, one a class; the last is a cascade with zeros.
MODELS = [
    Hmm.of([0.5, 0.3, 0.2], [[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.3, 0.6]], [[0.1, 0.3, 0.3, 0.2, 0.1], [0.3, 0.2, 0.1, 0.2, 0.2], [0.2, 0.2, 0.2, 0.2, 0.2]], "0"),
    Hmm.of([0.2, 0.2, 0.6], [[0.3, 0.4, 0.3], [0.25, 0.5, 0.25], [0.5, 0.1, 0.4]], [[0.25, 0.15, 0.2, 0.2, 0.2], [0.2, 0.2, 0.25, 0.15, 0.2], [0.15, 0.25, 0.2, 0.1, 0.3]], "1"),
    Hmm.of([1.0, 0.0, 0.0], [[0.9, 0.1, 0.0], [0.0, 0.95, 0.05], [0.0, 0.0, 1.0]], [[0.2, 0.22, 0.18, 0.25, 0.15], [0.22, 0.18, 0.2, 0.15, 0.25], [0.18, 0.2, 0.22, 0.2, 0.2]], "2"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, frame."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("frame"))


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, x, event_type, event_id."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"), F.col("value").alias("x"), "event_type", "event_id", "ts")


def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, samples: collected in order without a window sort."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("samples"))


def user_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, class_name, symbols."""
    e = table(spark, sf_dir, "events")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv]), F.col("event_type"))
    rows = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", code.alias("o")))), lambda x: x["o"]).alias("symbols"))
    return rows.select("user_id", (F.col("user_id") % 3).cast("string").alias("class_name"), "symbols")


def typed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enveloped signals by event type for endpoint detection: path, sample_rate, samples."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    loud = lambda n: F.when((n >= 300) & (n <= F.size("v") - 250), 40.0).otherwise(1.0)
    return rows.select(F.col("event_type").alias("path"), F.lit(1000.0).alias("sample_rate"), F.transform("v", lambda x, n: F.when(n % 3 == 0, -1.0).otherwise(1.0) * x * loud(n)).alias("samples"))


# --- SQL ---------------------------------------------------------------------------------------

SAMPLES_SQL = "samples AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x, event_type, event_id, ts FROM events)"
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SYMBOLS.items()) + " END"
SEQ_SQL = f"seq AS (SELECT user_id, CAST(user_id % 3 AS VARCHAR) AS class_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, {_CASE} AS o FROM events)"


def _list(v) -> str:  # noqa: ANN001
    return "[" + ", ".join(_list(x) if hasattr(x, "__len__") else f"CAST({float(x)!r} AS DOUBLE)" for x in v) + "]"


MODELS_SQL = "models(model_id, name, pi, a, b) AS (VALUES " + ", ".join(f"({i}, '{m.class_name}', {_list(m.pi)}, {_list(m.trans)}, {_list(m.emit)})" for i, m in enumerate(MODELS)) + ")"


def autocorrelation_sql(p: int = ORDER, n: int = 64) -> str:
    """ac(vec_id, label, r0 .. rP)."""
    lags = ", ".join(f"list_sum(list_transform(range(1, {n - i + 1}), lambda k: x[k] * x[k + {i}])) AS r{i}" for i in range(p + 1))
    return f"emb AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), ac AS (SELECT vec_id, label, {lags} FROM emb)"


def levinson_sql(source: str, keys: str, out: str, p: int = ORDER) -> str:
    """A chain of CTEs from source(keys, r0..rP) to out(keys, r*, k1..kP, a1..aP, pe)."""
    rs = ", ".join(f"r{i}" for i in range(p + 1))
    parts = [f"{out}_0 AS (SELECT {keys}, {rs}, r0 AS pe0 FROM {source})"]
    for m in range(1, p + 1):
        drive = " + ".join([f"r{m}"] + [f"a{m - 1}_{j} * r{m - j}" for j in range(1, m)])
        old = "".join(f", k{j}" for j in range(1, m)) + "".join(f", a{m - 1}_{j}" for j in range(1, m))
        parts.append(f"{out}_{m}k AS (SELECT {keys}, {rs}{old}, pe{m - 1}, -({drive}) / pe{m - 1} AS k{m} FROM {out}_{m - 1})")
        new = "".join(f", a{m - 1}_{j} + k{m} * a{m - 1}_{m - j} AS a{m}_{j}" for j in range(1, m)) + f", k{m} AS a{m}_{m}"
        ks = "".join(f", k{j}" for j in range(1, m + 1))
        parts.append(f"{out}_{m} AS (SELECT {keys}, {rs}{ks}{new}, pe{m - 1} * (1 - k{m} * k{m}) AS pe{m} FROM {out}_{m}k)")
    final = ", ".join([f"k{j}" for j in range(1, p + 1)] + [f"a{p}_{j} AS a{j}" for j in range(1, p + 1)])
    parts.append(f"{out} AS (SELECT {keys}, {rs}, {final}, pe{p} AS pe FROM {out}_{p})")
    return ", ".join(parts)


LPC_SQL = autocorrelation_sql() + ", " + levinson_sql("ac", "vec_id, label", "lp") + ", norm AS (SELECT vec_id, label, " + ", ".join(f"r{i} / pe AS r{i}" for i in range(ORDER + 1)) + " FROM lp)"


def distortion_sql(raa, table_name: str = "norm") -> str:  # noqa: ANN001
    lit = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    tail = " + ".join(f"{table_name}.r{n} * {lit(raa[n])}" for n in range(1, len(raa)))
    return f"({table_name}.r0 * {lit(raa[0])} + 2 * ({tail}))"
