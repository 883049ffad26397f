"""Helpers shared by the corpus operators: shared storage, row keys and vectorised text hashing."""

from __future__ import annotations

import atexit
import functools
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by numpy at once.
BLOCK_BYTES = 1 << 19
#: While a table is written: rows that go to Python hold whole texts or sets, so they go in smaller batches; and the shuffle
#: files of the query go with its end, as the table is all that is read later.
WHILE_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_own_dirs: dict[str, str] = {}
_written = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset a local session gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        holder = tempfile.TemporaryDirectory(prefix="wavelark-")
        atexit.register(holder.cleanup)
        _own_dirs[app] = holder.name
    return f"file://{_own_dirs[app]}"


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wavelark/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application has written to the shared folder; results that still read them are lost."""
    _delete(spark, _tables_dir(spark))


def releasing(operator: Callable) -> Callable:
    """Of the tables that an operator writes only those that its result (one or more DataFrames) reads stay."""

    @functools.wraps(operator)
    def run(*args, **kwargs):  # noqa: ANN002, ANN003, ANN202
        outer, _written.tables = getattr(_written, "tables", None), []
        try:
            out = operator(*args, **kwargs)
            read = {f for df in (out if isinstance(out, tuple) else (out,)) if isinstance(df, DataFrame) for f in df.inputFiles()}
            read = {part for f in read for part in f.split("/")}
        finally:
            mine, _written.tables = _written.tables, outer
        for spark, folder in mine:
            if folder.rsplit("/", 1)[1] not in read:
                _delete(spark, folder)
            elif outer is not None:
                outer.append((spark, folder))
        return out

    return run


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    usual = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors.

    batch: rows that go to Python at once, where they are larger than usual.
    """
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{uuid.uuid4().hex}"
    if getattr(_written, "tables", None) is not None:
        _written.tables.append((spark, path))
    with _settings(spark, WHILE_WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that nothing reads any more, before its operator ends."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def shard_count(df: DataFrame, bytes_per_shard: int = 32 << 20) -> int:
    """Enough shards that each stays small: the session's shuffle partitions, or more for large inputs."""
    stats = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stats > 1 << 60:  # unknown
        stats = 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), stats // bytes_per_shard, 1)


def same_columns(docs: DataFrame) -> Column:
    """All columns of docs in one struct, so that added columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


# --- text as arrays ---------------------------------------------------------------------------

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
            _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE_INV, np.uint64)]), dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PrefixHash:
    """Hashes of any substring of a byte array in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def fixed(self, width: int) -> np.ndarray:
        """Hash of each substring of this width, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n])


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string column between rows into blocks of about limit bytes: first row, bytes, row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (with the total last)."""
    word = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class WordHasher:
    """64-bit digests of words, remembered in a cache of bounded size."""

    MOST_WORDS, MOST_BYTES = 300_000, 32 << 20

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint64)
        except KeyError:
            new = set(words).difference(self.known)
            if len(self.known) > self.MOST_WORDS or self.size > self.MOST_BYTES:
                self.known, self.size, new = {}, 0, set(words)
            for w in new:
                self.known[w] = hashlib.blake2b(w, digest_size=8).digest()
                self.size += len(w)
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by first word; runs over row ends are the caller's to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += words[j : j + n]
    return mix64(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words, in constant time a run whatever the width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value in each window."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n]) if span < width else least[:n]
