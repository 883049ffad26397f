"""Binary interchange formats (predictors, codebooks, sequences, models) as Spark data sources and writers.

Layout, native little-endian: an identifier of 16 bytes padded with NUL; a class name of 96 bytes, ended by NUL and padded with
underscores; two 32-bit sizes; then doubles (sequences: unsigned 16-bit symbols). Files that break off or carry another
identifier are skipped, or raise with option mode=FAILFAST.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
IDENTS = {"prd": b"<predictor>", "cbook": b"<codebook>", "seq": b"<sequence>", "hmm": b"<hmm>"}
IDENT_BYTES, CLASS_BYTES = 16, 96

SCHEMAS = {
    "prd": "path string, class_name string, order int, t int, r array<double>",
    "cbook": "path string, class_name string, order int, codeword int, rc array<double>",
    "seq": "path string, class_name string, n_symbols int, symbols array<int>",
    "hmm": "path string, class_name string, pi array<double>, trans array<array<double>>, emit array<array<double>>",
}


def encode(kind: str, class_name: str, *parts: object) -> bytes:
    name = class_name.encode()[: CLASS_BYTES - 1] + b"\0"
    head = IDENTS[kind].ljust(IDENT_BYTES, b"\0") + name.ljust(CLASS_BYTES, b"_")
    if kind in ("prd", "cbook"):
        rows = np.asarray(parts[0], "<f8")
        return head + struct.pack("<ii", rows.shape[1] - 1, len(rows)) + rows.tobytes()
    if kind == "seq":
        symbols, alphabet = parts
        return head + struct.pack("<ii", len(symbols), alphabet) + np.asarray(symbols, "<u2").tobytes()
    pi, trans, emit = (np.asarray(p, "<f8") for p in parts)
    return head + struct.pack("<ii", len(pi), emit.shape[1]) + pi.tobytes() + trans.tobytes() + emit.tobytes()


def decode(kind: str, raw: bytes) -> tuple:
    """class name, then: rows (prd, cbook); symbols, alphabet (seq); pi, trans, emit (hmm)."""
    at = IDENT_BYTES + CLASS_BYTES
    if len(raw) < at + 8 or not raw.startswith(IDENTS[kind]):
        raise ValueError(f"not a {kind} file")
    name = raw[IDENT_BYTES:at].split(b"\0")[0].decode(errors="replace")
    a, b = struct.unpack_from("<ii", raw, at)
    at += 8
    n = {"prd": b * (a + 1), "cbook": b * (a + 1), "seq": a, "hmm": a + a * a + a * b}[kind]
    kindof = "<u2" if kind == "seq" else "<f8"
    if min(a, b) < 0 or len(raw) < at + n * np.dtype(kindof).itemsize:
        raise ValueError(f"{kind} file breaks off")
    data = np.frombuffer(raw, kindof, n, at)
    if kind in ("prd", "cbook"):
        return name, data.reshape(b, a + 1)
    if kind == "seq":
        if n and data.max() >= b:
            raise ValueError("symbol beyond the alphabet")
        return name, data.astype(int), b
    return name, data[:a], data[a : a + a * a].reshape(a, a), data[a + a * a :].reshape(a, b)


def _rows(kind: str, path: str, raw: bytes) -> list[dict]:
    got = decode(kind, raw)
    if kind == "seq":
        return [{"path": path, "class_name": got[0], "n_symbols": got[2], "symbols": got[1].tolist()}]
    if kind == "hmm":
        return [{"path": path, "class_name": got[0], "pi": got[1].tolist(), "trans": got[2].tolist(), "emit": got[3].tolist()}]
    index, value = ("t", "r") if kind == "prd" else ("codeword", "rc")
    return [{"path": path, "class_name": got[0], "order": got[1].shape[1] - 1, index: i, value: v.tolist()} for i, v in enumerate(got[1])]


def read(spark: SparkSession, path: str | list[str], kind: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Files of one kind, through Spark's own file listing (globs, any file system)."""
    columns = [c.split()[0] for c in SCHEMAS[kind].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows = _rows(kind, p, bytes(raw))
                except ValueError:
                    if mode == "FAILFAST":
                        raise
                    continue
                for a in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[a : a + 10_000], columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMAS[kind])


def encoded(df: DataFrame, kind: str, alphabet: int | None = None) -> DataFrame:
    """path, content: a file for each path of df (columns as read() gives them)."""
    if kind in ("prd", "cbook"):
        index, value = ("t", "r") if kind == "prd" else ("codeword", "rc")
        df = df.groupBy("path", "class_name").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))), lambda x: x["v"]).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if kind == "seq":
                    parts = (list(r["symbols"]), alphabet or int(r["n_symbols"]))
                elif kind == "hmm":
                    parts = (np.stack([np.asarray(r["pi"])])[0], np.stack([np.asarray(x) for x in r["trans"]]), np.stack([np.asarray(x) for x in r["emit"]]))
                else:
                    parts = (np.stack([np.asarray(x) for x in r["rows"]]),)
                out.append((r["path"], encode(kind, r["class_name"] or "", *parts)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return df.mapInPandas(run, "path string, content binary")


def write_files(files: DataFrame, base: str) -> int:
    """Writes each content to its path under base. The tasks write, each file under another name first, so a task may run twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                target = f"{root}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(bytes(content))
                store.move(part, target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0


def write(df: DataFrame, kind: str, base: str, alphabet: int | None = None) -> int:
    """Writes a file for each path under base, which all executors reach. Returns how many."""
    return write_files(encoded(df, kind, alphabet), base)
