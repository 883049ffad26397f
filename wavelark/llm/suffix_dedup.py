"""Byte-level repeated passages by a logarithmic family of suffix arrays.

Each shard (see winnow) holds the stretches of text around its anchors. Stretches come in batches, in the order of document
ids; the places of a batch are sorted by the `length` bytes that follow them into a suffix array, which is merge-scanned against
the arrays of the existing levels for matches of `length` bytes. Then the batch becomes a level, and levels of equal size merge,
so a suffix is merged a logarithmic number of times. A level is its text and the places in order; the bytes at the places are only
read a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import BLOCK_BYTES, PrefixHash, releasing, same_columns, text_blocks, unpack
from wavelark.llm.winnow import Chunk, digest_of, key_of, repeated_spans, union_of

LENGTH = 50
GRAM = 18
#: Suffixes of a batch: so many, or this share of those that the family holds, MOST at most.
BATCH, SHARE, MOST = 1 << 16, 0.5, 1 << 20
#: Suffixes of a level that are read at once.
SCAN = 1 << 16


def byte_units(length: int, k: int):
    """Whole short texts, several hashed at once; long ones in chunks that share length - 1 bytes with the next."""

    def units(column: pa.Array) -> Iterator[tuple[int, Chunk]]:
        for first, data, offsets in text_blocks(column):
            if len(offsets) == 2:
                for base in range(0, max(1, len(data) - length + 1), BLOCK_BYTES):
                    part = data[base : base + BLOCK_BYTES + length - 1]
                    yield first, Chunk(base, PrefixHash(part).fixed(k), lambda x, y, part=part: part[x:y].tobytes())
                continue
            grams = PrefixHash(data).fixed(k)
            raw = data.tobytes()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                yield first + i, Chunk(0, grams[a : max(a, b - k + 1)], lambda x, y, a=a: raw[a + x : a + y])

    return units


@dataclass
class Level:
    """Places of a text, sorted by the bytes that follow; equal ones once, with the least document that has them."""

    text: np.ndarray
    places: np.ndarray
    docs: np.ndarray

    def keys(self, a: int, b: int, length: int) -> np.ndarray:
        """The bytes at the places a to b of the array."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, length)[self.places[a:b]]).view(f"S{length}").ravel()


class SuffixFamily:
    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []

    def __len__(self) -> int:
        return sum(len(x.places) for x in self.levels)

    def add(self, text: np.ndarray, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Returns for each of the places whether a smaller document, of this batch or an earlier one, has what stands there."""
        keys = Level(text, places, docs).keys(0, len(places), self.length)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        keys, least = keys[first], np.minimum.reduceat(docs[order], first)
        best = least.copy()
        for level in self.levels:
            for a in range(0, len(level.places), SCAN):
                there = level.keys(a, a + SCAN, self.length)
                lo, hi = np.searchsorted(keys, there[0], "left"), np.searchsorted(keys, there[-1], "right")
                at = np.searchsorted(there, keys[lo:hi])  # below len(there): no key here is beyond its last one
                hit = np.flatnonzero(there[at] == keys[lo:hi])
                best[lo + hit] = np.minimum(best[lo + hit], level.docs[a + at[hit]])
        seen = np.empty(len(order), bool)
        seen[order] = best[np.cumsum(new) - 1] < docs[order]
        self._push(Level(text, places[order][first].astype(np.int32), least))
        return seen

    def _push(self, level: Level) -> None:
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2].places) <= 2 * len(self.levels[-1].places):
            b, a = self.levels.pop(), self.levels.pop()
            text = np.concatenate([a.text, b.text])
            places = np.concatenate([a.places.astype(np.int64), b.places.astype(np.int64) + len(a.text)])
            docs = np.concatenate([a.docs, b.docs])
            keys = np.concatenate([a.keys(0, len(a.places), self.length), b.keys(0, len(b.places), self.length)])
            order = np.argsort(keys, kind="stable")  # two runs in order: a merge
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.levels.append(Level(text, places[order][first].astype(np.int32), np.minimum.reduceat(docs[order], first)))


def suffix_matcher(length: int):
    def match(items: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int]]:
        family = SuffixFamily(length)
        first = 0
        while first < len(items):
            last, n = first, 0
            while last < len(items) and n < min(MOST, max(BATCH, SHARE * len(family))):
                n += len(items[last][1]) - length + 1
                last += 1
            part = items[first:last]
            sizes = np.array([len(t) for _, t in part], np.int64)
            text = np.frombuffer(b"".join(t for _, t in part), np.uint8)
            counts = sizes - length + 1
            owner = np.repeat(np.arange(len(part)), counts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = family.add(text, (np.cumsum(sizes) - sizes)[owner] + inner, np.array([d for d, _ in part], np.int64)[owner])
            if hit.any():
                at = np.flatnonzero(hit)
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
                b = np.flatnonzero(new)
                e = np.concatenate([b[1:] - 1, [len(at) - 1]])
                for x, y in zip(at[b].tolist(), at[e].tolist()):
                    yield first + int(owner[x]), int(inner[x]), int(inner[y]) + length
            first = last

    return match


def suffix_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Texts and repeated byte spans, as winnow.repeated_spans; a whole copy shorter than `length` repeats nothing."""
    return repeated_spans(docs, byte_units(length, gram), suffix_matcher(length), length, gram, len, id_col, text_col)


@releasing
def suffix_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of `length` bytes that also starts in a document with a smaller id. Null texts count
    as empty, null ids as larger than any other, documents with one id never match each other, repeated rows get equal results.
    An empty table gives no rows.
    """
    texts, found = suffix_spans(docs, id_col, text_col, length, gram)
    joined = texts.join(found.hint("shuffle_hash"), ["doc_id", "key"], "left")
    touched = F.col("copy").isNotNull() & (F.octet_length("text") >= length)
    sides = joined.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"), touched.alias("touched"))
    out = sides.mapInArrow(_report(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < F.lit((1 << 63) - 1), F.col("doc_id")))


def _report(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans, copy, touched in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                raw = text.encode("utf-8", "surrogatepass")
                if not touched:
                    rows.append((doc_id, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                elif copy:
                    rows.append((doc_id, len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()))
                else:
                    cut = union_of(spans)
                    rest = without(raw, cut)
                    rows.append((doc_id, len(raw), len(raw) - len(rest), len(cut), hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def without(raw: bytes, cut: np.ndarray) -> bytes:
    keep, at = [], 0
    for a, b in cut.tolist():
        keep.append(raw[at:a])
        at = b
    keep.append(raw[at:])
    return b"".join(keep)


@releasing
def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes cut out of the text; what a cut leaves of a character is dropped. Null texts stay null."""
    rows = docs.select(same_columns(docs), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", key_of("_id", digest_of("_text")))
    _, found = suffix_spans(docs, id_col, text_col, length, gram)
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", "copy")

    @F.pandas_udf("string")
    def cut(text, spans, copy):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([t if c is None or len(t.encode()) < length else "" if c else without(t.encode("utf-8", "surrogatepass"), union_of(s)).decode("utf-8", "ignore") for t, s, c in zip(text, spans, copy)])

    joined = rows.join(found.hint("shuffle_hash"), ["_id", "_key"], "left")
    new = joined.select(F.col("_row").withField(f"`{text_col}`", F.when(F.col("_row").getField(text_col).isNotNull(), cut("_text", "spans", "copy"))).alias("_row"))
    return unpack(new, docs.columns)
