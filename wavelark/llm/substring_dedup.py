"""Word-level repeated passages by relative Lempel-Ziv parsing.

A shard (see winnow) reads its stretches, runs of real words, in the order of document ids and factors each greedily against
every indexed reference block, the stretches of smaller documents. A block's index holds the places of its runs of `window`
words by a hash; a candidate place is compared word by word and then followed as far as the words agree, so a factor is a
repeated passage of at least `window` words, and a shorter one is a literal. The parse goes on inside the end of a factor, with
the first run of words that crosses its boundary, so a passage that two factors cover between them is not lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import BLOCK_BYTES, WordHasher, gram_hashes, mix64, releasing, same_columns, unpack, window_hashes
from wavelark.llm.winnow import Chunk, digest_of, key_of, repeated_spans, union_of

WINDOW = 50
GRAM = 8
#: Words of a reference block.
BLOCK = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(raw: bytes, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first word, and words; each chunk begins with the last window - 1 words of the one before."""
    at, base, words = 0, 0, []
    while True:
        cut = _SPACE.search(raw, at + BLOCK_BYTES) if at + BLOCK_BYTES < len(raw) else None
        end = cut.start() if cut else len(raw)
        words += raw[at:end].split()  # bytes.split parts at just the six ASCII white space characters
        yield base, words
        if not cut:
            return
        keep = min(len(words), window - 1)
        at, base, words = end, base + len(words) - keep, words[len(words) - keep :]


def word_units(window: int, k: int):
    def units(column: pa.Array) -> Iterator[tuple[int, Chunk]]:
        hasher = WordHasher()
        for i, raw in enumerate(column.cast(pa.binary()).to_pylist()):
            for base, words in word_chunks(raw, window):
                yield i, Chunk(base, gram_hashes(hasher(words), k), lambda x, y, words=words: b" ".join(words[x:y]))

    return units


class ReferenceBlocks:
    """Words of earlier documents, as numbers, with the places of each run of `window` words in each block."""

    def __init__(self, size: int, window: int) -> None:
        self.size, self.window, self.blocks = size, window, []

    def add(self, words: list[int], hashes: list[int]) -> None:
        if not self.blocks or len(self.blocks[-1][0]) + len(words) > self.size:
            self.blocks.append(([], {}, {}))
        text, places, others = self.blocks[-1]
        base, w = len(text), self.window
        text.extend(words)
        text.append(-1)  # no factor runs over the end of a stretch
        for i, h in enumerate(hashes):
            p = places.setdefault(h, base + i)
            if p != base + i and text[p : p + w] != words[i : i + w]:  # other words with this hash
                others.setdefault(h, []).append(base + i)

    def factor(self, words: list[int], h: int, at: int) -> int:
        """Words of the longest factor that starts here with this hash, 0 for a literal."""
        best, n, w = 0, len(words), self.window
        here = words[at : at + w]
        for text, places, others in self.blocks:
            for p in (places.get(h), *others.get(h, ())):
                if p is None or text[p : p + w] != here:
                    continue
                length = w
                while at + length < n and text[p + length] == words[at + length]:
                    length += 1
                best = max(best, length)
        return best


def lempel_ziv_matcher(window: int):
    def match(items: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int]]:
        blocks, waiting, owner = ReferenceBlocks(BLOCK, window), [], None
        names: dict[bytes, int] = {}
        for i, (doc, content) in enumerate(items):  # in the order of ids
            if doc != owner:
                for one in waiting:
                    blocks.add(*one)
                waiting, owner = [], doc
            words = [names.setdefault(w, len(names)) for w in content.split(b" ")]
            hashes = window_hashes(mix64(np.array(words, np.uint64) + np.uint64(1)), window).tolist()
            at, last = 0, None
            while at < len(hashes):
                length = blocks.factor(words, hashes[at], at)
                if not length:
                    at += 1
                    continue
                if last and last[1] == at + window - 1:  # the windows go on where the last factor's end
                    last[1] = at + length
                else:
                    if last:
                        yield i, last[0], last[1]
                    last = [at, at + length]
                at += length - window + 1
            if last:
                yield i, last[0], last[1]
            if not last or last != [0, len(words)]:  # else a smaller document has it all
                waiting.append((words, hashes))

    return match


def substring_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Texts and repeated word spans, as winnow.repeated_spans."""
    return repeated_spans(docs, word_units(window, gram), lempel_ziv_matcher(window), window, gram, lambda words: words.count(b" ") + 1, id_col, text_col)


def _kept(words: list[bytes], spans, copy, window: int) -> list[bytes]:  # noqa: ANN001
    if copy is None or len(words) < window:
        return words
    if copy:
        return []
    keep, at = [], 0
    for a, b in union_of(spans).tolist():
        keep += words[at:a]
        at = b
    return keep + words[at:]


def _report(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans, copy in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = _kept(words, spans, copy, window)
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


@releasing
def substring_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    Removed is each word covered by a run of `window` words that also starts in a document with a smaller id. Null texts have no
    words, null ids are larger than any other, documents with one id never match each other, repeated rows get equal results.
    An empty table gives no rows.
    """
    texts, found = substring_spans(docs, id_col, text_col, window, gram)
    joined = texts.join(found.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "spans", "copy")
    out = joined.mapInArrow(_report(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < F.lit((1 << 63) - 1), F.col("doc_id")))


@releasing
def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated words gone; a text that loses words becomes its other words joined by one space."""
    rows = docs.select(same_columns(docs), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", key_of("_id", digest_of("_text")))
    _, found = substring_spans(docs, id_col, text_col, window, gram)
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", "copy")

    @F.pandas_udf("string")
    def cut(text, spans, copy):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(t: str, s, c):  # noqa: ANN001, ANN202
            if c is None:
                return t
            words = t.encode("utf-8", "surrogatepass").split()
            kept = _kept(words, s, bool(c), window)
            return t if len(kept) == len(words) else b" ".join(kept).decode("utf-8", "ignore")

        return pd.Series([one(*x) for x in zip(text, spans, copy)])

    joined = rows.join(found.hint("shuffle_hash"), ["_id", "_key"], "left")
    new = joined.select(F.col("_row").withField(f"`{text_col}`", F.when(F.col("_row").getField(text_col).isNotNull(), cut("_text", "spans", "copy"))).alias("_row"))
    return unpack(new, docs.columns)
