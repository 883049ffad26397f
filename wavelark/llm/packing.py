"""Best-fit packing of token sequences, by a tree of partial packings.

Each input partition (a leaf) packs its own pieces best-fit decreasing. Bins that are nearly full are final. Of the others only
a histogram goes up the tree: (node, fill, number of bins), at most `capacity` rows a node however many bins there are, since
bins of one fill are interchangeable. A parent best-fits the bins of its children as items and again passes on what is
underfull, up to the root. The way down is a chain of small interval joins: bins first..last of (node, fill) became bins of the
parent at an offset. No task holds more than the histograms of FAN nodes or the piece lengths of LEAF documents.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import id_and_text, materialize, releasing

CAPACITY = 4096
END_ID = 1
#: Free places up to which a bin counts as full.
SLACK = 8
FAN = 32
#: Documents that a leaf packs at once; a partition's further leaves are numbered at this distance.
LEAF, NEXT_LEAF = 50_000, 1 << 20
#: Entries of a worker's cache of word encodings.
CACHE = 600_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, node long, fill int, rank long, at long"
_encoders: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A full stop or comma right after another sign: the tokenizer keeps such signs together.
_SIGNS = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")


def _kinds(normalizer: dict | None) -> list[str]:
    """The kinds of steps of a tokenizer file's normalizer."""
    if not normalizer:
        return []
    return [normalizer["type"], *(k for n in normalizer.get("normalizers", []) for k in _kinds(n))]


class WordEncoder:
    """Token ids by parts of text, for a tokenizer that drops white space and never joins anything across it; others get whole texts.

    Full stops and commas are parted from their words, and texts are lower-cased first where that is what the tokenizer would do,
    so that few different parts remain; they are remembered in a bounded cache. New words are encoded many at a time; each
    ends with the one token that closes a word, which tells their ids apart.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.in_parts = self.closes.any() and "Lowercase" in _kinds(json.loads(Path(path).read_text("utf-8")).get("normalizer"))

    @staticmethod
    def parts(text: str) -> list[str]:
        text = text.replace("\n", " ")
        special = "<|" in text or "\u03a3" in text or "\u0130" in text
        if special or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return text.split(" ")
        text = text.lower()
        if not _SIGNS.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split(" ")

    def _learn(self, new: set[str]) -> None:
        words = [p for p in new if p.isalpha()]
        odd = [p for p in new if not p.isalpha()]
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            if len(ends) != len(group):  # one of them is several words to the tokenizer
                odd += group
                continue
            raw = ids.tobytes()
            self.known.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        for part, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[part] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for first in range(0, len(texts), 256):
            if not self.in_parts:
                for e in self.tokenizer.encode_batch_fast(texts[first : first + 256], add_special_tokens=False):
                    yield np.asarray(e.ids, "<u4").tobytes()
                continue
            split = [self.parts(t) for t in texts[first : first + 256]]
            if len(self.known) > CACHE:
                self.known.clear()
            new = set().union(*split).difference(self.known)
            if new:
                self._learn(new)
            for parts in split:
                yield b"".join(map(self.known.__getitem__, parts))


def token_bytes(texts: list[str], tokenizer_path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
    return _encoders[tokenizer_path].encode(texts)


class Bins:
    """Best fit over classes of equal bins; an item class of n equal items is placed in bulk."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_free, self.mask = capacity, defaultdict(list), 0

    def _put(self, free: int, count: int, slots: tuple) -> None:
        self.by_free[free].append((count, slots))
        self.mask |= 1 << free

    def _take(self, size: int):
        fits = self.mask >> size
        if not fits:
            return None
        free = size + ((fits & -fits).bit_length() - 1)
        group = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        return free, *group

    def add(self, size: int, count: int, key: object) -> None:
        """Slots are (key, first rank, size): bin j of a class holds item first rank + j of the key."""
        rank = 0
        while count:
            found = self._take(size)
            if found is None:
                bins = -(-count // (self.capacity // size)) if size else 1
                free, slots = self.capacity, ()
            else:
                free, bins, slots = found
            n = min(bins, count)
            if n < bins:
                self._put(free, bins - n, tuple((k, first + n, s) for k, first, s in slots))
            self._put(free - size, n, (*slots, (key, rank, size)))
            rank += n
            count -= n

    def classes(self) -> Iterator[tuple[int, int, tuple]]:
        for free, groups in sorted(self.by_free.items()):
            for count, slots in groups:
                yield self.capacity - free, count, slots


def _leaf(capacity: int, tokenizer_path: str, end_id: int):
    def pack(node: int, pieces: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([p[3] for p in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        bins = Bins(capacity)
        for i in order.tolist():
            bins.add(int(lengths[i]), 1, i)
        rows, ranks = [None] * len(pieces), defaultdict(int)
        for fill, _, slots in bins.classes():
            rank, at = ranks[fill], 0
            ranks[fill] += 1
            for i, _, size in slots:
                rows[i] = (node, fill, rank, at)
                at += size
        cols = list(zip(*[p + r for p, r in zip(pieces, rows)]))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        end, width, pieces, docs = np.asarray([end_id], "<u4").tobytes(), 4 * capacity, [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), token_bytes(part.column(1).to_pylist(), tokenizer_path)):
                    ids += end
                    for k in range(0, len(ids), width):
                        one = ids[k : k + width]
                        pieces.append((doc_id, k // width, k // 4, len(one) // 4, zlib.crc32(one)))
                    docs += 1
                if docs >= LEAF:
                    yield pack(node, pieces)
                    node, pieces, docs = node + NEXT_LEAF, [], 0
        if pieces:
            yield pack(node, pieces)

    return run


def _merge(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = int(pdf["parent"].iloc[0])
        bins = Bins(capacity)
        pdf = pdf.sort_values(["fill", "child"], ascending=[False, True])
        for child, fill, n in zip(pdf["child"].tolist(), pdf["fill"].tolist(), pdf["n"].tolist()):
            bins.add(fill, n, (child, fill))
        rows, ranks = [], defaultdict(int)
        for fill, count, slots in bins.classes():
            at = 0
            for (child, size), first, _ in slots:
                rows.append((child, size, first, first + count, parent, fill, ranks[fill], at))
                at += size
            ranks[fill] += count
        return pd.DataFrame(rows, columns=["child", "size", "first", "last", "parent", "into_fill", "into_rank", "into_at"])

    return run


@releasing
def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then end_id; only one longer than capacity is cut, into pieces of capacity and a rest. Null
    and empty texts are the end id alone. Each row of docs is a document, so repeated rows are packed as often, and null ids
    stay null. An empty table gives no rows. Pieces of a sequence follow each other from offset 0 without gaps.
    """
    path = tokenizer_path or default_tokenizer()
    pieces = materialize(id_and_text(docs, id_col, text_col).mapInArrow(_leaf(capacity, path, end_id), _PIECES))
    final_fill = capacity - slack
    hist = pieces.where(F.col("fill") < final_fill).groupBy(F.col("node").alias("child"), "fill").agg((F.max("rank") + 1).alias("n"))
    highest = pieces.agg(F.max("node")).first()[0] or 0
    level, nodes = 0, highest + 1
    name = lambda level, nodes: ((F.col("rank") * nodes + F.col("node")) * (capacity + 1) + F.col("fill")) * 16 + level
    done = [pieces.where(F.col("fill") >= final_fill).withColumn("sequence_id", name(0, nodes))]
    open_ = pieces.where(F.col("fill") < final_fill)
    while True:
        level += 1
        nodes = -(-nodes // FAN)
        moves = materialize(hist.withColumn("parent", F.floor(F.col("child") / FAN).cast("long")).groupBy("parent").applyInPandas(_merge(capacity), "child long, size int, first long, last long, parent long, into_fill int, into_rank long, into_at long"))
        here = (F.col("node") == F.col("child")) & (F.col("fill") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
        placed = open_.join(moves, here).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("parent").alias("node"), F.col("into_fill").alias("fill"), (F.col("into_rank") + F.col("rank") - F.col("first")).alias("rank"), (F.col("at") + F.col("into_at")).alias("at"))
        if nodes == 1:
            done.append(placed.withColumn("sequence_id", name(level, nodes)))
            break
        placed = materialize(placed)  # read by this level's bins and by the next level
        done.append(placed.where(F.col("fill") >= final_fill).withColumn("sequence_id", name(level, nodes)))
        open_ = placed.where(F.col("fill") < final_fill)
        hist = moves.where(F.col("into_fill") < final_fill).groupBy(F.col("parent").alias("child"), F.col("into_fill").alias("fill")).agg(F.max(F.col("into_rank") + F.col("last") - F.col("first")).alias("n"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("at").alias("offset"))
