"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard verification.

One permutation (the 64-bit hash of a shingle, cut to 32 bits) places shingles on a circle; a second one, `_permute`, is shifted
along it by one step a coordinate, so two permutations give the whole signature. Rows of one band value are candidates.

No bucket is expanded into its pairs. Documents with the same words in the same order are one class. In each bucket every class
is first compared with one class, and in further rounds what is not yet in the bucket's largest component with another class of
that one, which links nearly all of a group of copies. Only classes that are then still apart are compared with the bucket's
other classes, and only where sizes allow a link, so no link between different components is left out. Every link is decided
on the full sets of shingles of real words: hashes only choose what is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import WordHasher, gram_hashes, id_and_text, materialize, mix64, releasing, same_columns, unpack
from wavelark.llm.components import connected_components

#: A pair at a similarity of exactly 0.8 shares no band with a probability of (1 - 0.8 ** 6) ** 42, 3 in a million.
ROWS, BANDS = 6, 42
#: Rounds in which what is apart from a bucket's largest component meets one class of it; what then remains meets all.
ROUNDS = 4
#: Classes of a block where buckets are compared in full.
BLOCK = 256
#: Rows and bytes of text that are verified together.
TOGETHER, TOGETHER_BYTES = 128, 4 << 20
_CHUNK = 32_768


def split_words(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each row, A-Z lower-cased; bytes.split parts at just the six ASCII white space characters."""
    for raw in column.cast(pa.binary()).to_pylist():
        yield (raw or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int, hasher: WordHasher) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; too short a text is one shingle."""
    h = hasher(words)
    if len(words) >= size:
        return np.unique(gram_hashes(h, size))
    return mix64(gram_hashes(h, len(words)) + np.uint64(len(words))) if words else np.zeros(0, np.uint64)


def exact_shingles(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted numbers, equal among these texts where the words are equal and only there."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for words in texts for w in words], np.int64)
    place = ids
    for k in range(1, size):  # the runs of k words get numbers, then those of k + 1 words
        place = place[: max(0, len(ids) - k)] * max(1, len(names)) + ids[k:]
        if k + 1 < size and len(place):
            place = np.unique(place, return_inverse=True)[1].astype(np.int64)
    out, at = [], 0
    short: dict[tuple[bytes, ...], int] = {}
    for words in texts:
        if len(words) >= size:
            out.append(np.unique(place[at : at + len(words) - size + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(words), len(short))] if words else [], np.int64))
        at += len(words)
    return out


def _permute(z: np.ndarray, t: np.ndarray) -> None:
    """A permutation of the 32-bit numbers, in place."""
    np.right_shift(z, 16, out=t)
    np.bitwise_xor(z, t, out=z)
    np.multiply(z, np.uint32(0x7FEB352D), out=z)
    np.right_shift(z, 15, out=t)
    np.bitwise_xor(z, t, out=z)
    np.multiply(z, np.uint32(0x846CA68B), out=z)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """MinHash signatures of sets that aren't empty, one row each."""
    out = np.empty((coordinates, len(sets)), np.uint32)
    first = 0
    while first < len(sets):
        last, n = first + 1, len(sets[first])
        while last < len(sets) and n + len(sets[last]) <= _CHUNK:
            n += len(sets[last])
            last += 1
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]])]).astype(np.int64) if last - first > 1 else np.zeros(1, np.int64)
        z, t = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.add(x, np.uint32(k), out=z)
            _permute(z, t)
            out[k, first:last] = np.minimum.reduceat(z, at)
        first = last
    return out.T


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.shape[1] // rows
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key ^ parts[:, :, r])
    return key.view(np.int64)


def _sign(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sets, prints = [], []
                for text in split_words(part.column(1)):
                    sets.append(shingle_hashes(text, words, hasher))
                    prints.append(hashlib.blake2b(b" ".join(text), digest_size=16).digest())
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, band_keys(signatures([sets[i] for i in full], rows * bands), rows)):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print", "bands"])

    return run


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(w) for w in split_words(batch.column(1))], pa.binary())], ["id", "members"])


def _verify(words: int, percent: int):
    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        place: dict[bytes, int] = {}
        sides = [[place.setdefault(text, len(place)) for text in batch.column(c).to_pylist()] for c in (2, 3)]
        sets = exact_shingles([text.split() for text in place], words)
        keep = []
        for a, b in zip(*sides):
            short, long_ = sorted((sets[a], sets[b]), key=len)
            at = np.searchsorted(long_, short)
            at[at == len(long_)] = 0
            both = int(np.count_nonzero(long_[at] == short))
            keep.append(100 * both >= percent * (len(short) + len(long_) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows = max(1, min(TOGETHER, TOGETHER_BYTES * batch.num_rows // max(1, batch.nbytes)))
                yield linked(batch.slice(at, rows))
                at += rows

    return run


@releasing
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * shared >= percent * union of their distinct shingles of so many words (A-Z lower-cased,
    words between ASCII white space; a shorter document is one shingle). Null and empty texts, and rows with a null id, are
    linked with nothing; a null id gives a null component and is kept. Rows that repeat an id are one node, linked as any of
    their texts is. An empty table gives no rows.
    """
    texts = id_and_text(docs, id_col, text_col)
    signed = materialize(texts.mapInArrow(_sign(words, rows, bands), "doc_id long, n_shingles long, print binary, bands array<long>"))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    least = materialize(real.groupBy("print").agg(F.min("doc_id").alias("class")))
    classes = materialize(real.join(least.withColumnRenamed("class", "doc_id"), ["print", "doc_id"]).withColumnRenamed("doc_id", "class").groupBy("class", "print").agg(F.max("n_shingles").alias("n"), F.max("bands").alias("bands")).drop("print"))
    members = real.select("doc_id", "print").join(least, "print").select(F.col("doc_id").alias("a"), F.col("class").alias("b")).where("a <> b")

    buckets = classes.select("class", "n", F.explode("bands").alias("band"))
    shared = materialize(buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"))
    active = materialize(buckets.join(shared, "band"))
    wanted = materialize(active.select(F.col("class").alias("id")).distinct())
    chosen = texts.withColumnRenamed("doc_id", "id").join(wanted.hint("shuffle_hash"), "id", "left_semi")
    texts = materialize(chosen.mapInArrow(_normalised, "id long, members binary"))

    fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    component: DataFrame | None = None  # node, component
    before = None
    for step in range(ROUNDS + 1):
        active, apart = _apart(active, component, step)
        left = apart.count()
        if not left or step == ROUNDS or (before is not None and left > 0.7 * before):
            break
        before = left
        pairs = apart.where((F.col("class") != F.col("pivot")) & fits(F.col("n"), F.col("pivot_n"))).select(F.greatest("class", "pivot").alias("a"), F.least("class", "pivot").alias("b")).distinct()
        component = _joined_components(component, _links(texts, materialize(pairs), words, percent))
    if left:
        component = _joined_components(component, _met(active, apart, texts, words, percent))
    component = _joined_components(component, members)
    labelled = signed.select("doc_id", "n_shingles").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _met(active: DataFrame, apart: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of what is still apart with the other components of all its buckets: blocks of a bucket meet blocks of its rows apart."""
    count = lambda rows, name: rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = materialize(count(apart, "asks").join(count(active, "blocks"), "band"))
    part = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = active.select("band", "class", "own").join(blocks, "band").select("band", part("blocks").alias("block"), every("asks").alias("ask"), "class", "own", F.lit(0).alias("role"))
    here = apart.select("band", "class", "own").join(blocks, "band").select("band", every("blocks").alias("block"), part("asks").alias("ask"), "class", "own", F.lit(1).alias("role"))
    rows = there.unionByName(here).join(texts.withColumnRenamed("id", "class"), "class")
    return materialize(rows.groupBy("band", "block", "ask").applyInArrow(_meet(words, percent), "a long, b long").distinct())


def _meet(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        role, ids, own = table["role"].to_numpy(), table["class"].to_numpy(), table["own"].to_numpy()
        sets = exact_shingles([m.split() for m in table["members"].to_pylist()], words)
        there, here = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        a, b = [], []
        if len(there) and len(here):
            size = np.array([len(sets[i]) for i in there])
            every = np.concatenate([sets[i] for i in there])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(there)), size)[order]
            for i in here.tolist():
                first, last = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
                n = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(there))
                good = (100 * both >= percent * (size + len(sets[i]) - both)) & (own[there] != own[i])
                a += [int(ids[i])] * int(good.sum())
                b += ids[there[good]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _apart(active: DataFrame, component: DataFrame | None, step: int) -> tuple[DataFrame, DataFrame]:
    """Of the buckets that hold several components: all rows, and those outside the bucket's largest component.

    Rows get own (component), main (the bucket's largest one), pivot and pivot_n (one of its classes, another each step).
    """
    rows = active.select("band", "class", "n")
    if component is None:
        rows = rows.withColumn("own", F.col("class"))
    else:
        rows = rows.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn("own", F.coalesce("component", "class")).drop("component")
    rows = materialize(rows)
    pick = F.struct(F.lit(0) if step == 0 else F.xxhash64(F.lit(step), "class"), F.col("class").alias("pivot"), F.col("n").alias("pivot_n"))
    parts = rows.groupBy("band", "own").agg(F.count("*").alias("size"), F.min(pick).alias("pick"))
    largest = F.max_by(F.struct("own", "pick"), F.struct("size", -F.col("own")))
    mains = materialize(parts.groupBy("band").agg(largest.alias("m"), F.count("*").alias("parts")).where("parts > 1").select("band", F.col("m.own").alias("main"), F.col("m.pick.pivot").alias("pivot"), F.col("m.pick.pivot_n").alias("pivot_n")))
    rows = materialize(rows.join(mains, "band"))
    return rows, rows.where("own <> main")


def _joined_components(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after further links a, b, found among the components so far."""
    if component is None:
        return materialize(connected_components(links))
    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"{side}_own"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_own", "a").alias("a"), F.coalesce("b_own", "b").alias("b"))
    more = materialize(connected_components(lifted)).withColumnRenamed("component", "final")
    kept = component.join(more.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    new = more.join(component.select("node"), "node", "left_anti").select("node", F.col("final").alias("component"))
    return materialize(kept.unionByName(new))


def _links(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs a, b that are similar enough, decided on the full sets."""
    left, right = texts.select(F.col("id").alias("a"), F.col("members").alias("left")), texts.select(F.col("id").alias("b"), F.col("members").alias("right"))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify(words, percent), "a long, b long").distinct())


@releasing
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with their columns: of each group of linked documents the one with the least id.

    Rows that repeat the id that stays all stay; null ids stay.
    """
    gone = near_duplicates(docs, id_col, text_col, words, percent).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(same_columns(docs), F.col(f"`{id_col}`").cast("long").alias("_id"))
    return unpack(rows.join(gone.hint("shuffle_hash"), "_id", "left_anti"), docs.columns)
