"""Finding windows that also start in a document with a smaller id, without comparing documents with each other.

A window (so many units: bytes or words) belongs to its anchor, the least hash of a k-gram in it; equal windows have equal
anchors, wherever they stand. The plan has three steps, each a shuffle of something smaller than the text:

1. the anchors go to shards, which answer which of them occur in two or more documents;
2. only for such anchors, the stretch of text that their windows cover goes to the anchor's shard, where the operator's own
   matcher (suffix arrays, or relative Lempel-Ziv parsing) finds windows of smaller documents;
3. the spans found go back to their documents.

Whole copies of a text are settled beforehand by a digest. Within one Arrow batch, equal anchors and equal stretches are merged
before they are shuffled, so a passage that a third of all documents share reaches its shard once a batch. Windows of a hot
anchor (one that many batches sent) belong to the anchor and a second one, the least hash by another order, so they spread over
shards by what else is in them. Long texts are read in chunks and long stretches are cut, so a text of any length and of however
few different letters takes bounded memory beyond itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import id_and_text, materialize, mix64, releasing, shard_count, sliding_min

#: Stretches of a batch that are merged at once, and their bytes.
HELD, HELD_BYTES = 60_000, 32 << 20
#: Shards of the second step for each of the first: it holds text and indexes.
MATCH_SHARDS = 4
#: Windows of one stretch.
LONGEST = 4096
#: An anchor is hot if so many rows (of a batch, or of a document alone in its batch) came with it; at most so many are told
#: to the tasks, the hottest (8 bytes each). Which are hot decides on where windows meet and never on what is found.
HOT, MOST_HOT = 1_000, 1_000_000
#: What an operator makes of a text column: for each row its index and its Chunks, in order.
Units = Callable[[pa.Array], Iterator[tuple[int, "Chunk"]]]


class Chunk:
    """Units of a text from number `base` on, with the start of no window twice.

    grams[i] is the hash of the k-gram that starts at unit base + i; take(a, b) packs units base + a to base + b.
    """

    __slots__ = ("base", "grams", "take")

    def __init__(self, base: int, grams: np.ndarray, take: Callable[[int, int], bytes]) -> None:
        self.base, self.grams, self.take = base, grams, take

    def anchors(self, window: int, k: int) -> np.ndarray:
        """The distinct anchors."""
        least = sliding_min(self.grams, window - k + 1)
        return np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])]) if len(least) else least

    def stretches(self, window: int, k: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that belong together: anchor, place (the anchor or both), first and last window."""
        least = sliding_min(self.grams, window - k + 1)
        if not len(least):
            return least, least, np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = least
        if len(hot) and (is_hot := np.isin(_short(least), hot)).any():
            second = sliding_min(mix64(self.grams ^ np.uint64(0xA0761D6478BD642F)), window - k + 1)
            place = np.where(is_hot, mix64(least + second * np.uint64(0xE7037ED1A0B428DB)), least)
        cut = np.flatnonzero((place[1:] != place[:-1]) | (least[1:] != least[:-1])) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(least)]])
        parts = -(-(end - first) // LONGEST)
        if parts.max() > 1:
            run = np.repeat(np.arange(len(first)), parts)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
            first, end = first[run] + nth * LONGEST, np.minimum(first[run] + (nth + 1) * LONGEST, end[run])
        return least[first], place[first], first, end - 1


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    """The 40 bits of a hash that are compared within a shard; a chance agreement only costs a look at the text."""
    return h >> np.uint64(24)


_SEVERAL = 0xFFFF
#: Documents whose hashes are sorted together: fewer than _SEVERAL.
TOGETHER = 10_000


def _tell(units: Units, window: int, k: int, shards: int):
    """Step 1, map side: packed rows of (hash, document), and answers for hashes that meet within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                yield from told(whole.slice(start, TOGETHER))

    def told(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys, digests = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        # of equal texts only the first document matters, the others are whole copies
        order = np.lexsort((ids, digests))
        first = np.concatenate([[True], digests[order][1:] != digests[order][:-1]])
        batch = batch.take(pa.array(np.sort(order[first])))
        ids, keys, digests = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        hashes, owners = [], []
        for i, chunks in groupby(units(batch.column(3)), key=lambda x: x[0]):
            parts = [h for _, chunk in chunks if len(h := chunk.anchors(window, k))]
            if parts:
                h = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
                hashes.append(h)
                owners.append(np.full(len(h), i, np.uint16))
        if not hashes:
            return
        h, d = np.concatenate(hashes), np.concatenate(owners)
        del hashes, owners
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        several = np.zeros(len(h), bool)
        several[1:] |= ~new[1:]
        several[:-1] |= ~new[1:]
        rows: list[tuple] = []
        answered = np.flatnonzero(several)
        if len(answered):  # these documents know already
            answered = answered[np.argsort(d[answered], kind="stable")]
            docs, at = np.unique(d[answered], return_index=True)
            for doc, part in zip(docs.tolist(), np.split(_short(h[answered]), at[1:])):
                rows.append((int(keys[doc] % shards), int(keys[doc]), None, part.tobytes()))
        h, d, single = h[new], d[new], ~several[new]
        shard = _shard_of(h, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.unique(shard).tolist():
            part = order[cuts[s] : cuts[s + 1]]
            docs, local = np.unique(d[part], return_inverse=True)
            low = _short(h[part])
            blob = low.astype("<u4").tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes() + np.where(single[part], local, _SEVERAL).astype("<u2").tobytes()
            rows.append((s, None, np.stack([keys[docs], digests[docs]]).astype("<i8").tobytes(), blob))
            if len(rows) >= 500:
                yield _batch(rows, _HEARD)
                rows = []
        if rows:
            yield _batch(rows, _HEARD)

    return run


_HEARD = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("owners", pa.binary()), ("blob", pa.binary())])
_TOLD = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("owners", pa.binary()), ("blob", pa.binary())])
_ANSWER = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("blob", pa.binary())])
_PACKED = pa.schema([("home", pa.int32()), ("owners", pa.binary()), ("blob", pa.binary())])
#: The home of a row that tells hot anchors (blob) and their rows (owners).
_HOT_HOME = -1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _packed(rows: list[tuple[int, int, bytes]], homes: int, hot: tuple[bytes, bytes] | None = None) -> pa.Table:
    """Rows of (document, key, bytes) as one row a home, the key's remainder."""
    by_home: dict[int, list[tuple[int, int, bytes]]] = {}
    for row in rows:
        by_home.setdefault(row[1] % homes, []).append(row)
    out = [(home, np.array([(d, k, len(b)) for d, k, b in part], "<i8").tobytes(), b"".join(b for _, _, b in part)) for home, part in by_home.items()]
    if hot:
        out.append((_HOT_HOME, *hot))
    return pa.Table.from_batches([_batch(out, _PACKED)])


def _gathered(table: pa.Table) -> pa.Table:
    """One row a document from the packed rows of a home."""
    by_doc: dict[tuple[int, int], list[bytes]] = {}
    for owners, blob in zip(table["owners"].to_pylist(), table["blob"].to_pylist()):
        at = 0
        for doc, key, n in np.frombuffer(owners, "<i8").reshape(-1, 3).tolist():
            by_doc.setdefault((doc, key), []).append(blob[at : at + n])
            at += n
    return pa.Table.from_batches([_batch([(doc, key, b"".join(parts)) for (doc, key), parts in by_doc.items()], _ANSWER)])


def _answer(homes: int, least_hot: int):
    """Step 1, shard side: to each document (by its key), which of its hashes a document with another text has too; and hot ones."""

    def run(table: pa.Table) -> pa.Table:
        owners, blobs, keys = (table[c].to_pylist() for c in ("owners", "blob", "key"))
        rows = [(0, keys[i], blobs[i]) for i in range(len(blobs)) if owners[i] is None]
        hashes, doc, own, base = [], [], [], 0
        for who, blob in zip(owners, blobs):
            if who is None:
                continue
            n = len(blob) // 7
            hashes.append(np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))
            local = np.frombuffer(blob, "<u2", n, 5 * n).astype(np.int64)
            doc.append(np.where(local == _SEVERAL, -1, local + base))
            own.append(np.frombuffer(who, "<i8").reshape(2, -1))
            base += own[-1].shape[1]
        del owners, blobs
        hot = None
        if hashes:
            h, d, who = np.concatenate(hashes), np.concatenate(doc), np.concatenate(own, axis=1)
            del hashes, doc, own
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            if (size >= least_hot).any():
                hot = size[size >= least_hot].astype("<i8").tobytes(), h[first][size >= least_hot].astype("<u8").tobytes()
            text = np.where(d >= 0, who[1][d], 0)
            several = np.maximum.reduceat(d < 0, first)
            shared = (size > 1) & (several | (np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)))
            told = np.flatnonzero(np.repeat(shared, size) & (d >= 0))
            if len(told):
                told = told[np.argsort(d[told], kind="stable")]
                docs, at = np.unique(d[told], return_index=True)
                for x, part in zip(docs.tolist(), np.split(h[told], at[1:])):
                    rows.append((0, int(who[0, x]), part.tobytes()))
        return _packed(rows, homes, hot)

    return run


def _hottest(answers: DataFrame) -> np.ndarray:
    """The hot anchors, MOST_HOT at most: a bounded list."""
    packed = "size long, anchor long"

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in (sizes, anchors)], ["size", "anchor"])

    rows = answers.where(F.col("home") == _HOT_HOME).select("owners", "blob").mapInArrow(unpacked, packed)
    return np.sort(rows.orderBy(F.desc("size"), "anchor").limit(MOST_HOT).select("anchor").toArrow()["anchor"].to_numpy().astype(np.uint64))


def _stretches(units: Units, window: int, k: int, shards: int, hot: np.ndarray):
    """Step 2, map side: the stretches of shared anchors, packed by shard; equal ones of a batch are settled here."""

    def packed(found: dict, spans: dict, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = [(int(keys[i] % shards), int(ids[i]), int(keys[i]), None, np.asarray(s, "<i8").tobytes()) for i, s in spans.items()]
        by_shard: dict[int, list] = {}
        for content, (shard, doc, places) in found.items():
            by_shard.setdefault(shard, []).extend((content, doc, i, start) for i, start in places)
        for s, items in by_shard.items():
            rows_of = sorted({i for _, _, i, _ in items})
            place = {i: n for n, i in enumerate(rows_of)}
            who = np.array([[ids[i], keys[i]] for i in rows_of], "<i8").tobytes()
            where = np.array([[place[i], start, len(c)] for c, _, i, start in items], "<i8").T.tobytes()
            rows.append((s, None, None, zlib.compress(struct.pack("<i", len(rows_of)) + who + where, 1), zlib.compress(b"".join(x[0] for x in items), 1)))
        for n in range(0, len(rows), 500):
            yield _batch(rows[n : n + 500], _TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            found: dict[bytes, tuple[int, int, list[tuple[int, int]]]] = {}  # shard, least document, its places
            spans: dict[int, list[tuple[int, int]]] = {}
            held = 0
            for i, chunk in units(batch.column(2)):
                anchor, place, first, last = chunk.stretches(window, k, hot)
                if not len(anchor):
                    continue
                chosen = np.flatnonzero(np.isin(_short(anchor), np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)))
                shard = _shard_of(place[chosen], shards).tolist()
                me = int(ids[i])
                for s, a, b in zip(shard, first[chosen].tolist(), last[chosen].tolist()):
                    content = chunk.take(a, b + window)
                    at, n = chunk.base + a, b - a + window
                    other = found.get(content)
                    if other is None or me < other[1]:
                        held += len(content) if other is None else 0
                        found[content] = (s, me, [(i, at)])
                        for row, start in other[2] if other else ():
                            spans.setdefault(row, []).append((start, start + n))
                    elif me == other[1]:
                        other[2].append((i, at))
                    else:
                        spans.setdefault(i, []).append((at, at + n))
                    if len(found) >= HELD or held >= HELD_BYTES:
                        yield from packed(found, spans, ids, keys)
                        found, spans, held = {}, {}, 0
            yield from packed(found, spans, ids, keys)

    return run


def _match(matcher: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, int, int]]], length_of: Callable[[bytes], int], homes: int):
    """Step 2, shard side. matcher: gets sorted (document id, stretch) pairs, gives (index, first unit, end unit) within stretches."""

    def run(table: pa.Table) -> pa.Table:
        owners, blobs = table["owners"].to_pylist(), table["blob"].to_pylist()
        ids, keys = table["doc_id"].to_pylist(), table["key"].to_pylist()
        rows = [(ids[i], keys[i], blobs[i]) for i in range(len(blobs)) if owners[i] is None]
        # equal stretches are one: the least document's goes on, later documents repeat it from end to end
        stretches: dict[bytes, list[tuple[int, int, int]]] = {}
        for who, blob in zip(owners, blobs):
            if who is None:
                continue
            content, who, at = zlib.decompress(blob), zlib.decompress(who), 0
            n_docs = struct.unpack_from("<i", who)[0]
            docs = np.frombuffer(who, "<i8", 2 * n_docs, 4).reshape(-1, 2).tolist()
            for local, start, n in np.frombuffer(who, "<i8", offset=4 + 16 * n_docs).reshape(3, -1).T.tolist():
                stretches.setdefault(content[at : at + n], []).append((*docs[local], start))
                at += n
        del owners, blobs
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        whole: list[tuple[int, bytes]] = []
        for content, places in stretches.items():
            least = min(p[0] for p in places)
            whole.append((least, content))
            stretches[content] = [p for p in places if p[0] == least]
            for doc, key, start in places:
                if doc > least:
                    spans.setdefault((doc, key), []).append((start, start + length_of(content)))
        whole.sort()
        for i, a, b in matcher(whole):
            for doc, key, start in stretches[whole[i][1]]:
                spans.setdefault((doc, key), []).append((start + a, start + b))
        return _packed(rows + [(doc, key, np.asarray(s, "<i8").tobytes()) for (doc, key), s in spans.items()], homes)

    return run


def union_of(blob: bytes) -> np.ndarray:
    """Sorted disjoint spans (rows of start, end) that cover what the packed spans cover; touching spans are one."""
    spans = np.frombuffer(blob, "<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], ends[np.concatenate([first[1:] - 1, [len(spans) - 1]])]], axis=1)


def digest_of(text: str) -> Column:
    return F.sha2(text, 256)


def key_of(doc_id: str, digest: Column | str) -> Column:
    """The key of a row of repeated_spans: rows equal in id (null: the largest) and text share it."""
    return F.xxhash64(doc_id, digest).bitwiseAND(F.lit((1 << 63) - 1))


@releasing
def repeated_spans(docs: DataFrame, units: Units, matcher, window: int, k: int, length_of: Callable[[bytes], int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """The texts (doc_id, key, text) and, for rows with something repeated, (doc_id, key, copy, spans).

    copy: a document with a smaller id has the whole same text. Null ids count as the largest id. Rows equal in id and text share
    a key and so their result. length_of: the units of a packed stretch.
    """
    largest = (1 << 63) - 1
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(largest)))
    texts = texts.select("doc_id", F.col("text"), digest_of("text").alias("digest"))
    keyed = texts.select("doc_id", key_of("doc_id", "digest").alias("key"), "text", "digest")
    shards = shard_count(docs)
    told = keyed.select("doc_id", "key", F.xxhash64("digest").alias("print"), "text").mapInArrow(_tell(units, window, k, shards), "shard int, key long, owners binary, blob binary")
    answers = materialize(told.groupBy("shard").applyInArrow(_answer(shards, HOT), "home int, owners binary, blob binary"))
    hot = _hottest(answers)
    answers = answers.where(F.col("home") != _HOT_HOME).groupBy("home").applyInArrow(_gathered, "doc_id long, key long, blob binary")
    lean = materialize(keyed.select("doc_id", "key", "digest"))
    firsts = materialize(lean.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"))
    copies = materialize(lean.join(firsts, "digest").where("doc_id > least").select("doc_id", "key").distinct())
    # two documents that happened to share a key would only be told each other's hashes too
    marks = answers.select("key", F.col("blob").alias("told")).join(copies.groupBy("key").agg(F.collect_set("doc_id").alias("copied")), "key", "left")
    asked = keyed.select("doc_id", "key", "text").join(marks.hint("shuffle_hash"), "key").where(F.col("copied").isNull() | ~F.array_contains("copied", F.col("doc_id"))).select("doc_id", "key", "text", "told")
    pieces = asked.mapInArrow(_stretches(units, window, k, MATCH_SHARDS * shards, hot), "shard int, doc_id long, key long, owners binary, blob binary")
    spans = pieces.groupBy("shard").applyInArrow(_match(matcher, length_of, shards), "home int, owners binary, blob binary").groupBy("home").applyInArrow(_gathered, "doc_id long, key long, blob binary")
    found = spans.select("doc_id", "key", F.col("blob").alias("spans"), F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "key", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("copy")))
    return keyed.select("doc_id", "key", "text"), materialize(found)
