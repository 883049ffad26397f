"""Exact deduplication by a distributed sort of whole contents.

Sampled splitters range-partition the texts by their beginning and digest (the row's id breaks ties, so a text that holds a
third of all rows spreads over many ranges), each range is sorted externally, and neighbours are compared in full. A group that touches the edge of a range,
or that is longer than SEGMENT rows, is closed by a second, small aggregation over the edges only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import id_and_text, materialize, releasing, same_columns, unpack

#: Rows of one group that a task holds at once.
SEGMENT = 100_000
#: Characters of a text that are in the splitters, which the driver holds; a digest orders what begins alike.
HEAD = 32
_ROWS = "doc_id long, text_sha256 string, seg string, top boolean, seg_key long, seg_size long, edge_text string, open boolean"


def _merge_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregation: equal texts of one Arrow batch travel once, with their ids."""
    for batch in batches:
        by_text: dict[str, list] = {}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_text.setdefault(text, []).append(doc_id)
        texts, ids = list(by_text), list(by_text.values())
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        ties = [next((i for i in x if i is not None), None) for x in ids]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array([t[:HEAD] for t in texts], pa.string()), pa.array(digests, pa.binary()), pa.array(ties, pa.int64())], ["text", "ids", "head", "digest", "tie"])


def _compare_neighbours(keep_largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        out: list[tuple] = []
        state = {"text": None, "sha": "", "ids": [], "n": 0, "edge": True}

        def close(at_edge: bool) -> None:
            ids, text = state["ids"], state["text"]
            if not ids:
                return
            keys = [None if i is None else (i if keep_largest else ~i) for i in ids]
            known = [k for k in keys if k is not None]
            best = max(known) if known else None
            first = keys.index(best)
            seg, is_open = f"{pid}-{state['n']}", state["edge"] or at_edge
            for j, i in enumerate(ids):
                out.append((i, state["sha"], seg, j == first, best, len(ids), text if is_open and j == first else None, is_open))
            state["n"] += 1
            state["ids"] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = [x.split()[0] for x in _ROWS.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()
            return batch

        for batch in batches:
            for text, ids, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if text != state["text"]:
                    close(False)
                    state["edge"] = state["text"] is None
                    state["text"], state["sha"] = text, digest.hex()
                state["ids"].extend(ids)
                if len(state["ids"]) >= SEGMENT:
                    close(True)
                    state["edge"] = True
            if len(out) >= 20_000:
                yield flush()
        close(True)
        if out:
            yield flush()

    return run


@releasing
def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of rows with equal text exactly one is kept: the one with the largest (or smallest) id; of
    repeated ids one of them; null ids lose to all others and are kept only where a group has no other id. An empty table
    gives an empty result. Further columns of docs are ignored.
    """
    merged = id_and_text(docs, id_col, text_col).mapInArrow(_merge_in_batch, "text string, ids array<long>, head string, digest binary, tie long")
    ranged = merged.repartitionByRange("head", "digest", "tie").sortWithinPartitions("head", "digest", "text", "tie").select("text", "ids", "digest")
    rows = materialize(ranged.mapInArrow(_compare_neighbours(keep == "largest"), _ROWS))
    edges = rows.where("edge_text is not null").select("seg", "edge_text", "seg_key", "seg_size")
    totals = edges.groupBy("edge_text").agg(F.max(F.struct("seg_key", "seg")).alias("best"), F.sum("seg_size").alias("size"))
    closed = materialize(edges.join(totals, "edge_text").select("seg", F.col("best.seg_key").alias("all_key"), (F.col("best.seg") == F.col("seg")).alias("wins"), "size"))
    to_id = lambda c: F.col(c) if keep == "largest" else F.bitwise_not(F.col(c))
    done = rows.where("not open").select("doc_id", to_id("seg_key").alias("keep_id"), F.col("seg_size").alias("group_size"), F.col("top").alias("kept"), "text_sha256")
    rest = rows.where("open").join(closed, "seg").select("doc_id", to_id("all_key").alias("keep_id"), F.col("size").alias("group_size"), (F.col("top") & F.col("wins")).alias("kept"), "text_sha256")
    return done.unionByName(rest)


@releasing
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with their columns. One row of each group of equal texts stays (see exact_groups)."""
    key = lambda i, sha: F.concat_ws(":", sha, F.coalesce(i.cast("string"), F.lit("-")))
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    packed = docs.select(same_columns(docs), key(F.col(f"`{id_col}`").cast("long"), sha).alias("_key"))
    # rows that repeat both id and text are told apart by nothing that the group knows: any one of them stays
    found = packed.join(kept.hint("shuffle_hash"), "_key", "left_semi").dropDuplicates(["_key"])
    return unpack(found, docs.columns)
