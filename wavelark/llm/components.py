"""Connected components: forests within partitions, then alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import materialize

#: Nodes of a forest that a task holds at once.
HELD = 500_000


class Forest:
    """Sets that are joined; each is named by its least node."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while x != top:  # what is on the way points to the top from now on
            root[x], x = top, root[x]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)
        return a != b

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.root) if self.find(x) != x]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each node with the least one that the partition ties it to."""

    def out(forest: Forest) -> pa.RecordBatch:
        stars = forest.stars()
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["u", "v"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.root) > HELD:
            yield out(forest)
            forest = Forest()
    yield out(forest)


def _attach_least(pairs: DataFrame) -> DataFrame:
    """pairs u, v: adds m, the least v of each u. Both sides are tables, so that Spark can split a hot u."""
    return pairs.join(materialize(pairs.groupBy("u").agg(F.min("v").alias("m"))), "u")


def _settled(stars: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where(F.col("out") + F.col("into") > 1).isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b. Returns node, component (the least node reachable) for every node that has an edge to another.

    Nulls and self-loops are ignored. The number of rounds grows with the logarithm of the longest path between partitions.
    """
    real = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = materialize(real.mapInArrow(_contracted, "u long, v long").distinct())
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _attach_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large)
        least = _attach_least(large)
        small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
