"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents queue in the order of a hash, once for each round that the targets allow. A document's virtual finish
time is the source's cumulative size up to its end divided by the source's target; all queues are merged in that order and the
mix is cut where the total budget is used up. Running sums are taken in two steps, over buckets of the order and within a
bucket, so no source and no merged queue ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.llm.common import materialize, releasing, same_columns, unpack

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rows that one bucket of the order is meant to hold, and how many buckets there are at most: their sums meet in one task.
BUCKET_ROWS, MOST_BUCKETS, MOST_SLOTS = 2_000, 1 << 16, 2
#: Sources up to which their targets are broadcast; beyond, they are joined.
BROADCAST_SOURCES = 10_000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for a table of source and source_size.

    Weights repeat over the sources by code point, null last. The budget is share times all sizes, by weight; a target stops at
    most times its source's size and the excess is shared again by weight among the others, until none is above. That fixed
    point has a closed form: sources fill up in the order of size over weight, so the level is found with running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = w.withColumn("budget", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level rises up to the first source whose cap is above it and falls after, so that source has the largest one
    w = w.withColumn("lowest", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    target = F.when(F.col("lowest").isNull() | (F.col("cap") <= F.col("lowest") * F.col("weight")), F.col("cap")).otherwise(F.col("lowest") * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


@releasing
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted), copies, place.

    Null texts count as empty (size 0; no words to take, so no copies); a null source is one source, the last. Repeated rows
    are rows of their own: their order is a hash of id and text, and rows equal in both share one place. An empty table gives
    no rows.
    """
    return _queue(docs, id_col, text_col, source_col, weights, share, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "place")


@releasing
def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus: the rows of docs with their columns, each as often as mix() takes it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    copies = mix(docs, id_col, text_col, source_col, weights, share, most).where("copies > 0").groupBy("place").agg(F.max("copies").alias("copies"))
    rows = docs.select(same_columns(docs), _place(docs, id_col, text).alias("place"))
    found = rows.join(copies.hint("shuffle_hash"), "place").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpack(found, docs.columns)


def _place(docs: DataFrame, id_col: str, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("-")), text))


def _queue(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = materialize(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), _place(docs, id_col, text).alias("place")))
    buckets = min(MOST_BUCKETS, max(1, base.count() // BUCKET_ROWS))

    goals = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = materialize(goals.withColumn("q", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))))
    small = goals.count() <= BROADCAST_SOURCES
    sided = (F.broadcast(goals) if small else goals).withColumnRenamed("source", "_source")
    # the first 8 hex digits of a place, as a fraction of its queue
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.lit(buckets)).cast("long")
    rows = base.join(sided, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "place", "q", "source_size", "target", part.alias("part"))

    sums = rows.groupBy("q", "part").agg(F.sum("size").alias("part_size"))
    ahead = sums.select("q", "part", F.coalesce(F.sum("part_size").over(Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("q", "part").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(ahead, ["q", "part"])
    placed = materialize(placed.withColumn("end", F.col("upto") + F.col("ahead")).drop("upto", "ahead", "part"))

    # virtual finish times of the copies; the merged queue is cut in the bucket in which the budget runs out
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("end")).cast("double") / F.col("target")
    copies = placed.where("target > 0 and size > 0").select("q", "place", "size", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), finish(e).alias("finish")) for e in range(most)])).alias("c")).select("q", "place", "size", "c.*")
    # copies past the bound share one last slot, which is cut like the others
    copies = copies.withColumn("slot", F.least(F.floor(F.col("finish") * F.lit(buckets)).cast("long"), F.lit(MOST_SLOTS * buckets + 1)))
    budget = goals.agg(F.sum("target")).first()[0] or 0.0
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    running = slots.select("slot", F.sum("slot_size").over(Window.orderBy("slot")).alias("upto"), "slot_size")
    over = running.where(F.col("upto") > F.lit(budget)).orderBy("slot").limit(1).collect()
    last = None
    if over:
        order = Window.partitionBy("slot").orderBy("finish", "q", "place", "e")
        here = copies.where(F.col("slot") == over[0]["slot"]).withColumn("sum", F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(over[0]["upto"] - over[0]["slot_size"]))
        last = here.where(F.col("sum") <= F.lit(budget)).agg(F.max(F.struct("finish", "q", "place", "e"))).first()[0]
        if last is None:  # the cut falls between two slots
            taken = lambda e: F.floor(finish(e) * F.lit(buckets)).cast("long") < F.lit(over[0]["slot"])
        else:
            at = F.struct(*[F.lit(v).alias(k) for k, v in last.asDict().items()])
            taken = lambda e: F.struct(finish(e).alias("finish"), F.col("q"), F.col("place"), F.lit(e).alias("e")) <= at
    else:
        taken = lambda e: F.lit(True)
    n = sum((F.when((F.col("target") > 0) & (F.col("size") > 0) & taken(e), 1).otherwise(0) for e in range(most)), F.lit(0))
    return placed.withColumn("copies", n.cast("int"))
