"""Classifier evaluation on rows of (actual, predicted, rank, ranked)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(cases: DataFrame, classes: list[str]) -> DataFrame:
    """A row per tested class: a count for each class predicted, tests, and errors (predictions into other tested classes)."""
    tested = {r[0] for r in cases.select("actual").distinct().collect()}  # class names
    table = cases.groupBy("actual").pivot("predicted", classes).count().fillna(0)
    off = sum((F.when(F.col("actual") != c, F.col(f"`{c}`")).otherwise(0) for c in classes if c in tested), F.lit(0))
    return table.select("actual", *[F.col(f"`{c}`").cast("long").alias(c) for c in classes], sum((F.col(f"`{c}`") for c in classes), F.lit(0)).cast("long").alias("tests"), off.cast("long").alias("errors"))


def candidate_order(cases: DataFrame, n_models: int) -> DataFrame:
    """How often the right model ranked first, second, ..., for each class and (class TOTAL) over all."""
    out = cases.rollup("actual").agg(F.grouping("actual").alias("_g"), F.count("*").alias("tests"), *[F.count_if(F.col("rank") == k).alias(f"r{k}") for k in range(1, n_models + 1)])
    return out.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("actual")).alias("class_name"), "tests", *[f"r{k}" for k in range(1, n_models + 1)])


def accuracy_by_class(cases: DataFrame) -> DataFrame:
    per = cases.groupBy("actual").agg(F.count("*").alias("tests"), F.count_if("correct").alias("hits"))
    return per.select(F.col("actual").alias("class_name"), "tests", "hits", (100.0 * F.col("hits") / F.col("tests")).alias("accuracy"))


def accuracy(cases: DataFrame) -> DataFrame:
    """One row: tests, hits, accuracy over all, avg_accuracy (the mean over classes), error_rate, and the summary as JSON."""
    both = accuracy_by_class(cases).agg(F.sum("tests").alias("tests"), F.sum("hits").alias("hits"), F.avg("accuracy").alias("avg_accuracy"))
    both = both.withColumn("accuracy", 100.0 * F.col("hits") / F.nullif(F.col("tests"), F.lit(0))).withColumn("error_rate", 100.0 - F.col("avg_accuracy"))
    text = F.format_string('{"accuracy": %.2f, "avg_accuracy": %.2f}', "accuracy", "avg_accuracy")
    return both.where("tests is not null").select("tests", "hits", "accuracy", "avg_accuracy", "error_rate", text.alias("json"))


def ranked_misses(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Misclassified cases, with the candidates down to the right one."""
    return cases.where(~F.col("correct")).select(*keys, "actual", "rank", F.slice("ranked", F.lit(1), F.col("rank")).alias("candidates"))


def case_table(cases: DataFrame, key: str, n_models: int) -> DataFrame:
    """seq_filename, seq_class_name, correct (* or !), rank, r1 .. rK."""
    return cases.select(F.col(key).cast("string").alias("seq_filename"), F.col("actual").alias("seq_class_name"), F.when(F.col("correct"), "*").otherwise("!").alias("correct"), "rank", *[F.get("ranked", F.lit(k)).alias(f"r{k + 1}") for k in range(n_models)])
