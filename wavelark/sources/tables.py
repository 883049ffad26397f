"""Text tables: comma or tab separated with # comments, segments, reports and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("comment", "#").option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Annotation tables (tab separated): selection, begin_s, end_s, low_hz, high_hz, type."""
    raw = read_table(spark, path, "\t")
    return raw.select(F.col("Selection").cast("int").alias("selection"), F.col("`Begin Time (s)`").cast("double").alias("begin_s"), F.col("`End Time (s)`").cast("double").alias("end_s"), F.col("`Low Freq (Hz)`").cast("double").alias("low_hz"), F.col("`High Freq (Hz)`").cast("double").alias("high_hz"), F.col("Type").alias("type"))


def write_table(df: DataFrame, path: str, order_by: list[str] | None = None, sep: str = ",") -> None:
    """One header a file; an order is global over the files."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_commented(df: DataFrame, path: str, comments: list[str], order_by: list[str]) -> None:
    """A small report as one CSV file: comment lines, a header, rows in order. For tables of a row a codebook size or a step."""
    spark = df.sparkSession
    rows = df.orderBy(*order_by).collect()
    lines = [*(f"# {c}" for c in comments), ",".join(df.columns), *(",".join("" if v is None else str(v) for v in r) for r in rows)]
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray("\n".join(lines).encode() + b"\n"))
    out.close()


def write_features(df: DataFrame, path: str) -> None:
    """Parquet by split and class, the canonical storage."""
    parts = [c for c in ("split", "class_name") if c in df.columns]
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)
