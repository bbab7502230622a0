"""Exports as files: ordered parts that Spark's committer publishes together, and reading them back in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ordered(rows: DataFrame, path: str, order: Sequence[str | Column], kind: str = "json", parts: int | None = None) -> None:
    """Range-partitioned and sorted by `order`, so that the part files, in order of their names, hold the rows in order. kind: json (nulls are written) or text (one string column)."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite")
    if kind == "text":
        writer.text(path)
    else:
        writer.option("ignoreNullFields", "false").json(path)


def read_ordered(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of an export with `file` and `at` (place within a file that is read in one piece); text lines without a schema."""
    reader = spark.read.option("wholetext", "false")
    rows = reader.text(path) if schema is None else spark.read.schema(schema).json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
