"""Trees as edge tables (parent, child)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.sources.scratch import scratch_table


def ancestors(edges: DataFrame) -> DataFrame:
    """(item, ancestor): every child with itself and all nodes above it, over every path. Cycles end where nothing new is found.

    A join per level, of the pairs found last with the edges; each level is a written table, so any depth and size will do.
    """
    spark = edges.sparkSession
    up = edges.select(F.col("child").alias("ancestor"), "parent").distinct()
    schema, path = None, scratch_table(spark, "ancestors")
    new, level = edges.select(F.col("child").alias("item"), F.col("child").alias("ancestor")).filter("item is not null").distinct(), 0
    while True:
        schema = schema or new.schema
        new.write.parquet(f"{path}/level={level}")
        found = spark.read.schema(schema).parquet(path).select("item", "ancestor")
        last = spark.read.schema(schema).parquet(f"{path}/level={level}")
        if last.isEmpty():
            return found
        above = last.join(up, "ancestor").select("item", F.col("parent").alias("ancestor")).filter("ancestor is not null").distinct()
        new, level = above.join(found, ["item", "ancestor"], "left_anti"), level + 1


def node_counts(edges: DataFrame) -> DataFrame:
    """Leaves and interior nodes."""
    nodes = edges.select(F.col("parent").alias("node"), F.lit(1).alias("inside")).unionByName(edges.select(F.col("child").alias("node"), F.lit(0).alias("inside")))
    per_node = nodes.groupBy("node").agg(F.max("inside").alias("inside"))
    return per_node.agg(F.sum(1 - F.col("inside")).alias("leaves"), F.sum("inside").alias("interior"))
