"""Counts, usage and pages of logs and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders of a tag listing: column and direction. Unknown keys mean newest first.
TAG_ORDERS = {"name": ("name", True), "-name": ("name", False), "weight": ("weight", True), "-weight": ("weight", False), "usage": ("n_targets", True), "-usage": ("n_targets", False), "id": ("id", True), "-id": ("id", False)}


def option_counts(listings: DataFrame, options: DataFrame) -> DataFrame:
    """Distinct options of each listing, 0 included; counted before the join."""
    n = options.groupBy(F.col("listing_id").alias("id")).agg(F.count_distinct("id").alias("n_options"))
    return listings.join(n, "id", "left").withColumn("n_options", F.coalesce("n_options", F.lit(0)))


def usage_counts(rows: DataFrame, uses: DataFrame, key: str, name: str) -> DataFrame:
    """Rows (id) with the number of uses that point at them through `key`, 0 included."""
    n = uses.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return rows.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def ordered_tags(tags: DataFrame, order: str) -> DataFrame:
    column, up = TAG_ORDERS.get(order, ("id", False))
    return tags.orderBy(F.col(column).asc() if up else F.col(column).desc(), "id")


def action_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: a column for each table."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])
    return rows.agg(*[F.max(F.when(F.col("table") == name, F.col("n"))).alias(name) for name in tables])


def usage_quota(usage: DataFrame, class_a: Sequence[str], quota: dict[str, float]) -> DataFrame:
    """usage: (action, requests, bucket, stored). Requests of class A and of the rest, the buckets' largest storage summed, and percent of each quota."""
    requests = usage.agg(F.sum(F.when(F.col("action").isin(*class_a), F.col("requests")).otherwise(0)).alias("class_a"), F.sum(F.when(F.col("action").isin(*class_a), 0).otherwise(F.col("requests"))).alias("class_b"))
    stored = usage.groupBy("bucket").agg(F.max("stored").alias("stored")).agg(F.sum("stored").alias("stored"))
    one = requests.join(F.broadcast(stored))  # both are one row
    return one.withColumns({f"{k}_percent": F.bround(100 * F.col(k) / v, 1) for k, v in quota.items()})


def cost_by_service(costs: DataFrame) -> DataFrame:
    """costs: (service, currency, amount). Without zero costs, rounded to four digits, dearest first, with the total and the dearest service's currency."""
    rows = costs.groupBy("service", "currency").agg(F.sum("amount").alias("amount")).filter("amount <> 0").withColumn("amount", F.bround("amount", 4))
    whole = Window.partitionBy()
    top = F.max_by("currency", F.struct("amount", "service")).over(whole)
    return rows.withColumns({"total": F.bround(F.sum("amount").over(whole), 4), "top_currency": top}).orderBy(F.desc("amount"), "service")


def latest_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest run of each job (id, name); jobs without runs stay."""
    last = runs.groupBy("job").agg(F.max_by(F.struct("run_id", "started_at", "status"), F.struct("started_at", "run_id")).alias("r")).select("job", "r.*")
    return jobs.join(last, "job", "left")


def log_page(logs: DataFrame, condition: Column, limit: int, offset: int = 0) -> DataFrame:
    """A page of the log, newest first, and the number of rows that meet the condition; a page beyond the end is one row, with the number alone."""
    found = logs.filter(condition)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.desc("id")).offset(offset).limit(limit)
    return page.join(total, F.lit(True), "right").orderBy(F.desc("id"))  # the total is one row


def newest(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("id")).offset(offset).limit(max(1, min(200, limit)))
