"""Restructuring of line tables: grouping, merging and labelling of a session's lines with windows.

All functions work over every session at once; `by` names the columns of a session (or section) and
`order` the position inside it. Windows are partitioned by session.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.sources.scratch import scratch_table, stored


def _before(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _same(by: Sequence[str]) -> Column:
    """The condition that the columns equal those named _by_<column>, nulls taken as values."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])


def line_index(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    return lines.withColumn("line_index", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def group_by_y(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts (x, y, width, height, text) of one y form a line, from left to right; its box goes from the first part to the right edge of the last."""
    ordered = F.sort_array(F.collect_list(F.struct("x", "width", "height", "text")))
    rows = parts.groupBy(*by, "y").agg(ordered.alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    return rows.select(*by, "y", first["x"].alias("x"), (last["x"] + last["width"] - first["x"]).alias("width"), first["height"].alias("height"), F.array_join("p.text", " ").alias("text"))


def merge_bounds(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Box of a group: x, y and height of its first line, width to the right edge of its last."""
    rows = lines.groupBy(*by).agg(*[F.min_by(c, order).alias(c) for c in ("x", "y", "height")], F.max_by(F.col("x") + F.col("width"), order).alias("right"))
    return rows.select(*by, "x", "y", "height", (F.col("right") - F.col("x")).alias("width"))


def with_gap_threshold(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """gap: space between a line and the one above; threshold: max(2 m, m + 4) where m is the upper median of the gaps."""
    gap = F.col("y") - F.lag(F.col("y") + F.col("height")).over(Window.partitionBy(*by).orderBy(order))
    rows = lines.withColumn("gap", gap)
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC)").cast(rows.schema["gap"].dataType)  # a session's gaps are counted once, not on each of its lines
    m = rows.groupBy(*by).agg(middle.alias("_m")).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.greatest(2 * F.col("_m"), F.col("_m") + 4).alias("threshold"))
    return rows.join(m, _same(by), "left").select(*rows.columns, "threshold")


def distance_groups(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """group_no: a new group starts where the gap reaches the threshold."""
    rows = with_gap_threshold(lines, by, order)
    return rows.withColumn("group_no", F.sum(F.when(F.col("gap") >= F.col("threshold"), 1).otherwise(0)).over(_before(by, order))).drop("gap", "threshold")


def gap_outlier(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Last position whose gap reaches the threshold; null without one."""
    return with_gap_threshold(lines, by, order).groupBy(*by).agg(F.max(F.when(F.col("gap") >= F.col("threshold"), F.col(order))).alias("outlier"))


def trim_tail(lines: DataFrame, by: Sequence[str], order: str, is_header: Column) -> DataFrame:
    """Drops the lines from the outlier on, which is looked for only behind the last header."""
    last = F.max(F.when(is_header, F.col(order))).over(Window.partitionBy(*by))
    rows = lines.withColumn("last_header", F.coalesce(last, F.lit(-1)))
    cut = gap_outlier(rows.filter(F.col(order) > F.col("last_header")), by, order)
    return rows.join(cut, list(by), "left").filter(F.col("outlier").isNull() | (F.col(order) < F.col("outlier"))).drop("outlier", "last_header")


def merge_continuations(lines: DataFrame, by: Sequence[str], order: str, kind: str = "kind") -> DataFrame:
    """Plain lines join the bullet line before them. Headers reset that; grey and sub-bullet lines neither merge, anchor nor reset; a line without a bullet before it stays."""
    header = F.sum(F.when(F.col(kind) == "header", 1).otherwise(0)).over(_before(by, order))
    rows = lines.withColumn("island", header)
    anchor = F.last(F.when(F.col(kind) == "bullet", F.col(order)), ignorenulls=True).over(_before([*by, "island"], order))
    rows = rows.withColumn("anchor", F.when(F.col(kind).isin("bullet", "plain"), F.coalesce(anchor, F.col(order))).otherwise(F.col(order)))
    merged = rows.groupBy(*by, "anchor").agg(F.min_by(kind, order).alias(kind), F.sort_array(F.collect_list(F.struct(order, "text"))).alias("t"), F.count("*").alias("n_lines"))
    return merged.select(*by, F.col("anchor").alias(order), kind, F.array_join("t.text", " ").alias("text"), "n_lines")


def merge_next_lines(lines: DataFrame, by: Sequence[str], order: str, gap: int = 1) -> DataFrame:
    """Merges lines whose gap is at most `gap`; the confidence is the running pairwise mean, as each line is merged into what is there."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.when(F.col("y") - F.lag(F.col("y") + F.col("height")).over(w) <= gap, 0).otherwise(1)
    rows = lines.withColumn("start", starts).withColumn("group_no", F.sum("start").over(_before(by, order)))
    rows = rows.groupBy(*by, "group_no").agg(F.sort_array(F.collect_list(F.struct(order, "text", "confidence"))).alias("t"))
    mean = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.col("t")[0]["confidence"].cast("double"), lambda a, x: (a + x["confidence"]) / 2)
    return rows.select(*by, "group_no", F.array_join("t.text", " ").alias("text"), mean.alias("confidence"))


def slot_groups(lines: DataFrame, by: Sequence[str], order: str, is_header: Column) -> DataFrame:
    """slot: headers counted from 1; the lines behind a header are its effects; lines before any header go."""
    slot = F.sum(F.when(is_header, 1).otherwise(0)).over(_before(by, order))
    return lines.withColumn("slot", slot).filter("slot > 0")


def effects_per_header(lines: DataFrame, by: Sequence[str], order: str, kind: str = "kind") -> DataFrame:
    """Lines of each slot that are neither headers nor grey nor merged into another."""
    slots = slot_groups(merge_continuations(lines, by, order, kind), by, order, F.col(kind) == "header")
    return slots.groupBy(*by, "slot").agg(F.count(F.when(~F.col(kind).isin("header", "grey"), 1)).alias("n_effects"))


def slot_labels(lines: DataFrame, by: Sequence[str], order: str, kind: str = "kind") -> DataFrame:
    """Labels of the headers: two are prefix and suffix; a single one is suffix if a grey line stands above it, else prefix; of other numbers, null."""
    whole = Window.partitionBy(*by)
    rows = lines.withColumn("n", F.count(F.when(F.col(kind) == "header", 1)).over(whole)).withColumn("grey_above", F.max(F.when(F.col(kind) == "grey", 1).otherwise(0)).over(_before(by, order)))
    rows = rows.filter(F.col(kind) == "header").withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    label = F.when(F.col("n") == 2, F.when(F.col("no") == 1, "prefix").otherwise("suffix")).when(F.col("n") == 1, F.when(F.col("grey_above") == 1, "suffix").otherwise("prefix"))
    return rows.select(*by, order, label.alias("label"))


def pick_confident(readings: DataFrame, by: Sequence[str], reader: str = "reader") -> DataFrame:
    """The most confident reading of each position; ties go to the first reader."""
    return readings.groupBy(*by).agg(F.min_by(F.struct("text", "confidence", reader), F.struct((-F.col("confidence")).alias("c"), reader)).alias("x")).select(*by, "x.*")


def majority_reader(readings: DataFrame, session: str, by: Sequence[str], reader: str = "reader") -> DataFrame:
    """The reader that wins the most positions of a session; ties go to the first."""
    wins = pick_confident(readings, [session, *by], reader).groupBy(session, reader).count()
    return wins.groupBy(session).agg(F.min_by(reader, F.struct((-F.col("count")).alias("n"), reader)).alias(reader))


def merge_sections(lines: DataFrame, session: str, section: str, segment: str, order: str) -> DataFrame:
    """Segments of one section of a session follow each other in one numbering."""
    w = Window.partitionBy(session, section).orderBy(segment, order)
    return lines.withColumn("line_index", F.row_number().over(w) - 1)


def promote_header(lines: DataFrame, by: Sequence[str], order: str, is_header: Column) -> DataFrame:
    """The first header's text becomes a column; header lines leave the list."""
    first = lines.filter(is_header).groupBy(*by).agg(F.min_by("text", order).alias("header_text"))
    return lines.filter(~is_header).join(first, list(by), "left")


def abbreviated(lines: DataFrame, by: Sequence[str], is_grade_line: Column) -> DataFrame:
    """Sessions whose grade section has at most one line that is no header."""
    return lines.groupBy(*by).agg((F.count(F.when(is_grade_line, 1)) <= 1).alias("abbreviated"))


def gap_clusters(values: DataFrame, by: Sequence[str], value: str, gap: float) -> DataFrame:
    """cluster: values in order, a new one where the step is larger than `gap`; nulls come first and are in cluster 0.

    A group may hold any share of the rows: its distinct values are range-partitioned and sorted, each partition
    counts its own steps, and one row per partition and group carries the last value and the count over its edge.
    """
    spark = values.sparkSession
    places = values.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(value).alias("_v")).distinct()
    keys = [f"_by_{c}" for c in by]
    dealt = places.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_v").withColumn("_part", F.spark_partition_id())
    path = scratch_table(spark, "places")
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path)
    w = Window.partitionBy("_part", *keys).orderBy("_v")
    step = F.when(F.col("_v") - F.lag("_v").over(w) > gap, 1).otherwise(0)
    steps = kept.withColumn("_step", step).withColumn("_own", F.sum("_step").over(w))
    edges = steps.groupBy("_part", *keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_step").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_part")
    edge = F.when(F.col("_low") - F.lag("_high").over(over) > gap, 1).otherwise(0)
    edges = edges.withColumn("_edge", edge).withColumn("_before", F.sum("_edge").over(over) + F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carried = edges.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_e{c}") for c in keys], "_before")
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{c}")) for c in keys], F.col("_part") == F.col("_p"))
    numbered = steps.join(carried, here).select(*keys, "_v", (F.col("_own") + F.col("_before")).alias("cluster"))
    return values.join(numbered, _same(by) & F.col(value).eqNullSafe(F.col("_v"))).select(*values.columns, "cluster")


def medians(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median): the exact median of each group's values, nulls apart; a group without any has none.

    A group may hold any share of the rows: its distinct values, with their counts, are range-partitioned and sorted, each partition sums up
    its own counts, and one row per partition and group carries the sum over its edge, so a value knows its ranks.
    """
    spark, keys = rows.sparkSession, [f"_by_{c}" for c in by]
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    dealt = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_v").withColumn("_part", F.spark_partition_id())
    kept = stored(dealt, "ranks")
    upto = kept.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_part", *keys).orderBy("_v")))
    edges, over = kept.groupBy("_part", *keys).agg(F.sum("_c").alias("_n")), Window.partitionBy(*keys)
    edges = edges.withColumn("_before", F.sum("_n").over(over.orderBy("_part")) - F.col("_n")).withColumn("_n", F.sum("_n").over(over))
    carried = edges.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_e{k}") for k in keys], "_before", "_n")
    here = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in keys], F.col("_part") == F.col("_p"))
    last = F.col("_upto") + F.col("_before")  # ranks from 1 to n: this value has those from last - _c + 1 to last
    at = lambda rank: F.max(F.when(rank.between(last - F.col("_c") + 1, last), F.col("_v").cast("double")))
    found = upto.join(carried, here).groupBy(*keys).agg(at(F.expr("(_n + 1) div 2")).alias("_a"), at(F.expr("_n div 2 + 1")).alias("_b"))
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def cluster_stats(clustered: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """size, mean, median, std, low, high and share (of the group) of each cluster."""
    clustered = stored(clustered, "clustered")
    rows = clustered.groupBy(*by, "cluster").agg(F.count("*").alias("size"), F.mean(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    keys = [*by, "cluster"]
    middle = medians(clustered, keys, value).select(*[F.col(c).alias(f"_m_{c}") for c in keys], "median")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in keys])
    rows = rows.join(middle, same, "left").drop(*[f"_m_{c}" for c in keys])
    return rows.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy(*by)))


def extremes(clustered: DataFrame, by: Sequence[str], value: str, key: str, n: int = 10) -> DataFrame:
    """First n rows (by key) at the least and at the greatest value of each cluster."""
    ends = clustered.groupBy(*by, "cluster").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    rows = clustered.join(ends, [*by, "cluster"]).withColumn("end", F.when(F.col(value) == F.col("low"), "low").when(F.col(value) == F.col("high"), "high")).filter("end is not null")
    w = Window.partitionBy(*by, "cluster", "end").orderBy(key)
    return rows.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= n).drop("low", "high")
