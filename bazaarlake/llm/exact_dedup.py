"""Exact dedup by content sort.

The normalised bytes are sorted: sampled splitters range-partition them, Spark's external
sort places equal texts next to each other, and neighbours are compared in full. The sort key
is (first 64 bytes, 64-bit hash, text, id), so the splitters that reach the driver stay small,
and a group of copies that holds a third of all rows is split among partitions by id. A run
that ends at a partition's edge may go on in the next partition; there are at most two such
runs for each partition, and their totals (matched by SHA-256 of the normalised text) are
joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import LOWER, SLICE_BYTES, buffers, cut, small_batches

_HEAD = 64


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        data = LOWER[data]
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 8 * SLICE_BYTES, side="right")) - 1)
            at = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int32)
            text = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at), pa.py_buffer(data[offsets[lo] : offsets[hi]])])
            head = pa.array([data[offsets[i] : min(offsets[i] + _HEAD, offsets[i + 1])].tobytes() for i in range(lo, hi)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), head, text], ["id", "head", "norm"])
            lo = hi


def _neighbours(largest: bool):
    """Sorted rows -> one row each with its run's size and the id that stays; runs at the edges of the partition are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        text, digest, ids, no = None, "", [], 0

        def rows(edge: bool) -> pa.RecordBatch:
            there = [i for i in ids if i is not None]
            keep = (max if largest else min)(there) if there else None
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([digest] * n, pa.string()), pa.array([keep] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([no] * n, pa.int64()), pa.array([edge] * n, pa.bool_())],
                ["id", "sha256", "keep", "size", "part", "run", "edge"],
            )

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = value.as_py()
                if text is None or now != text:
                    if text is not None:
                        done.append(rows(edge=no == 0))
                        no += 1
                    text, digest, ids = now, hashlib.sha256(now).hexdigest(), []
                ids.append(i)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if text is not None:
            yield rows(edge=True)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Equal texts (identical after lower-casing A-Z only; null counts as empty); of each group the `keep` ("min" or "max") id stays.

    Returns one row per row of `docs`: the id, keep_id, group_size, kept, text_sha256 (of the
    normalised text in UTF-8). Defined cases: null and empty texts form one group; texts of any
    length are compared in full; rows repeated with one id count towards group_size, and all of
    them are kept if that id stays; a null id stays only in a group without other ids (keep_id
    is then null); an empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError(keep)
    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_normalise, "id long, head binary, norm binary").withColumn("hash", F.xxhash64("norm"))
    dealt = rows.repartitionByRange(n, "head", "hash", "id").sortWithinPartitions("head", "hash", "norm", "id")
    runs = dealt.select("id", "norm").mapInArrow(_neighbours(keep == "max"), "id long, sha256 string, keep long, size long, part int, run long, edge boolean")
    runs = cut(runs, "runs")
    edges = runs.filter("edge").groupBy("part", "run", "sha256").agg(F.first("keep").alias("keep"), F.first("size").alias("size"))
    best = F.max("keep") if keep == "max" else F.min("keep")
    whole = edges.groupBy("sha256").agg(best.alias("all_keep"), F.sum("size").alias("all_size"))  # two rows a partition at most
    joined = runs.join(F.broadcast(whole), "sha256", "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("keep")).otherwise(F.col("all_keep"))
    return joined.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha256").alias("text_sha256")
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
