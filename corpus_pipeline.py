"""A corpus pipeline: toxicity filter, exact dedup, near-duplicate removal, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of
`documents`; the last one adds copy_no, and returns a document as many times as the mix takes it.
Defined cases in every stage: texts may be null, empty or very long; a row with a null doc_id goes if its
text is toxic, isn't dropped by the other filters (there is no id to drop), and is never taken by the
mix; rows of one id with several texts are dropped or kept by the id together, and taken as often as
the one that the mix takes most; an empty table passes through as one; further columns are passed
on, whatever their names, but for copy_no, which the mix replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import cut, table
from bazaarlake.llm.decontaminate import decontaminate
from bazaarlake.llm.exact_dedup import exact_dedup
from bazaarlake.llm.mixing import mix_sources
from bazaarlake.llm.ngram_jaccard import ngram_jaccard_join
from bazaarlake.llm.toxicity import drop_toxic


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Only the ids to drop are moved, unless they are too many to broadcast."""
    return docs.join(cut(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays; of rows repeated with one id and text, one."""
    found = cut(exact_dedup(docs, keep="min"), "dedup")
    kept = _without(docs, found.filter("not kept and doc_id is not null"))
    again = cut(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return _without(kept, again).unionByName(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity 0.8), the document with the smallest id stays."""
    return _without(docs, ngram_jaccard_join(docs, width=5, percent=80).filter("doc_id <> component_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, with copy_no from 1."""
    taken = mix_sources(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").cast("int").alias("taken_copies"))
    joined = docs.alias("d").join(taken.alias("t"), F.col("d.doc_id") == F.col("t.taken_id"))
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c != "copy_no"]
    return joined.select(*kept, F.explode(F.sequence(F.lit(1), F.col("t.taken_copies"))).alias("copy_no"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", benchmark), ("mixing", mixing)]

#: Not expressible: the classifier's training and the rounding of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
