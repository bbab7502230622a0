"""Evaluation of recognised text and preparation of training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.similarity import sequence_ratio
from bazaarlake.operators.ingest import number_rows


def compare_lines(lines: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines (keys, section, text, confidence, corrected, skipped) with truth (keys, gt) at the same position, both there and not skipped: exact and similarity."""
    rows = lines.filter("not skipped").join(truth, list(keys))
    return rows.withColumns({"exact": F.col("text") == F.col("gt"), "similarity": sequence_ratio(F.col("text"), F.col("gt"))})


def _summary() -> list[Column]:
    return [F.count("*").alias("compared"), F.count(F.when(F.col("exact"), 1)).alias("exact"), F.mean("similarity").alias("accuracy"), F.mean("confidence").alias("confidence"), F.count(F.when(F.col("corrected"), 1)).alias("corrected")]


def accuracy_by_file(compared: DataFrame, file: str) -> DataFrame:
    return compared.groupBy(file).agg(*_summary())


def accuracy_total(by_file: DataFrame) -> DataFrame:
    """Over all files: the accuracy is weighted by the lines compared."""
    return by_file.agg(F.sum("compared").alias("compared"), F.sum("exact").alias("exact"), (F.sum(F.col("accuracy") * F.col("compared")) / F.sum("compared")).alias("accuracy"))


def accuracy_by_section(compared: DataFrame, section: str = "section") -> DataFrame:
    return compared.groupBy(F.coalesce(section, F.lit("(unknown)")).alias(section)).agg(*_summary()).orderBy(F.desc("compared"), section)


def model_gate(compared: DataFrame, model: str, current: str, candidate: str) -> DataFrame:
    """One row: exact lines and accuracy of both models, the differences, and whether the candidate is at least as good in both."""
    side = lambda name, column: F.max(F.when(F.col(model) == name, F.col(column)))
    each = compared.groupBy(model).agg(F.count(F.when(F.col("exact"), 1)).alias("exact"), F.mean("similarity").alias("accuracy"))
    one = each.agg(*[side(m, c).alias(f"{c}_{n}") for n, m in (("current", current), ("candidate", candidate)) for c in ("exact", "accuracy")])
    more = F.col("exact_candidate") - F.col("exact_current"), F.col("accuracy_candidate") - F.col("accuracy_current")
    return one.withColumns({"exact_gain": more[0], "accuracy_gain": more[1], "passes": (more[0] >= 0) & (more[1] >= 0)})


def label_distribution(labels: DataFrame, label: str) -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)


def characters(text: Column) -> Column:
    """Distinct characters of a text, sorted."""
    return F.array_sort(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""))


def charset(texts: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct characters of many columns, sorted, in one string. Each text is reduced to its own characters before anything is shuffled."""
    each = F.array_distinct(F.flatten(F.array(*[characters(F.coalesce(F.col(c), F.lit(""))) for c in columns])))
    rows = texts.select(*by, F.explode(each).alias("c")).distinct()
    return rows.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set("c")), "").alias("charset"))


def charset_mismatch(rows: DataFrame, charsets: DataFrame, model: str, union: Sequence[str] = ()) -> DataFrame:
    """rows (model, text) with the characters outside of the model's charset (model, charset), sorted, null if none; a space is always allowed. Models in `union` may use all charsets."""
    both = charsets.select("charset").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("charset", ""))))), "").alias("all_chars"))
    known = rows.join(F.broadcast(charsets), model, "left").join(F.broadcast(both))  # one row per model, and one row
    allowed = F.when(F.col(model).isin(*union), F.col("all_chars")).otherwise(F.coalesce("charset", F.lit(""))) if union else F.coalesce("charset", F.lit(""))
    odd = F.array_except(characters(F.col("text")), F.split(F.concat(allowed, F.lit(" ")), ""))
    return known.withColumn("odd", F.nullif(F.array_join(odd, ""), F.lit(""))).drop("charset", "all_chars")


# --- training sets ----------------------------------------------------------------------


def select_corrections(corrections: DataFrame, readers: Sequence[str], allowed: str, files: DataFrame) -> DataFrame:
    """corrections (id, state, reader, text, file) with reason: null if the row can be trained on; else state, reader, charset or file. files: (file)."""
    there = files.select("file").distinct().withColumn("there", F.lit(True))
    odd = F.size(F.array_except(characters(F.col("text")), F.array(*[F.lit(c) for c in sorted({*allowed, " "})]))) > 0
    reason = F.when(F.col("state") != "approved", "state").when(~F.col("reader").isin(*readers), "reader").when(odd, "charset").when(F.col("there").isNull(), "file")
    return corrections.join(there, "file", "left").withColumn("reason", reason).drop("there")


def oversample(rows: DataFrame, order: str, base: int, times: int = 3) -> DataFrame:
    """Each row `times` times, numbered on from the size of the base set."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    key = F.concat(F.lpad(F.col(order).cast("string"), 12, "0"), F.lit("."), F.lpad(F.col("copy").cast("string"), 4, "0"))
    return number_rows(copies.withColumn("_k", key), "_k", base + 1).drop("_k")


def manifest(base: DataFrame, more: DataFrame) -> DataFrame:
    """Lines 'path<tab>label' of both sets (path, label), by path; write.text makes the file."""
    return base.select("path", "label").unionByName(more.select("path", "label")).orderBy("path").select(F.concat_ws("\t", "path", "label").alias("value"))


def label_mix(templates: DataFrame, dictionary: DataFrame, boosts: DataFrame, seed: int = 1) -> DataFrame:
    """Distinct labels of both (label), with extra copies by boosts (label, copies), in a seeded shuffle."""
    labels = templates.select("label").unionByName(dictionary.select("label")).distinct()
    rows = labels.join(boosts, "label", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(0)).cast("int"))))
    return rows.select("label", "copy").withColumn("place", F.xxhash64("label", "copy", F.lit(seed))).orderBy("place")


def weighted_entries(entries: DataFrame, weights: DataFrame, seed: int = 1) -> DataFrame:
    """entries (file, entry) repeated by their file's weight (file, weight); each N becomes a number from 1 to 99, seeded by entry and copy."""
    rows = entries.join(weights, "file").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    fill = lambda p, i: F.when(i == 0, p).otherwise(F.concat((F.pmod(F.xxhash64("entry", "copy", i, F.lit(seed)), F.lit(99)) + 1).cast("string"), p))
    return rows.select("file", "entry", "copy", F.array_join(F.transform(F.split("entry", "N"), fill), "").alias("text"))


def number_variants(texts: DataFrame, copies: int, spread: int = 5, seed: int = 1) -> DataFrame:
    """texts (id, text) with numbers drawn from an interval around the original ones; 'a~b' ranges stay ordered. variant counts from 1."""
    rows = texts.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    found = F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)
    drawn = F.transform(found, lambda n, i: F.greatest(F.lit(0), n.cast("long") + F.pmod(F.xxhash64("id", "variant", i, F.lit(seed)), F.lit(2 * spread + 1)) - spread))
    rows = rows.withColumn("drawn", drawn).withColumn("rests", F.split("text", r"\d+"))
    tied = F.transform("drawn", lambda n, i: F.when((i > 0) & F.trim(F.get("rests", i)).isin("~"), F.greatest(n, F.get("drawn", i - 1))).otherwise(n))
    rows = rows.withColumn("drawn", tied)
    pieces = F.transform("rests", lambda p, i: F.concat(p, F.coalesce(F.get("drawn", i).cast("string"), F.lit(""))))
    return rows.select("id", "variant", F.array_join(pieces, "").alias("text"))
