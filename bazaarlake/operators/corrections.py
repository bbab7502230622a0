"""Corrections of recognised lines: differences to what was recognised, links to dictionaries, stale sessions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correction_diff(submitted: DataFrame, original: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines whose trimmed text was changed, with what was known of the original; its text falls back to raw_text."""
    raw = F.col("o.raw_text") if "raw_text" in original.columns else F.lit(None).cast("string")
    kept = [F.col(f"o.{c}").alias(c) for c in original.columns if c not in (*keys, "text", "raw_text")]
    rows = submitted.select(*keys, F.col("text").alias("submitted")).alias("s").join(original.alias("o"), list(keys))
    first = F.coalesce(raw, F.col("o.text"))
    return rows.filter(F.trim("submitted") != F.trim(first)).select(*keys, first.alias("original_text"), "submitted", *kept)


def _consume(frame: pd.DataFrame) -> pd.DataFrame:
    """In input order, each line takes its best dictionary row that is still free."""
    used, out = set(), []
    for place, group in frame.groupby("place", sort=True):
        free = group[~group["option_id"].isin(used)]
        if len(free):
            best = free.sort_values(["exact", "size", "option_id"], ascending=[False, False, True]).iloc[0]
            used.add(best["option_id"])
            out.append((best["session"], place, best["option_id"], bool(best["exact"])))
    return pd.DataFrame(out, columns=["session", "place", "option_id", "exact"])


def link_options(detected: DataFrame, dictionary: DataFrame) -> DataFrame:
    """detected: (session, place, text); dictionary: (name, option_id). Exact name first, else the longest name contained in the text; each dictionary row once per session.

    Contained names are found by an equi-join on the text's word sequences, not by comparing every
    text with every name.
    """
    names = dictionary.select("name", "option_id", F.length("name").alias("size"), F.size(F.split("name", " ")).alias("n_words"))
    longest = names.agg(F.max("n_words").alias("most"))  # one row
    words = detected.withColumn("w", F.split("text", " ")).join(F.broadcast(longest))
    spans = F.expr("flatten(transform(sequence(1, size(w)), i -> transform(sequence(1, least(most, size(w) - i + 1)), n -> array_join(slice(w, i, n), ' '))))")
    candidates = words.select("session", "place", "text", F.explode(F.array_distinct(spans)).alias("name")).join(names, "name")
    candidates = candidates.select("session", "place", "option_id", "size", (F.col("name") == F.col("text")).alias("exact"))
    return candidates.groupBy("session").applyInPandas(_consume, "session long, place long, option_id long, exact boolean")


def resolve_option_ids(given: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """given: (id, option_id or null, name); dictionary: (name, id). An explicit id, else the name's; and the rows that have neither."""
    named = dictionary.select("name", F.col("id").alias("by_name"))
    rows = given.join(named, "name", "left").withColumn("resolved_id", F.coalesce("option_id", "by_name")).drop("by_name")
    return rows.filter("resolved_id is not null"), rows.filter("resolved_id is null")


def stale_sessions(sessions: DataFrame, corrected: DataFrame, now: Column, hours: int) -> DataFrame:
    """Sessions (session_id, last_at) older than so many hours and without corrections."""
    return sessions.filter(F.col("last_at") < now - F.make_interval(hours=F.lit(hours))).join(corrected, "session_id", "left_anti")
