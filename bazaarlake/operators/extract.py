"""Structured extraction from recognised lines: one pass of column expressions over the whole line table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.functions.similarity import indel_ratio, ratio
from bazaarlake.functions.text import enchant_header, name_and_levels
from bazaarlake.operators.fuzzy import best_match

#: Words of the lines: colour part, grade, level and step. Fixed values.
_PART, _GRADE, _LEVEL, _STEP = "파트", "등급", "레벨", "단계"

def _part(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _island(by: str, order: str, starts: Column) -> Column:
    return F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def reforges(lines: DataFrame, by: str, order: str) -> DataFrame:
    """lines (by, order, text, is_sub). 'name (level/max 레벨)' -> name, level, max_level (null without a level); the text of the last sub-bullet below is its effect."""
    rows = lines.withColumn("no", _island(by, order, ~F.col("is_sub"))).filter("no > 0").withColumn("level", name_and_levels(F.col("text")))
    plain = F.trim(F.regexp_replace("text", r"^[-ㄴ\s]+", ""))
    main = lambda c: F.max(F.when(~F.col("is_sub"), c))
    return rows.groupBy(by, "no").agg(
        main(F.coalesce("level.name", plain)).alias("name"), main(F.col("level.level")).alias("level"), main(F.col("level.most")).alias("max_level"), F.max_by(F.when(F.col("is_sub"), plain), F.when(F.col("is_sub"), F.col(order))).alias("effect")
    )


def enchant_slots(lines: DataFrame, by: str, order: str) -> DataFrame:
    """Headers '[slot] name (랭크 rank)' start a slot; the lines below are its effects."""
    head = enchant_header(F.col("text"))
    rows = lines.withColumn("head", head).withColumn("slot_no", _island(by, order, F.col("head.slot").isNotNull())).filter("slot_no > 0")
    of_header = lambda name: F.max(F.col(f"head.{name}")).alias(name)
    below = F.sort_array(F.collect_list(F.when(F.col("head.slot").isNull(), F.struct(order, "text"))))
    return rows.groupBy(by, "slot_no").agg(of_header("slot"), of_header("name"), of_header("rank"), below["text"].alias("effects"))


def color_part(text: Column) -> Column:
    """'파트 X R:n G:n B:n', X from A to F, blanks in place of a colon being allowed -> struct(part, r, g, b); a missing channel is null, and a text without part has none."""
    channel = lambda c: _part(text, rf"{c}[\s:]+(\d+)", 1).cast("int")
    part = _part(text, rf"{_PART}\s*([A-F])", 1)
    return F.when(part.isNotNull(), F.struct(part.alias("part"), channel("R").alias("r"), channel("G").alias("g"), channel("B").alias("b")))


def erg(lines: DataFrame, by: str, order: str) -> DataFrame:
    """Of each session's first line with '등급 X (n/m 레벨)' (round, square or no brackets): grade, level, max_level; either number out of 1 to 50 is null."""
    found = F.regexp_extract("text", rf"{_GRADE}\s+[SAB][\s(\[]*\d\d?\s*/\s*\d\d?\s*{_LEVEL}", 0)
    two = F.transform(F.regexp_extract_all(found, F.lit(r"\d+"), 0), lambda x: F.when(x.cast("int").between(1, 50), x.cast("int")))
    values = F.struct(F.regexp_extract(found, "[SAB]", 0).alias("grade"), F.get(two, F.lit(0)).alias("level"), F.get(two, F.lit(1)).alias("max_level"))
    return lines.filter(found != "").groupBy(by).agg(F.min_by(values, order).alias("e")).select(by, "e.*")


def special_upgrade(text: Column, label: str, cutoff: float = 60) -> Column:
    """struct(type, level): R or S and a number in front of the word for step (brackets being optional), if what stands before resembles the label; a level out of 1 to 8 is null."""
    found = F.regexp_extract(text, rf"[RS][\s(\[]*\d+\s*{_STEP}", 0)
    before = F.trim(F.substring(text, F.lit(1), F.instr(text, found) - 1))
    near = (found != "") & (indel_ratio(F.when(found != "", before).otherwise(""), F.lit(label)) >= cutoff)
    level = F.regexp_extract(found, r"\d+", 0).try_cast("int")
    return F.struct(F.when(near, F.substring(found, 1, 1)).alias("type"), F.when(near & level.between(1, 8), level).alias("level"))


def set_effects(lines: DataFrame, names: DataFrame, cutoff: float = 90) -> DataFrame:
    """'name +n' with a name that matches the dictionary (name) -> set_name, level."""
    pattern = r"^(.*?)\s*\+\s*(\d+)\s*$"
    rows = lines.withColumn("label", _part(F.col("text"), pattern, 1)).withColumn("level", _part(F.col("text"), pattern, 2).cast("int")).filter("level is not null")
    best = best_match(rows, names.select(F.col("name").alias("set_name")), "label", "set_name", cutoff)
    return rows.join(best, "label").drop("label", "score")


def _values(rest: Column, kind: str) -> list[Column]:
    """The number of an attribute. range: behind the first ~ or / between two numbers; fraction: behind such a /; percent: in front of a percent sign; sum: both
    sides of a plus, in two columns, or one number; first: the first number. Null where the form isn't met."""
    number = lambda pattern: F.regexp_extract(rest, pattern, 1).try_cast("double")
    first = number(r"(\d+(?:\.\d+)?)")
    if kind == "sum":
        return [F.coalesce(number(r"(\d+)\s*\+\s*\d+"), first), number(r"\d+\s*\+\s*(\d+)")]
    return [{"range": number(r"\d\s*[/~]\s*(\d+)"), "fraction": number(r"\d\s*/\s*(\d+)"), "percent": number(r"(\d+(?:\.\d+)?)\s*%")}.get(kind, first)]


def _nearest(labels: dict[str, str], cutoff: float):
    """(head, end) -> the label that most resembles the head's beginning of its length (the first of equal ones), null below the cutoff; only labels that end before `end` count. A batch's different heads are compared once."""

    def best(head: str | None, end: int | None) -> str | None:
        scores = [ratio(head[: len(name)], name) if head is not None and end > len(name) else 0.0 for name in labels]
        top = max(scores)
        return list(labels)[scores.index(top)] if top >= cutoff else None

    def run(head: pd.Series, end: pd.Series) -> pd.Series:
        known: dict[tuple, str | None] = {}
        out = []
        for pair in zip(head, end, strict=True):
            if pair not in known:
                known[pair] = best(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="object")

    # so that the filter on the label stays behind it: in front, it would call the function once more for each line
    return F.pandas_udf(run, "string").asNondeterministic()


def item_attributes(lines: DataFrame, by: str, labels: dict[str, str], cutoff: float = 70) -> DataFrame:
    """lines (by, text): a label (from a short fixed list, each with a kind of value) that resembles the text's beginning of its length, something being behind it; one column per label, and additional_<label> for the right side of a sum."""
    longest = max(map(len, labels))
    # what is behind the last character that is no blank doesn't matter, nor where that is beyond the longest label
    end = F.coalesce(F.least(F.length(F.rtrim("text")), F.lit(longest + 1)), F.lit(0))
    scored = lines.withColumn("label", _nearest(labels, cutoff)(F.substring("text", 1, longest), end)).filter("label is not null")
    # a line has one label, so one value: each kind's patterns stand once in the plan
    rest, kinds = F.substring("text", F.length("label") + 1, F.length("text")), {}
    for name, kind in labels.items():
        kinds.setdefault(kind, []).append(name)
    of_kind = lambda i: F.coalesce(*[F.when(F.col("label").isin(names), _values(rest, kind)[i]) for kind, names in kinds.items() if i == 0 or kind == "sum"])
    valued = scored.select(by, "label", of_kind(0).alias("value"), *([of_kind(1).alias("more")] if "sum" in kinds else []))
    columns = []
    for name, kind in labels.items():
        columns.append(F.max(F.when(F.col("label") == name, F.col("value"))).alias(name))
        if kind == "sum":
            columns.append(F.max(F.when(F.col("label") == name, F.col("more"))).alias(f"additional_{name}"))
    return valued.groupBy(by).agg(*columns)
