"""Column functions for attributes and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_int_attrs(rows: DataFrame, attrs: str, names: Sequence[str], price: str) -> DataFrame:
    """Known keys of a string map as int columns; what isn't an integer is null, and so is such a price."""
    return rows.withColumns({n: F.col(attrs)[n].try_cast("int") for n in names} | {price: F.col(price).try_cast("int")}).drop(attrs)


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>?", ""))


def validate(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """reasons: the checks that a row fails (a null result fails); rows without reasons are good."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.withColumn("reasons", F.filter(failed, lambda x: x.isNotNull()))


def roll_quality(value: Column, low: Column, high: Column, all_or_nothing: Column) -> Column:
    """Null without a range; max at its top; else by the place in the range: high from 0.8, mid from 0.3, low. all_or_nothing: max or other."""
    place = (value - low) / (high - low)
    graded = F.when(place >= 0.8, "high").when(place >= 0.3, "mid").otherwise("low")
    return F.when(value.isNull() | low.isNull() | high.isNull() | (low == high), F.lit(None)).when(value == high, "max").when(all_or_nothing, "other").otherwise(graded)


def tag_tier(weight: Column) -> Column:
    """Eighteen tiers in steps of ten."""
    return F.least(F.floor(weight / 10), F.lit(17))


def option_display(rolled: Column, per_level: Column, unit: Column) -> Column:
    return F.concat(F.format_string("%.2f", F.round(per_level * rolled, 2)), unit)


def normalize_numbers(text: Column) -> Column:
    """Digit runs (with decimals) and a standalone n become N."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\d+(?:\.\d+)?", "N"), r"(?U)\bn\b", "N")


def numbers(text: Column) -> Column:
    """All numbers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1)


def inject_numbers(template: Column, values: Column, keep: bool = False) -> Column:
    """Fills N placeholders from left to right; those without a value go, with the ~ of a range that they stand in, and so do blanks at the ends (keep: they stay)."""
    parts, filled = F.split(template, "N"), F.size(values)
    if keep:
        return F.array_join(F.transform(parts, lambda part, i: F.concat(F.when(i == 0, "").otherwise(F.coalesce(F.get(values, i - 1), F.lit("N"))), part)), "")

    def piece(part: Column, i: Column) -> Column:
        open_after, open_before = (i >= filled) & (i < F.size(parts) - 1), i > filled
        part = F.when(open_after, F.regexp_replace(part, r"\s*~\s*$", "")).otherwise(part)
        part = F.when(open_before, F.regexp_replace(part, r"^\s*~\s*", "")).otherwise(part)
        return F.concat(F.when(i == 0, "").otherwise(F.coalesce(F.get(values, i - 1), F.lit(""))), part)

    return F.trim(F.array_join(F.transform(parts, piece), ""))


#: Structural bullets, and what recognition makes of them: hyphen, comma, full stop, middle dot, the corner letter and L. Fixed values.
BULLETS = ("-", ",", ".", "·", "ㄴ", "L")


def bullet(text: Column, bullets: Sequence[str] = BULLETS) -> Column:
    """The bullet at the start, with the blanks behind it; empty without one."""
    return F.when(F.substring(text, 1, 1).isin(*bullets), F.regexp_extract(text, r"^.\s*", 0)).otherwise("")


def strip_prefix(text: Column, bullets: Sequence[str] = BULLETS) -> Column:
    """Drops one bullet at the start, and blanks around it."""
    bare = F.ltrim(text)
    return F.when(F.substring(bare, 1, 1).isin(*bullets), F.ltrim(F.substring(bare, F.lit(2), F.length(bare)))).otherwise(text)


#: Letters of Hangul syllables, in the order of the code points: initial, middle and (first: none) final ones. Fixed values.
_INITIAL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_MIDDLE = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_FINAL = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def jamo(text: Column) -> Column:
    """Hangul syllables as their letters; other characters stay."""
    letter = lambda all_letters, place: F.substring(F.lit(all_letters), (place + 1).cast("int"), F.lit(1))

    def letters(c: Column) -> Column:
        at = F.ascii(c) - 0xAC00
        final = at % 28
        whole = F.concat(letter(_INITIAL, F.floor(at / 588)), letter(_MIDDLE, F.floor(at % 588 / 28)), F.when(final > 0, letter(_FINAL, final - 1)).otherwise(""))
        return F.when((at >= 0) & (at < 11172), whole).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), letters), "")


def effect_number(text: Column) -> tuple[Column, Column]:
    """'name NUMBER[%] rest' -> name, number; nulls where there is none. The number is the first that stands after a blank."""
    bare = F.trim(text)
    at = F.regexp_instr(bare, F.lit(r"\s\d"))
    value = F.get(numbers(F.substring(bare, at, F.length(bare))), F.lit(0)).cast("double")
    return F.when(at > 1, F.rtrim(F.substring(bare, F.lit(1), at - 1))), F.when(at > 1, value)


def range_suffix(text: Column) -> Column:
    """First number or 'a ~ b' range -> struct(option_name, suffix, ranged, min, max)."""
    pattern = r"^(.*?)(\d+(?:\.\d+)?)(?:\s*~\s*(\d+(?:\.\d+)?))?(.*)$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    low, high = part(2).cast("double"), part(3).cast("double")
    return F.struct(F.trim(F.coalesce(part(1), F.when(low.isNull(), text))).alias("option_name"), F.trim(part(4)).alias("suffix"), high.isNotNull().alias("ranged"), low.alias("min"), F.coalesce(high, low).alias("max"))


def json_fields(column: str, paths: dict[str, str]) -> list[Column]:
    """{name: type} of the keys of a JSON text; what doesn't fit is null."""
    return [F.try_variant_get(F.try_parse_json(column), f"$.{name}", kind).alias(name) for name, kind in paths.items()]


#: Words of the lines: level, rank, and the two enchant slots. Fixed values.
_LEVEL, _RANK, _SLOTS = "레벨", "(랭크", ("접두", "접미")


def name_and_levels(text: Column) -> Column:
    """struct(name, level, most) of a text that ends with two numbers, apart from brackets, blanks and the word for level; all null for others."""
    body = F.rtrim(F.regexp_replace(F.rtrim(text, F.lit(" )")), _LEVEL + "$", ""), F.lit(" )"))
    two = F.split(F.regexp_extract(body, r"\d+[^0-9]+\d+$", 0), "[^0-9]+")
    name = F.trim(F.regexp_replace(body, r"\d+[^0-9]+\d+$", ""), F.lit(" -("))
    found = (F.size(two) == 2) & (name != "")
    return F.struct(F.when(found, name).alias("name"), F.when(found, two[0].cast("int")).alias("level"), F.when(found, F.get(two, F.lit(1)).cast("int")).alias("most"))


def enchant_header(text: Column) -> Column:
    """struct(slot, name, rank) of '[slot] name (랭크 rank)', the brackets of the slot being optional; all null for others."""
    first = F.split_part(text, F.lit(" "), F.lit(1))
    slot = F.trim(first, F.lit("[]"))
    rest = F.substring(text, F.length(first) + 1, F.length(text))
    name, behind = F.trim(F.split_part(rest, F.lit(_RANK), F.lit(1))), F.split_part(rest, F.lit(_RANK), F.lit(2))
    rank = F.trim(F.split_part(behind, F.lit(")"), F.lit(1)))
    found = slot.isin(*_SLOTS) & (name != "") & behind.contains(")") & rank.rlike("^[0-9A-F]+$")
    return F.struct(F.when(found, slot).alias("slot"), F.when(found, name).alias("name"), F.when(found, rank).alias("rank"))
