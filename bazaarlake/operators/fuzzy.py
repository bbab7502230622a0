"""Fuzzy matching of noisy lines with dictionaries, and entity resolution by several kinds of evidence.

Distinct texts are compared once. Candidates come from an equi-join (section, slot or session) and lose those
that can't reach the cutoff before anything is scored (can_reach); no match is lost by that.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlake.functions.similarity import can_reach, indel_ratio, partial_ratio, ratios
from bazaarlake.functions.text import bullet, enchant_header, inject_numbers, jamo, name_and_levels, normalize_numbers, numbers
from bazaarlake.sources.scratch import stored

#: Cutoffs at which texts below the asked one are searched for, one after the other, and parts that the texts of one dictionary are dealt out in where all pairs count.
_LOWER, _SALTS = (60, 40), 16


def candidates(rows: DataFrame, names: DataFrame, cutoff: float, on: Sequence[str] = ()) -> DataFrame:
    """rows (on, _t) and names (on, _e, ...), distinct -> the pairs that can have an indel ratio of `cutoff` or more; none that has it is lost.

    A ratio c of texts of m and n characters needs a common subsequence of L >= c (m + n) / 200, so m - L characters go and n - L
    come: at most m - L of the text's characters are lost, and at most 2 (m - L) + n - L of its pairs of neighbours; one that stays moves by m - L
    to the left or n - L to the right at most. So it is enough to look up so many of the text's pieces, and one more, in the dictionary's
    pieces: the rarest ones (pairs of neighbours where the text has more of them than can be lost, else characters). A piece that is frequent in the
    dictionary comes last; a text meets only entries of fitting length, with the piece at a fitting place, and then the characters
    that both share are counted.
    """
    m, n = F.length("_t"), F.length("_e")
    share, least = cutoff / (200 - cutoff), lambda a, b: F.ceil(cutoff * (a + b) / 200 - 1e-9)
    shortest, longest = F.greatest(F.ceil(m * share - 1e-9), F.lit(1)), F.floor(m / share + 1e-9)
    lost = F.floor(F.greatest(*[2 * m + x - 3 * cutoff * (m + x) / 200 for x in (shortest, longest)]) + 1e-9)  # linear in x, so greatest at an end
    pieces = lambda text, size: F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.struct(F.substring(text, i, F.lit(size)).alias("piece"), i.alias("at")))
    none = F.array().cast("array<struct<piece: string, at: int>>")
    both = lambda text: F.concat(F.when(F.length(text) > 0, pieces(text, 1)).otherwise(none), F.when(F.length(text) > 1, pieces(text, 2)).otherwise(none))
    key = [*on, "piece"]
    index = names.select("*", F.explode(both(F.col("_e"))).alias("p")).select(*names.columns, F.col("p.piece").alias("piece"), F.col("p.at").alias("there"))
    often = index.groupBy(*key).agg(F.count("*").alias("often"))
    sized = rows.filter(m > 0).withColumns({"pairs": m - 1 > lost, "taken": F.when(m - 1 > lost, lost).otherwise(m - shortest) + 1})
    asked = sized.withColumn("p", F.explode(F.when(F.col("pairs"), pieces(F.col("_t"), 2)).otherwise(pieces(F.col("_t"), 1)))).select(*rows.columns, "taken", F.col("p.piece").alias("piece"), F.col("p.at").alias("at"))
    ranked = asked.join(often, key, "left").groupBy(*on, "_t").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece", "at"))).alias("ps"), F.first("taken").cast("int").alias("taken"))
    probes = ranked.withColumn("p", F.explode(F.filter(F.slice("ps", F.lit(1), F.col("taken")), lambda p: p["often"] > 0))).select(*on, "_t", "p.piece", "p.at")
    shift = F.col("there") - F.col("at")
    near = n.between(shortest, longest) & (shift <= n - least(m, n)) & (-shift <= m - least(m, n))
    met = probes.join(index, key).filter(near).select(*on, "_t", *[c for c in names.columns if c not in on]).distinct()
    return met.filter(can_reach(F.col("_t"), F.col("_e"), cutoff))


def _best(pairs: DataFrame, on: Sequence[str], entry: str, text: str, cutoff: float) -> DataFrame:
    """The best of the pairs (on, _t, _e, _o) for each text."""
    scored = pairs.withColumn("score", indel_ratio(F.col("_t"), F.col("_e"))).filter((F.col("score") >= cutoff) & (F.col("score") > 0))
    best = F.min_by(F.struct(F.col("_e").alias(entry), "score"), F.struct((-F.col("score")).alias("s"), "_o"))
    return scored.groupBy(*on, F.col("_t").alias(text)).agg(best.alias("x")).select(*on, text, "x.*")


def best_match(texts: DataFrame, dictionary: DataFrame, text: str, entry: str, cutoff: float, on: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """(on, text) -> best entry with a ratio of `cutoff` or more, and score; ties go to the first in order (by default of the entries). Distinct texts meet the entries that candidates() finds."""
    names = dictionary.select(*on, F.col(entry).alias("_e"), F.col(order or entry).alias("_o")).distinct()
    rows = texts.select(*on, F.col(text).alias("_t")).distinct().filter("_t is not null")
    return _best(candidates(rows, names, cutoff, on), on, entry, text, cutoff)


def nearest(texts: DataFrame, dictionary: DataFrame, text: str, entry: str, cutoff: float, on: Sequence[str]) -> DataFrame:
    """As best_match, but a text without match gets its best entry at any ratio above 0: looked for at lower cutoffs, and, for what is left then, among all entries of its key (which is dealt out in parts)."""
    names = stored(dictionary.select(*on, F.col(entry).alias("_e"), F.col(entry).alias("_o")).distinct(), "entries")
    rows = stored(texts.select(*on, F.col(text).alias("_t")).distinct().filter("_t is not null"), "texts")
    found = None
    for least in (cutoff, *(c for c in _LOWER if c < cutoff)):
        more = stored(_best(candidates(rows, names, least, on), on, entry, "_t", least), "matches")
        found = more if found is None else found.unionByName(more)
        rows = rows.join(more, [*on, "_t"], "left_anti")
    parts = names.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    pairs = rows.withColumn("part", F.pmod(F.hash("_t"), F.lit(_SALTS))).join(parts, [*on, "part"]).drop("part")
    return found.unionByName(_best(pairs, on, entry, "_t", 0)).withColumnRenamed("_t", text)


def correct_plain(lines: DataFrame, dictionary: DataFrame, cutoff: float = 80) -> DataFrame:
    """lines with corrected (the best entry, else the text as it is) and score (0 without one). dictionary: (entry)."""
    found = best_match(lines, dictionary, "text", "entry", cutoff)
    return lines.join(found, "text", "left").select(*lines.columns, F.coalesce("entry", "text").alias("corrected"), F.coalesce("score", F.lit(0.0)).alias("score"))


def correct_normalized(lines: DataFrame, dictionary: DataFrame, cutoff: float = 80, diagnose: bool = True, leveled: Sequence[str] = ("reforge",), headed: Sequence[str] = ("enchant",)) -> DataFrame:
    """lines (section, text) with corrected, score and paren_range, by the section's dictionary (section, entry).

    A bullet at the start, all parentheses and, in sections that are `leveled`, a level at the end are put aside; of an enchant's header in sections that are
    `headed` the name alone counts. Numbers become N; the best entry gets the text's numbers, and bullet and level back. paren_range is the
    first of the parentheses. score: -2 for a section without dictionary; for a null section all entries count; 0 if nothing is left to compare; below the
    cutoff the candidate comes with a negative score (diagnose; without it only matches are searched for and others get 0).
    """
    leveled_, headed_ = (F.coalesce(F.col("section").isin(*names), F.lit(False)) if names else F.lit(False) for names in (leveled, headed))
    name = F.when(headed_, enchant_header(F.col("text"))["name"])
    prefix = F.when(name.isNotNull(), "").otherwise(bullet(F.col("text")))
    rest = F.substring(F.col("text"), F.length("prefix") + 1, F.length("text"))
    parts = lines.withColumn("prefix", prefix).withColumn("rest", F.coalesce(name, rest)).withColumn("own", name_and_levels(F.col("rest"))["name"])
    behind = F.substring(F.col("rest"), F.instr("rest", F.col("own")) + F.length("own"), F.length("rest"))
    level = F.when(leveled_ & F.col("own").isNotNull() & behind.contains("/") & F.rtrim(behind, F.lit(" )")).endswith("레벨"), behind)
    parts = parts.withColumn("level", F.coalesce(level, F.lit(""))).withColumn("bare", F.substring(F.col("rest"), F.lit(1), F.length("rest") - F.length("level")))
    parts = parts.withColumns({"paren_range": F.nullif(F.regexp_extract("bare", r"[(].*?[)]", 0), F.lit("")), "core": F.trim(F.regexp_replace("bare", r"\s*[(].*?[)]", ""))}).withColumn("norm", normalize_numbers(F.col("core")))
    everything = F.lit("\x00all")
    entries = dictionary.select("section", normalize_numbers(F.col("entry")).alias("norm_entry")).distinct()
    known = entries.select("section").distinct().withColumn("has_dictionary", F.lit(True))
    entries = entries.unionByName(entries.select(everything.alias("section"), "norm_entry").distinct()).withColumnRenamed("section", "key")
    keyed = stored(parts.join(known, "section", "left").withColumn("key", F.coalesce("section", everything)), "parts")
    wanted = keyed.filter("norm <> '' and (section is null or has_dictionary)")
    match = (nearest if diagnose else best_match)(wanted, entries, "norm", "norm_entry", cutoff, ["key"])
    rows = keyed.join(match.withColumnRenamed("score", "raw"), ["key", "norm"], "left")
    filled = F.concat("prefix", inject_numbers(F.col("norm_entry"), numbers(F.col("core")), keep=True), "level")
    unknown = F.col("section").isNotNull() & F.col("has_dictionary").isNull()
    score = F.when(unknown, -2.0).when(F.col("raw").isNull(), 0.0).when(F.col("raw") >= cutoff, F.col("raw")).otherwise(-F.col("raw"))
    return rows.select(*lines.columns, F.when(F.col("raw").isNull(), F.col("text")).otherwise(filled).alias("corrected"), score.alias("score"), F.when(~unknown & (F.col("core") != ""), F.col("paren_range")).alias("paren_range"))


def apply_corrections(lines: DataFrame, dictionary: DataFrame, is_bullet: Column, cutoff: float = 80, **forms) -> DataFrame:
    """forms: leveled and headed, as in correct_normalized. Corrects bullet lines of sections with a dictionary: text is replaced and fm_applied set; below the cutoff the candidate goes to rejected, with its score."""
    marked = lines.withColumn("bullet", is_bullet)
    done = correct_normalized(marked.filter("bullet").drop("bullet"), dictionary, cutoff, **forms)
    hit = F.col("score") > 0
    fixed = done.select(*[c for c in lines.columns if c != "text"], F.when(hit, F.col("corrected")).otherwise(F.col("text")).alias("text"), hit.alias("fm_applied"), F.when(hit, F.col("paren_range")).alias("detail_range"), F.when((F.col("score") < 0) & (F.col("score") != -2), F.col("corrected")).alias("rejected"), "score")
    none = F.lit(None).cast("string")
    return fixed.unionByName(marked.filter("not bullet").drop("bullet").select(*lines.columns, F.lit(False).alias("fm_applied"), none.alias("detail_range"), none.alias("rejected"), F.lit(0.0).alias("score")))


def match_headers(headers: DataFrame, patterns: DataFrame, cutoff: float = 50) -> DataFrame:
    """headers (text) with the section of the pattern (section, pattern) of the best partial ratio, null below the cutoff. The patterns are a fixed list of section titles."""
    texts = headers.select("text").filter("text is not null").distinct()
    listed = patterns.agg(F.collect_set(F.struct("section", "pattern")).alias("listed"))  # one row
    pairs = texts.join(F.broadcast(listed)).select("text", F.explode("listed").alias("p")).select("text", "p.*").withColumn("score", partial_ratio(F.col("text"), F.col("pattern")))
    best = pairs.filter(F.col("score") >= cutoff).groupBy("text").agg(F.min_by("section", F.struct((-F.col("score")).alias("s"), "pattern")).alias("section"))
    return headers.join(best, "text", "left")


def lookup_names(queries: DataFrame, entries: DataFrame, cutoff: float = 85) -> DataFrame:
    """queries (name, slot) -> entry: exact name in the slot, else the best ratio there."""
    exact = entries.select("slot", F.col("name").alias("entry"), F.col("name")).distinct()
    found = queries.join(exact, ["slot", "name"], "left")
    missed = found.filter("entry is null").select("slot", "name").distinct()
    fuzzy = best_match(missed, entries.select("slot", F.col("name").alias("near")), "name", "near", cutoff, ["slot"]).select("slot", "name", "near", "score")
    return found.join(fuzzy, ["slot", "name"], "left").select(*queries.columns, F.coalesce("entry", "near").alias("entry"), F.when(F.col("entry").isNotNull(), 100.0).otherwise(F.col("score")).alias("score"))


#: Effects of a row of text_score_lists() at most, where their numbers follow one another.
_BLOCK = 128


def text_score_lists(lines: DataFrame, effects: DataFrame, on: Sequence[str], floor: float = 0.0) -> DataFrame:
    """As text_scores(), but (on, text, effects, scores): a row for each text and block of effects. A task takes an array of effects with each text, so no row is made for a pair, and none is shuffled."""
    forms = effects.select(*on, "effect_no", F.explode(F.array("effect", F.concat_ws(" ", "condition", "effect"))).alias("_e")).filter("_e is not null")
    forms = forms.groupBy(*on, "effect_no").agg(F.collect_set("_e").alias("forms"))
    blocks = forms.groupBy(*on, F.floor(F.col("effect_no") / _BLOCK).alias("_block")).agg(F.collect_list(F.struct("effect_no", "forms")).alias("p"))
    blocks = blocks.select(*on, F.col("p.effect_no").alias("effects"), F.col("p.forms").alias("forms"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_part"))
    texts = lines.select(*on, "text").filter("text is not null").distinct().withColumn("_part", F.pmod(F.hash("text"), F.lit(_SALTS)))
    # a few bytes are much to compare: a number of partitions, as Spark would join those of few bytes to one; of large tables (sources.tables.fit_partitions) there are more
    spark = lines.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")) // 16)
    key = [*on, "_part"]
    rows = texts.repartition(n, *key).join(blocks.repartition(n, *key), key).select(*on, "text", "effects", "forms")
    out = rows.select(*on, "text", "effects", F.array(F.lit(0.0)).alias("scores")).schema
    form = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            *keys, texts, effects, forms = batch.columns
            words = forms.values.values.dictionary_encode()
            at, of = forms.offsets.to_numpy(), forms.values.offsets.to_numpy()  # of a text's effects, of an effect's forms
            ends = of[at]
            pairs = ratios(texts.to_pylist(), words.dictionary.to_pylist(), np.diff(ends), words.indices.to_numpy()[ends[0] : ends[-1]])
            scores = np.maximum.reduceat(pairs, of[at[0] : at[-1]] - ends[0]) if len(pairs) else pairs
            keep = scores >= floor
            places = pa.array(np.concatenate([[0], np.cumsum(keep)])[at - at[0]], pa.int32())
            numbers_ = effects.values.slice(effects.offsets[0].as_py(), len(keep)).filter(pa.array(keep))
            lists = [pa.ListArray.from_arrays(places, v).cast(f.type) for v, f in zip((numbers_, pa.array(scores[keep])), list(form)[-2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, texts, *lists], schema=form)

    return rows.mapInArrow(run, out)


def text_scores(lines: DataFrame, effects: DataFrame, on: Sequence[str], floor: float = 0.0) -> DataFrame:
    """(on, text, effect_no, score) of the texts of lines (on, text) and effects (on, effect_no, effect, condition), `floor` at least: the better score of the effect alone and with its condition.

    Equal texts of a key are compared with its effects once.
    """
    lists = text_score_lists(lines, effects, on, floor)
    return lists.select(*on, "text", F.explode(F.arrays_zip("effects", "scores")).alias("p")).select(*on, "text", F.col("p.effects").alias("effect_no"), F.col("p.scores").alias("score"))


def effect_scores(lines: DataFrame, effects: DataFrame, on: Sequence[str], floor: float = 0.0) -> DataFrame:
    """lines (on, line_no, text) x effects (on, effect_no, effect, condition) -> score, as text_scores() finds it."""
    return lines.join(text_scores(lines, effects, on, floor), [*on, "text"]).join(effects, [*on, "effect_no"])


def contender_lists(lines: DataFrame, scores: DataFrame, by: Sequence[str], on: Sequence[str], low_first: bool = False) -> DataFrame:
    """(by, line_no, effects, scores): for each line the pairs that an assignment within the groups (by) can take, the best first. lines: (by, line_no, text); scores: as of text_scores() or text_score_lists(), by `on`.

    Each other line of a group takes one effect at most, so a line with n - 1 others gets one of its n best effects, or none. Of equal scores the
    higher effect counts as better (`low_first`: the lower one).
    """
    sized = lines.select(*by, "line_no", "text", F.count("*").over(Window.partitionBy(*by)).cast("int").alias("_n"))
    most = lines.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("most"))  # one row
    first = lambda c, n="_n": F.slice(c, F.lit(1), F.col(n))
    if "scores" in scores.columns:
        best = lambda pairs: F.array_sort(pairs) if low_first else F.sort_array(pairs, asc=False)
        pairs = F.zip_with("scores", "effects", lambda s, e: F.struct((-s if low_first else s).alias("score"), e.alias("effect_no")))
        ranked = scores.join(F.broadcast(most)).select(*on, "text", "most", first(best(pairs), "most").alias("p"))
        ranked = ranked.groupBy(*on, "text", "most").agg(F.flatten(F.collect_list("p")).alias("p")).select(*on, "text", first(best(F.col("p")), "most").alias("_best"))
        score = F.transform("_best.score", lambda s: -s if low_first else s)
    else:
        better = [F.desc("score"), F.asc("effect_no") if low_first else F.desc("effect_no")]
        ranked = scores.withColumn("_rank", F.row_number().over(Window.partitionBy(*on, "text").orderBy(*better))).join(F.broadcast(most)).filter("_rank <= most")
        ranked = ranked.groupBy(*on, "text").agg(F.sort_array(F.collect_list(F.struct("_rank", "effect_no", "score"))).alias("_best"))
        score = F.col("_best.score")
    ranked = ranked.select(*on, "text", F.col("_best.effect_no").alias("_effects"), score.alias("_scores"))
    return sized.join(ranked, [*on, "text"]).select(*by, "line_no", first("_effects").alias("effects"), first("_scores").alias("scores"))


def contenders(lines: DataFrame, scores: DataFrame, by: Sequence[str], on: Sequence[str], low_first: bool = False) -> DataFrame:
    """(by, line_no, effect_no, score): the pairs of contender_lists(), a row for each."""
    return _unpacked(contender_lists(lines, scores, by, on, low_first), by)


def _unpacked(lists: DataFrame, by: Sequence[str]) -> DataFrame:
    return lists.select(*by, "line_no", F.explode(F.arrays_zip("effects", "scores")).alias("p")).select(*by, "line_no", F.col("p.effects").alias("effect_no"), F.col("p.scores").alias("score"))


def _packed(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lists (by, line_no, effects, scores) as they are; pairs (by, line_no, effect_no, score) become a list for each line."""
    if "effects" in pairs.columns:
        return pairs.select(*by, "line_no", "effects", "scores")
    return pairs.groupBy(*by, "line_no").agg(F.collect_list(F.struct("effect_no", "score")).alias("p")).select(*by, "line_no", F.col("p.effect_no").alias("effects"), F.col("p.score").alias("scores"))


#: Groups of more pairs than this are assigned in rounds.
_LARGE = 1_000_000


def _by_best(lines: dict) -> list[tuple]:
    """The greedy pairs (line, effect, score) of a group. lines: line -> iterator over its pairs (score, effect), the best first. A line asks for its best effect, which stays with the best (score, line) that
    has asked; who loses it asks for their next one. As the order of pairs is total, that ends with the pairs that the greedy order takes, after a look at few of them."""
    holders, waiting = {}, list(lines)
    while waiting:
        line = waiting.pop()
        for score, effect in lines[line]:
            if score <= 0:
                break
            other = holders.get(effect)
            if other is None or other < (score, line):
                holders[effect] = score, line
                if other is not None:
                    waiting.append(other[1])
                break
    return [(line, effect, score) for effect, (score, line) in holders.items()]


def _in_turn(lines) -> list[tuple]:
    """As _by_best, but (line, pairs) in order, each taking its best effect that is left, of equal ones the lower number."""
    taken = {}
    for line, pairs in lines:
        free = [x for x in pairs if x[1] not in taken]
        if free:
            score, effect = min(free, key=lambda x: (-x[0], x[1]))
            taken[effect] = line, effect, score
    return list(taken.values())


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Values of the lists of a column without null lists, and where each list ends (0 first)."""
    ends = column.offsets.to_numpy()
    return column.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


def _ranked(effects: pa.ListArray, scores: pa.ListArray) -> list[bool]:
    """Whether each list has its pairs without nulls and the best first: greater scores, of equal ones the higher effect."""
    (e, ends), (s, _) = _flat(effects), _flat(scores)
    if e.null_count or s.null_count or not pa.types.is_integer(e.type):
        return [False] * len(effects)
    e, s = e.to_numpy(), s.to_numpy()
    wrong = np.zeros(len(s) + 1, bool)
    wrong[1:-1] = ~((s[:-1] > s[1:]) | (s[:-1] == s[1:]) & (e[:-1] > e[1:]))
    wrong[ends] = False  # between two lists
    before = np.concatenate([[0], np.cumsum(wrong)])[ends]
    return (before[1:] == before[:-1]).tolist()


def _items(column: pa.ListArray) -> list[list]:
    """The lists of a column without null lists; a scalar for each value would take most of the time."""
    values, ends = _flat(column)
    values = values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False).tolist()
    return [values[a:b] for a, b in pairwise(ends.tolist())]


def _take_free(lists: DataFrame, by: Sequence[str], greedy: bool, floor: float = 0.0) -> DataFrame:
    """The pairs (by, line_no, effect_no, score) that are taken, of scores above 0 (greedy) or `floor` at least. lists: (by, line_no, effects, scores). A line is a row, and groups pass one after the other."""
    rows = _unpacked(lists, by)
    form, width = to_arrow_schema(rows.schema), len(by)

    def pairs(parts):
        """(score, effect) of the rows (ranked, effects, scores) of a line; one row that is ranked is read as far as it is asked for."""
        if greedy and len(parts) == 1 and parts[0][0]:
            return zip(parts[0][2], parts[0][1], strict=True)
        every = [(s, e) for _, effects, scores in parts for s, e in zip(scores, effects, strict=True) if s is not None and (greedy or s >= floor)]
        return iter(sorted(every, reverse=True)) if greedy else every

    def groups(batches):
        """(group, line -> its rows); lines in order."""
        last, lines = None, {}
        for batch in batches:
            *group, line_no = (c.to_pylist() for c in batch.columns[: width + 1])
            effects, scores = batch.columns[-2:]
            for key, line, *row in zip(zip(*group, strict=True), line_no, _ranked(effects, scores), _items(effects), _items(scores), strict=True):
                if key != last:
                    if last is not None:
                        yield last, lines
                    last, lines = key, {}
                lines.setdefault(line, []).append(row)
        if last is not None:
            yield last, lines

    def run(batches):
        found = []
        for group, lines in groups(batches):
            taken = _by_best({line: pairs(parts) for line, parts in lines.items()}) if greedy else _in_turn((line, pairs(parts)) for line, parts in lines.items())
            found += [(*group, *pair) for pair in taken]
            if len(found) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), form, strict=True)], schema=form)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), form, strict=True)], schema=form)

    return lists.repartition(*by).sortWithinPartitions(*by, "line_no").mapInArrow(run, rows.schema)


def assign_greedy(scores: DataFrame, by: Sequence[str], large: int = _LARGE) -> DataFrame:
    """1:1 pairs of lines and effects, the best scores first (of equal ones the higher line, then the higher effect), scores above 0 only. scores: pairs (by, line_no, effect_no, score), or a list of them for each line (by, line_no, effects, scores).

    Groups of up to `large` pairs pass a task, a row for each line. Larger ones are assigned in rounds: a pair that is the best one left of its line and of its effect is one that the greedy order
    takes, as that order is total; it is taken, and its line and effect go. No group of those is gathered, and each round leaves fewer pairs.
    """
    listed = "effects" in scores.columns
    pairs = stored(_packed(scores, by) if listed else scores.select(*by, "line_no", "effect_no", "score").filter("score > 0"), "pairs")
    size = F.sum(F.size("effects")) if listed else F.count("*")
    wide = stored(pairs.groupBy(*by).agg(size.alias("n")).filter(F.col("n") > large).select(*by), "wide")
    if wide.isEmpty():
        return _take_free(_packed(pairs, by), by, True)
    wider = pairs.join(wide, list(by), "left_semi")
    wider = _unpacked(wider, by).filter("score > 0") if listed else wider
    return _take_free(_packed(pairs.join(wide, list(by), "left_anti"), by), by, True).unionByName(_in_rounds(wider, by))


def _in_rounds(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    columns = [*by, "line_no", "effect_no", "score"]
    left = stored(pairs.select(*columns).distinct(), "pairs")
    order, taken = F.struct("score", "line_no", "effect_no"), left.limit(0)
    while not left.isEmpty():
        top = lambda side: F.max(order).over(Window.partitionBy(*by, side)) == order
        marked = stored(left.withColumn("top", top("line_no") & top("effect_no")), "marked")
        won = marked.filter("top").select(*columns)
        taken = taken.unionByName(won)
        left = marked.filter("not top").select(*columns).join(won.select(*by, "line_no"), [*by, "line_no"], "left_anti").join(won.select(*by, "effect_no"), [*by, "effect_no"], "left_anti")
        left = stored(left.select(*columns), "pairs")
    return taken


def _bounds(lines: DataFrame, scores: DataFrame, by: Sequence[str], on: Sequence[str]) -> DataFrame:
    """(by, bound): what no 1:1 assignment of a group's lines (by, text) exceeds. Of the lines with the same best effect one gets it, and each other one its second best score at most."""
    order = F.row_number().over(Window.partitionBy(*on, "text").orderBy(F.desc("score"), F.desc("effect_no")))
    at = lambda rank, c: F.max(F.when(F.col("_rank") == rank, F.col(c)))
    two = scores.withColumn("_rank", order).filter("_rank <= 2").groupBy(*on, "text").agg(at(1, "effect_no").alias("_effect"), at(1, "score").alias("_one"), F.coalesce(at(2, "score"), F.lit(0.0)).alias("_two"))
    rows = lines.select(*by, "text").join(two, [*on, "text"])
    per = rows.groupBy(*by, "_effect").agg((F.sum("_two") + F.max(F.col("_one") - F.col("_two"))).alias("_most"))
    return per.groupBy(*by).agg((F.sum("_most") + 1e-6).alias("bound"))


def with_unmatched(pairs: DataFrame, lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Assigned pairs (by, line_no, effect_no, score), and the lines (by, line_no) without one with effect_no -1 and score 0."""
    pairs = stored(pairs, "assigned")
    left = lines.select(*by, "line_no").join(pairs, [*by, "line_no"], "left_anti")
    return pairs.unionByName(left.withColumns({"effect_no": F.lit(-1).cast(pairs.schema["effect_no"].dataType), "score": F.lit(0.0)}))


def assign_in_turn(scores: DataFrame, by: Sequence[str], floor: float = 0.0) -> DataFrame:
    """1:1 pairs, line after line: each takes its best effect that is still free (of equal ones the lower number); another assignment than assign_greedy. scores: as there, of `floor` at least. A group is a slot's lines times one entry's effects; it passes one task, a row for each line."""
    return _take_free(_packed(scores, by), by, False, floor)


def effect_text(text: Column, effect: Column, ranged: Column) -> Column:
    """The dictionary's text; for a ranged effect ('a ~ b' in it) the rolled number of the line in the range's place: the first number behind the option's name, the second one if the name holds a number."""
    name = F.regexp_extract(effect, r"^(.*?)\d", 1)
    found = numbers(text)
    behind = numbers(F.substring(text, F.length(name) + 1, F.length(text)))
    rolled = F.coalesce(F.get(behind, F.lit(0)), F.get(found, F.lit(1)), F.get(found, F.lit(0)))
    return F.when(ranged & rolled.isNotNull(), F.regexp_replace(effect, F.lit(r"\d+(?:\.\d+)?\s*~\s*\d+(?:\.\d+)?"), rolled)).otherwise(effect)


def resolve_by_evidence(slots: DataFrame, lines: DataFrame, entries: DataFrame, effects: DataFrame) -> DataFrame:
    """slots (session, slot, header), lines (session, slot, line_no, text), entries (entry, slot, name), effects (entry, effect_no, effect, condition) -> (session, slot, entry, name_score, effect_score, how).

    Candidates are entries within 15 of the best name score (30 at least), ranked by the total score
    of their effects (pairs above 50), then by name. Accepted with a name of 80 or effects of 120. If no
    candidate has effects, effects alone decide (100 in all); else a name of 80; else none.
    """
    # equal headers of a kind of slot are compared with the names once
    named = slots.select("slot", "header").distinct().join(entries.select("entry", "slot", "name"), "slot").withColumn("name_score", indel_ratio(F.col("header"), F.col("name")))
    top = F.max("name_score").over(Window.partitionBy("slot", "header"))
    near = named.withColumn("top", top).filter("name_score >= 30 and name_score >= top - 15").select("slot", "header", "entry", "name_score")
    candidates = slots.join(near, ["slot", "header"]).select("session", "slot", "entry", "name_score")
    candidates = stored(candidates, "candidates")

    slot, group = ["session", "slot"], ["session", "slot", "entry"]

    def totals(of: DataFrame) -> DataFrame:
        """effect_score of each slot's entries that can have its greatest: the entry with the greatest bound is assigned first, then those whose bound reaches what that one has."""
        mine = lines.join(of.select(*group), slot)
        scores = stored(text_scores(mine, effects, ["entry"], 50.0).filter("score > 50"), "scores")
        bound = stored(_bounds(mine, scores, group, ["entry"]), "bounds")

        def sums(chosen: DataFrame) -> DataFrame:
            pairs = contender_lists(lines.join(chosen.select(*group), slot), scores, group, ["entry"])
            return stored(assign_greedy(pairs, group).groupBy(*group).agg(F.sum("score").alias("effect_score")), "totals")

        got = sums(bound.groupBy(*slot).agg(F.max_by("entry", F.struct("bound", "entry")).alias("entry")))
        more = bound.join(got.select(*slot, F.col("entry").alias("done"), F.col("effect_score").alias("least")), slot).filter("entry <> done and bound >= least")
        return got.unionByName(sums(more))

    scored = stored(totals(candidates), "scored")
    # where an entry has effects, those that can't have the most are out
    ranked = candidates.join(scored, group, "left").join(scored.select(*slot).distinct().withColumn("any", F.lit(True)), slot, "left").filter("effect_score is not null or any is null").drop("any").na.fill(0.0, ["effect_score"])
    best = F.min_by(F.struct("entry", "name_score", "effect_score"), F.struct((-F.col("effect_score")).alias("a"), (-F.col("name_score")).alias("b"), "entry"))
    first = stored(ranked.groupBy("session", "slot").agg(best.alias("x")).select("session", "slot", "x.*"), "first")
    # effects alone decide only where no candidate has any: the other slots aren't compared with all entries
    open_slots = slots.select("session", "slot").join(first.filter("effect_score > 0"), ["session", "slot"], "left_anti")
    alone = stored(open_slots.join(entries.select("entry", "slot"), "slot").select("session", "slot", "entry"), "alone")
    alone = totals(alone).groupBy("session", "slot").agg(F.min_by(F.struct("entry", "effect_score"), F.struct((-F.col("effect_score")).alias("a"), "entry")).alias("y"))
    rows = slots.select("session", "slot").join(first, ["session", "slot"], "left").join(alone, ["session", "slot"], "left")
    by_name = (F.col("name_score") >= 80) | (F.col("effect_score") >= 120)
    by_effects = (F.coalesce("effect_score", F.lit(0.0)) == 0) & (F.col("y.effect_score") >= 100)
    how = F.when(F.coalesce(by_name & (F.col("effect_score") > 0), F.lit(False)), "evidence").when(F.coalesce(by_effects, F.lit(False)), "effects").when(F.coalesce(F.col("name_score") >= 80, F.lit(False)), "name")
    rows = rows.withColumn("how", how)
    return rows.select("session", "slot", F.when(F.col("how") == "effects", F.col("y.entry")).when(F.col("how").isNotNull(), F.col("entry")).alias("entry"), "name_score", F.when(F.col("how") == "effects", F.col("y.effect_score")).otherwise(F.col("effect_score")).alias("effect_score"), "how")


def resolve_by_effects(lines: DataFrame, entries: DataFrame, effects: DataFrame) -> DataFrame:
    """The entry with the greatest matched score per effect (50 at least; matches above 60, taken in turn): of the slot's entries first, then of all.

    A slot of n lines has a total of 100 n at most, so entries with more than 2 n effects are out before anything is compared; the others are bounded by their lines' best and
    second best scores. The entry with the greatest bound of a slot is assigned first; then only those whose bound reaches what that one has.
    """
    n = stored(effects.groupBy("entry").agg(F.count("*").alias("n_effects")), "sizes")
    slot, group = ["session", "slot"], ["session", "slot", "entry"]
    counts = lines.groupBy(*slot).agg(F.count("*").alias("n_lines"))

    def best(named: DataFrame, column: str) -> DataFrame:
        """The best of the entries of the kind of slot in `column`."""
        kinds = named.select(*slot, F.col(column).alias("_kind")).distinct()
        possible = kinds.join(counts, slot).join(entries.select("entry", F.col("slot").alias("_kind")).join(n, "entry"), "_kind").filter("100 * n_lines + 1e-6 >= 50 * n_effects")
        possible = stored(possible.select(*group, "n_effects"), "possible")
        mine = lines.join(possible.select(*group), slot)
        scores = stored(text_scores(mine, effects, ["entry"], 60.0).filter("score > 60"), "scores")
        bound = _bounds(mine, scores, group, ["entry"]).join(n, "entry").withColumn("bound", F.col("bound") / F.col("n_effects")).filter("bound >= 50")
        bound = stored(bound.select(*group, "bound"), "bounds")

        def per_effect(chosen: DataFrame) -> DataFrame:
            pairs = contender_lists(lines.join(chosen.select(*group), slot), scores, group, ["entry"], low_first=True)
            total = assign_in_turn(pairs, group).groupBy(*group).agg(F.sum("score").alias("total"))
            return stored(total.join(n, "entry").select(*group, (F.col("total") / F.col("n_effects")).alias("per_effect")), "per_effect")

        got = per_effect(bound.groupBy(*slot).agg(F.max_by("entry", F.struct("bound", "entry")).alias("entry")))
        more = bound.join(got.select(*slot, F.col("entry").alias("done"), F.col("per_effect").alias("least")), slot).filter("entry <> done and bound >= least")
        every = got.unionByName(per_effect(more)).filter("per_effect >= 50")
        return every.groupBy(*slot).agg(F.min_by(F.struct("entry", "per_effect"), F.struct((-F.col("per_effect")).alias("a"), "entry")).alias("x")).select(*slot, "x.*")

    own = stored(best(lines, "slot"), "own")
    left = lines.join(own, slot, "left_anti")
    # every other slot with the entries of the other kind
    return own.unionByName(best(left.withColumn("other", 1 - F.col("slot")), "other"))


def resolve_by_priority(sources: Sequence[tuple[str, DataFrame]], keys: DataFrame, entries: DataFrame) -> DataFrame:
    """keys (session, slot); sources: (label, (session, slot, name)) in order of trust. The first whose name is in the dictionary wins; all candidates are recorded."""
    names = entries.select("slot", F.col("name").alias("found")).distinct()
    rows = keys
    for label, df in sources:
        known = df.join(names, (df["slot"] == names["slot"]) & (df["name"] == names["found"]), "left").select("session", df["slot"].alias("slot"), F.struct(F.lit(label).alias("source"), df["name"].alias("name"), F.col("found").isNotNull().alias("known")).alias(label))
        rows = rows.join(known, ["session", "slot"], "left")
    labels = [label for label, _ in sources]
    candidates = F.filter(F.array(*labels), lambda x: x.isNotNull())
    winner = F.get(F.filter(candidates, lambda x: x["known"]), F.lit(0))
    return rows.select("session", "slot", winner["name"].alias("name"), winner["source"].alias("source"), candidates.alias("candidates"))


def fill_template(lines: DataFrame, resolved: DataFrame, effects: DataFrame) -> DataFrame:
    """Matched lines in order (scores of 50 at least, each effect once) with their dictionary effect, then the entry's other effects without a line."""
    mine = lines.join(resolved.select("session", "slot", "entry"), ["session", "slot"])
    scores = stored(text_scores(mine, effects, ["entry"], 50.0), "scores")
    taken = stored(assign_in_turn(contender_lists(mine, scores, ["session", "slot", "entry"], ["entry"], low_first=True), ["session", "slot", "entry"], 50.0), "taken")
    texts = lines.select("session", "slot", "line_no", "text")
    matched = taken.join(texts, ["session", "slot", "line_no"]).join(effects, ["entry", "effect_no"])
    blank = resolved.select("session", "slot", "entry").join(effects, "entry").join(taken, ["session", "slot", "entry", "effect_no"], "left_anti")
    ranged = F.col("effect").rlike(r"\d\s*~\s*\d")
    matched = matched.select("session", "slot", "entry", "effect_no", "line_no", effect_text(F.col("text"), F.col("effect"), ranged).alias("text"), "score")
    return matched.unionByName(blank.select("session", "slot", "entry", "effect_no", F.lit(None).cast("long").alias("line_no"), F.lit("").alias("text"), F.lit(None).cast("double").alias("score")))


def resolve_item_names(texts: DataFrame, blessings: DataFrame, egos: DataFrame, items: DataFrame, prefixes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """texts (id, text) of words: leading blessing (70) and ego word (70) are dropped, the item that best matches a run of words at the end (60, ties to the longest run) is taken, and the words before it are split into prefix and suffix with the best sum of ratios (60 each), compared letter by letter. The other tables: (name)."""

    def near(rows: DataFrame, column: str, dictionary: DataFrame, cutoff: float, found: str) -> DataFrame:
        letters = rows.select(F.col(column).alias("w")).filter("w <> ''").distinct().select("w", jamo(F.col("w")).alias("l"))
        names = dictionary.select(F.col("name").alias(found), jamo(F.col("name")).alias("e")).distinct()
        letters, names = stored(letters, "letters"), stored(names, "names")
        best = stored(best_match(letters, names, "l", "e", cutoff), "matches")
        return letters.join(best, "l").join(names, "e").groupBy("w").agg(F.min(found).alias(found), F.first("score").alias(f"{found}_score")).withColumnRenamed("w", column)

    rows = texts.withColumn("words", F.split(F.trim("text"), r"\s+"))
    for dictionary, name in ((blessings, "blessing"), (egos, "ego")):
        rows = rows.withColumn("first", F.when(F.size("words") > 1, F.col("words")[0]))
        rows = rows.join(near(rows.filter("first is not null"), "first", dictionary, 70, name).drop(f"{name}_score"), "first", "left")
        rows = rows.withColumn("words", F.when(F.col(name).isNotNull(), F.slice("words", 2, F.size("words") - 1)).otherwise(F.col("words"))).drop("first")
        rows = stored(rows, "rows")
    ends = rows.select("id", "words", "blessing", "ego", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("n")).withColumn("end", F.array_join(F.slice("words", -F.col("n"), F.col("n")), " "))
    named = ends.join(near(ends, "end", items, 60, "item"), "end").groupBy("id").agg(F.min_by(F.struct("item", "n", "words"), F.struct((-F.col("item_score")).alias("a"), (-F.col("n")).alias("b"))).alias("x")).select("id", "x.*")
    named = stored(named, "named")
    left = named.withColumn("before", F.slice("words", F.lit(1), F.size("words") - F.col("n")))
    splits = left.select("id", "before", F.explode(F.sequence(F.lit(0), F.size("before"))).alias("k")).select("id", F.array_join(F.slice("before", F.lit(1), F.col("k")), " ").alias("p"), F.array_join(F.slice("before", F.col("k") + 1, F.size("before")), " ").alias("s"))
    splits = splits.join(near(splits, "p", prefixes, 60, "prefix"), "p", "left").join(near(splits, "s", suffixes, 60, "suffix"), "s", "left")
    total = F.coalesce("prefix_score", F.lit(0.0)) + F.coalesce("suffix_score", F.lit(0.0))
    best = splits.groupBy("id").agg(F.min_by(F.struct("prefix", "suffix"), F.struct((-total).alias("a"), "p")).alias("y")).select("id", "y.*")
    return rows.select("id", "blessing", "ego").join(named.select("id", "item"), "id", "left").join(best, "id", "left")
