"""Queries over fuzzy matching, resolution and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.functions.similarity import register_fz_ratio
from bazaarlake.operators import extract as E
from bazaarlake.operators import fuzzy as Z
from bazaarlake.plans.registry import query
from bazaarlake.sources.scratch import stored

# The longest common subsequence as a recursion over the first text's characters; a cell is the greatest so far in its row.
_LCS = """lcs(a, b, i, r) AS (SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM pairs
  UNION ALL SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN r[k] + 1 ELSE r[k + 1] END))))
  FROM lcs WHERE i < length(a)),
ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * r[-1] / (length(a) + length(b)) END AS score FROM lcs WHERE i = length(a))"""
_BAND = "200 * least(length(a), length(b)) >= 80 * (length(a) + length(b))"


@query(f"WITH RECURSIVE pairs AS (SELECT DISTINCT text AS a, gt AS b FROM noisy_lines), {_LCS} SELECT line_id, score FROM noisy_lines JOIN ratios ON a = text AND b = gt")
def fz_ratio(t):
    register_fz_ratio(t.spark)
    return t.noisy_lines.select("line_id", F.expr("fz_ratio(text, gt)").alias("score"))


def _dictionary(t):
    return t.dict_names.select(F.col("name").alias("entry"))


@query(f"""WITH RECURSIVE pairs AS (SELECT a, b FROM (SELECT DISTINCT text AS a FROM noisy_lines), (SELECT name AS b FROM dict_names) WHERE {_BAND}), {_LCS},
best AS (SELECT a, arg_min(b, (-score, b)) AS b, max(score) AS score FROM ratios WHERE score >= 80 GROUP BY a)
SELECT line_id, coalesce(b, text) AS corrected, coalesce(score, 0) AS score FROM noisy_lines LEFT JOIN best ON a = text""")
def fz_dict_plain(t):
    return Z.correct_plain(t.noisy_lines, _dictionary(t)).select("line_id", "corrected", "score")


# Dictionaries of the sections, but for one section; some entries end in a number.
_SECTIONS = "SELECT DISTINCT p_type AS section, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' 7' ELSE '' END AS entry FROM part WHERE p_type <> 'PROMO'"
# Lines with each kind of bullet, with numbers, ranges and other parentheses, some with a level; some lines have no section.
_NUMBERED = """SELECT line_id, CASE WHEN line_id % 11 <> 0 THEN section END AS section, CASE line_id % 9 WHEN 0 THEN '· ' || gt || ' 5 (전용 해제)' WHEN 1 THEN ', ' || text WHEN 3 THEN text || ' (3~6)' WHEN 4 THEN '. ' || text || ' 12.5' WHEN 5 THEN 'ㄴ' || gt || ' (1%~2%) 8 (x)'
 WHEN 6 THEN 'L ' || text || ' 3(15/20 레벨)' WHEN 7 THEN gt || ' 1 2' WHEN 8 THEN CASE WHEN line_id % 2 = 0 THEN '-  ' ELSE '(all)' END ELSE text END AS text FROM noisy_lines"""
_MARKS = "[-,.·ㄴL]"
_PARTS = rf"""x AS ({_NUMBERED}), y AS (SELECT *, CASE WHEN regexp_matches(text, '^{_MARKS}') THEN regexp_extract(text, '^.\s*') ELSE '' END AS prefix FROM x),
z AS (SELECT *, substr(text, length(prefix) + 1) AS rest, CASE WHEN section = 'SMALL' THEN regexp_extract(text, '\(\d+/\d+ 레벨\)$') ELSE '' END AS level FROM y),
w AS (SELECT *, substr(rest, 1, length(rest) - length(level)) AS bare FROM z),
parts AS (SELECT *, nullif(regexp_extract(bare, '\([^)]*\)'), '') AS paren, trim(regexp_replace(bare, '\s*\([^)]*\)', '', 'g')) AS core FROM w),
normal AS (SELECT *, regexp_replace(core, '\d+(\.\d+)?', 'N', 'g') AS norm, regexp_extract(core, '\d+(\.\d+)?') AS num FROM parts),
d AS ({_SECTIONS}), e AS (SELECT DISTINCT section, regexp_replace(entry, '\d+', 'N', 'g') AS b FROM d),
asked AS (SELECT DISTINCT n.section, norm, b FROM normal n JOIN e ON n.section IS NULL OR e.section = n.section WHERE norm <> ''),
pairs AS (SELECT DISTINCT norm AS a, b FROM asked)"""
_CORRECTED = f"""corrected AS (SELECT n.*, best.b, best.score AS raw, n.section IN (SELECT section FROM e) AS known FROM normal n LEFT JOIN
 (SELECT q.section, q.norm, arg_min(q.b, (-score, q.b)) AS b, max(score) AS score FROM asked q JOIN ratios r ON r.a = q.norm AND r.b = q.b WHERE score > 0 GROUP BY 1, 2) best ON best.section IS NOT DISTINCT FROM n.section AND best.norm = n.norm),
result AS (SELECT line_id, section, text, CASE WHEN b IS NULL THEN text ELSE prefix || CASE WHEN num <> '' THEN regexp_replace(b, 'N', num) ELSE b END || level END AS corrected,
 CASE WHEN NOT known THEN -2 WHEN raw IS NULL THEN 0 WHEN raw >= 80 THEN raw ELSE -raw END AS score, CASE WHEN coalesce(known, TRUE) AND core <> '' THEN paren END AS paren_range FROM corrected)"""


def _numbered(t):
    return t.sql(_NUMBERED)


@query(f"WITH RECURSIVE {_PARTS}, {_LCS}, {_CORRECTED} SELECT line_id, corrected, score, paren_range FROM result")
def fz_dict_normalized(t):
    return Z.correct_normalized(_numbered(t), t.sql(_SECTIONS), leveled=("SMALL",)).select("line_id", "corrected", "score", "paren_range")


@query(f"""WITH RECURSIVE {_PARTS}, {_LCS}, {_CORRECTED} SELECT line_id, CASE WHEN fix AND score > 0 THEN corrected ELSE text END AS text, fix AND score > 0 AS fm_applied, CASE WHEN fix AND score > 0 THEN paren_range END AS detail_range,
 CASE WHEN fix AND score < 0 AND score <> -2 THEN corrected END AS rejected, CASE WHEN fix THEN score ELSE 0 END AS score FROM (SELECT *, line_id % 4 <> 3 AND section IS NOT NULL AS fix FROM result)""")
def fz_apply_lines(t):
    done = Z.apply_corrections(_numbered(t), t.sql(_SECTIONS), (F.col("line_id") % 4 != 3) & F.col("section").isNotNull(), leveled=("SMALL",))
    return done.select("line_id", "text", "fm_applied", "detail_range", "rejected", "score")


@query()
def fz_header_partial(t):
    patterns = t.sql("SELECT DISTINCT p_type AS section, lower(p_type) AS pattern FROM part")
    headers = t.noisy_lines.select("line_id", F.expr("case line_id % 3 when 0 then substr(lower(section), 2) when 1 then 'x ' || lower(section) || ' y' else text end").alias("text"))
    return Z.match_headers(headers, patterns).select("line_id", "text", "section")


_SLOTTED = "SELECT DISTINCT p_name AS name, p_size % 2 AS slot FROM part"


@query(f"""WITH RECURSIVE e AS ({_SLOTTED}), q AS (SELECT line_id, text AS name, CAST(line_id % 2 AS INT) AS slot FROM noisy_lines), missed AS (SELECT DISTINCT q.name, q.slot FROM q LEFT JOIN e ON e.name = q.name AND e.slot = q.slot WHERE e.name IS NULL),
pairs AS (SELECT DISTINCT m.name AS a, e.name AS b FROM missed m JOIN e ON e.slot = m.slot WHERE 200 * least(length(m.name), length(e.name)) >= 85 * (length(m.name) + length(e.name))), {_LCS},
near AS (SELECT m.name, m.slot, arg_min(b, (-score, b)) AS b, max(score) AS score FROM missed m JOIN e ON e.slot = m.slot JOIN ratios ON a = m.name AND b = e.name WHERE score >= 85 GROUP BY 1, 2)
SELECT line_id, coalesce(e.name, near.b) AS entry, CASE WHEN e.name IS NOT NULL THEN 100 ELSE score END AS score FROM q LEFT JOIN e ON e.name = q.name AND e.slot = q.slot LEFT JOIN near ON near.name = q.name AND near.slot = q.slot""")
def fz_lookup_name(t):
    queries = t.noisy_lines.select("line_id", F.col("text").alias("name"), (F.col("line_id") % 2).cast("int").alias("slot"))
    return Z.lookup_names(queries, t.sql(_SLOTTED)).select("line_id", "entry", "score")


@query(f"""WITH RECURSIVE pairs AS (SELECT DISTINCT text AS a, name AS b FROM noisy_lines n JOIN (SELECT DISTINCT p_type AS section, p_name AS name FROM part) d ON d.section = n.section
 WHERE {_BAND.replace('length(a)', 'length(text)').replace('length(b)', 'length(name)')}), {_LCS},
d AS (SELECT DISTINCT p_type AS section, p_name AS name FROM part), best AS (SELECT n.section, a, arg_min(b, (-score, b)) AS b, max(score) AS score FROM (SELECT DISTINCT section, text FROM noisy_lines) n JOIN ratios ON a = text JOIN d ON d.section = n.section AND d.name = b WHERE score >= 80 GROUP BY 1, 2)
SELECT line_id, b AS entry, score FROM noisy_lines n JOIN best ON best.section = n.section AND a = text""")
def fz_header_match(t):
    entries = t.sql("SELECT DISTINCT p_type AS section, p_name AS entry FROM part")
    best = Z.best_match(t.noisy_lines, entries, "text", "entry", 80, ["section"])
    return t.noisy_lines.select("line_id", "section", "text").join(best, ["section", "text"]).select("line_id", "entry", "score")


# A session is a run of 40 line numbers at every size, a slot its even or odd lines; an entry is a brand and type, and its effects are all its names, some with ranges.
_ENTRY = "CAST(substr(p_brand, 7) AS BIGINT) * 10000 + ascii(substr(p_type, 2, 1)) * 10 + length(p_type)"
_ENTRIES = f"SELECT DISTINCT {_ENTRY} AS entry, CAST(substr(p_brand, 7) AS BIGINT) % 2 AS slot, p_brand || ' ' || p_type AS name FROM part"
_EFFECTS = f"""SELECT entry, effect_no, CASE WHEN effect_no % 3 = 0 THEN name || ' 2 ~ ' || (entry % 23 + 2) ELSE name END AS effect, CASE WHEN effect_no % 4 = 0 THEN 'if' END AS condition
 FROM (SELECT {_ENTRY} AS entry, p_name AS name, row_number() OVER (PARTITION BY {_ENTRY} ORDER BY min(p_partkey)) AS effect_no FROM part GROUP BY {_ENTRY}, p_name)"""
_SESSION = "(line_id - line_id % 40) / 40"
_SESSION_LINES = f"SELECT CAST({_SESSION} AS BIGINT) AS session, line_id % 2 AS slot, line_id AS line_no, text, gt FROM noisy_lines"
_SLOTS = f"SELECT DISTINCT session, slot, CASE session % 3 WHEN 0 THEN 'Brand#' || (session % 25 + 1) || ' SMALL' WHEN 1 THEN 'Brond#' || (session % 25 + 1) || ' LARGE' ELSE 'xy' END AS header FROM ({_SESSION_LINES})"
#: Each slot's own entry.
_OWN = f"SELECT *, (session % 25 + 1) * 10000 + CASE slot WHEN 0 THEN 775 ELSE 655 END AS entry FROM ({_SESSION_LINES})"
_MATRIX = f"""own AS ({_OWN}), eff AS ({_EFFECTS}), forms AS (SELECT entry, effect_no, effect AS form FROM eff UNION SELECT entry, effect_no, CASE WHEN condition IS NULL THEN effect ELSE condition || ' ' || effect END FROM eff),
pairs AS (SELECT DISTINCT text AS a, form AS b FROM own JOIN forms ON forms.entry = own.entry), {_LCS},
scores AS (SELECT session, slot, line_no, own.entry, effect_no, max(score) AS score FROM own JOIN forms ON forms.entry = own.entry JOIN ratios ON a = text AND b = form GROUP BY 1, 2, 3, 4, 5)"""
#: The greedy order, a pair of each group in a step.
_GREEDY = """g(session, slot, line_no, entry, effect_no, score, place) AS (SELECT *, row_number() OVER (PARTITION BY session, slot, entry ORDER BY score DESC, line_no DESC, effect_no DESC) FROM scores WHERE score > 0
 UNION ALL SELECT *, row_number() OVER (PARTITION BY session, slot, entry ORDER BY score DESC, line_no DESC, effect_no DESC) FROM (
  SELECT x.session, x.slot, x.line_no, x.entry, x.effect_no, x.score FROM g x JOIN g y ON y.place = 1 AND y.session = x.session AND y.slot = x.slot AND y.entry = x.entry WHERE x.line_no <> y.line_no AND x.effect_no <> y.effect_no)),
assigned AS (SELECT session, slot, line_no, entry, effect_no, score FROM g WHERE place = 1)"""


def _lines(t):
    return t.sql(_SESSION_LINES).drop("gt")


def _candidates(t):
    return t.sql(_OWN).drop("gt")


def _scores(t):
    return Z.effect_scores(_candidates(t), t.sql(_EFFECTS), ["entry"])


@query(f"WITH RECURSIVE {_MATRIX} SELECT session, slot, line_no, entry, effect_no, score FROM scores")
def fz_effect_scores(t):
    return _scores(t).select("session", "slot", "line_no", "entry", "effect_no", "score")


def _assigned(t, effects):
    by, lines = ["session", "slot", "entry"], _candidates(t)
    return Z.assign_greedy(Z.contender_lists(lines, Z.text_score_lists(lines, effects, ["entry"]), by, ["entry"]), by)


@query(f"""WITH RECURSIVE {_MATRIX}, {_GREEDY} SELECT session, slot, line_no, entry, effect_no, score FROM assigned
 UNION ALL SELECT session, slot, line_no, entry, -1, 0 FROM own WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.session = own.session AND a.line_no = own.line_no)""")
def fz_assign_greedy(t):
    return Z.with_unmatched(_assigned(t, t.sql(_EFFECTS)), _candidates(t), ["session", "slot", "entry"]).select("session", "slot", "line_no", "entry", "effect_no", "score")


@query()
def fz_effect_correct(t):
    effects = stored(t.sql(_EFFECTS), "effects")
    pairs = _assigned(t, effects).join(_lines(t), ["session", "slot", "line_no"]).join(effects, ["entry", "effect_no"])
    return pairs.select("session", "slot", "entry", "line_no", Z.effect_text(F.col("text"), F.col("effect"), F.col("effect").contains("~")).alias("corrected"))


def _evidence(t):
    return Z.resolve_by_evidence(t.sql(_SLOTS), _lines(t), t.sql(_ENTRIES), t.sql(_EFFECTS))


@query()
def er_evidence(t):
    return _evidence(t)


@query()
def er_by_effects(t):
    return Z.resolve_by_effects(_lines(t), t.sql(_ENTRIES), t.sql(_EFFECTS))


def _resolved(t):
    entries = t.sql(_ENTRIES)
    by_evidence = _evidence(t).join(entries.select("entry", "name"), "entry").select("session", "slot", "name")
    raw = t.sql(_SLOTS).select("session", "slot", F.col("header").alias("name"))
    item = t.sql(f"SELECT session, slot, min(CASE WHEN session % 7 = 0 THEN 'Brand#' || (session % 5 + 1) || ' LARGE' ELSE gt END) AS name FROM ({_SESSION_LINES}) GROUP BY 1, 2")
    return Z.resolve_by_priority([("item_name", item), ("header", raw), ("evidence", by_evidence)], t.sql(_SLOTS).select("session", "slot"), entries)


@query()
def er_priority(t):
    return _resolved(t).select("session", "slot", "name", "source", F.size("candidates").alias("n_candidates"))


@query()
def er_template_effects(t):
    resolved = _evidence(t).filter("entry is not null")
    return Z.fill_template(_lines(t), resolved, t.sql(_EFFECTS)).select("session", "slot", "entry", "effect_no", "line_no", "text")


@query()
def er_item_name(t):
    words = lambda sql: t.sql(f"SELECT DISTINCT {sql} AS name FROM part")
    texts = t.noisy_lines.select(F.col("line_id").alias("id"), F.expr("case when line_id % 5 = 0 then 'blossed ' else '' end || lower(section) || ' ' || gt").alias("text"))
    return Z.resolve_item_names(texts, words("'blessed'"), words("'spirit'"), words("p_name"), words("lower(p_type)"), words("p_brand"))


# --- extraction from lines --------------------------------------------------------------


@query("""SELECT listing_id AS session, name, level, max_level, arg_max(effect, pos) AS effect FROM (SELECT listing_id, pos, option_name AS name, CASE WHEN pos % 4 <> 0 THEN CAST(rolled_value AS INT) END AS level, CASE WHEN pos % 4 <> 0 THEN 50 END AS max_level,
 CASE WHEN pos % 2 = 0 THEN 'does ' || pos END AS effect FROM (SELECT *, id - listing_id * 1000 AS pos FROM listing_options)) GROUP BY listing_id, pos, name, level, max_level""")
def ext_reforge(t):
    rows = t.listing_options.withColumn("no", F.col("id") - F.col("listing_id") * 1000)
    main = rows.select(F.col("listing_id").alias("session"), (F.col("no") * 3).alias("pos"), F.expr("'- ' || option_name || if(no % 4 <> 0, ' (' || cast(rolled_value as int) || '/50 레벨)', '')").alias("text"), F.lit(False).alias("is_sub"))
    sub = rows.filter("no % 2 = 0").select(F.col("listing_id").alias("session"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "no")
    sub = sub.select("session", (F.col("no") * 3 + F.col("k")).alias("pos"), F.expr("'ㄴ ' || if(k = 1, 'old', 'does ' || no)").alias("text"), F.lit(True).alias("is_sub"))
    return E.reforges(main.unionByName(sub), "session", "pos").select("session", "name", "level", "max_level", "effect")


@query("""WITH h AS (SELECT *, CAST(sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS slot_no FROM layout_lines)
SELECT session_id AS session, slot_no, max(CASE WHEN kind = 'header' THEN '접두' END) AS slot, max(CASE WHEN kind = 'header' THEN text END) AS name, max(CASE WHEN kind = 'header' THEN 'A' END) AS rank, string_agg(CASE WHEN kind <> 'header' THEN text END, '|' ORDER BY pos) AS effects
 FROM h WHERE slot_no > 0 GROUP BY 1, 2""")
def ext_enchant_slots(t):
    rows = t.layout_lines.select(F.col("session_id").alias("session"), "pos", F.expr("if(kind = 'header', '[접두] ' || text || ' (랭크 A)', text)").alias("text"))
    return E.enchant_slots(rows, "session", "pos").select("session", "slot_no", "slot", "name", "rank", F.expr("nullif(array_join(effects, '|'), '')").alias("effects"))


# Forms of the lines: colons or blanks, a missing channel, no part, a letter that is no part.
@query("""SELECT p_partkey AS id, part, CASE WHEN part IS NOT NULL THEN p_size END AS r, CASE WHEN part IS NOT NULL THEN p_size * 2 END AS g, CASE WHEN part IS NOT NULL AND p_size % 3 <> 0 THEN p_size * 3 END AS b
 FROM (SELECT *, CASE WHEN p_partkey % 7 > 1 THEN substr('ABCDEF', CAST(p_size % 6 + 1 AS INT), 1) END AS part FROM part)""")
def ext_color_parts(t):
    text = """case p_partkey % 7 when 0 then '색' when 1 then '파트 H' else '- 파트' || if(p_partkey % 2 = 0, ' ', '') || substr('ABCDEF', p_size % 6 + 1, 1) end
     || if(p_partkey % 5 < 2, ' R:' || p_size || ' G:' || p_size * 2, ' R ' || p_size || ' G : ' || p_size * 2) || if(p_size % 3 <> 0, ' B ' || p_size * 3, '')"""
    lines = t.part.select(F.col("p_partkey").alias("id"), F.expr(text).alias("text"))
    return lines.select("id", E.color_part(F.col("text")).alias("c")).select("id", "c.*")


# Round, square and no brackets; lines with a letter and two numbers, but without the word for grade, are none.
@query("SELECT listing_id AS session, arg_min(CASE WHEN l_partkey % 70 BETWEEN 1 AND 50 THEN l_partkey % 70 END, pos) AS level, arg_min(CASE WHEN l_suppkey % 60 BETWEEN 1 AND 50 THEN l_suppkey % 60 END, pos) AS max_level, arg_min(CASE WHEN l_suppkey % 2 = 0 THEN 'S' ELSE 'A' END, pos) AS grade FROM option_rows WHERE pos % 2 = 0 GROUP BY 1".replace("arg_min(", "arg_min_null("))
def ext_erg(t):
    form = "if(l_suppkey % 2 = 0, 'S', 'A') || case l_partkey % 4 when 0 then ' ' when 1 then '[' when 2 then ' (' else ' [ ' end || l_partkey % 70 || if(l_partkey % 3 = 0, ' / ', '/') || l_suppkey % 60 || ' 레벨' || case l_partkey % 4 when 0 then '' when 2 then ')' else ']' end"
    lines = t.option_rows.select(F.col("listing_id").alias("session"), "pos", F.expr(f"if(pos % 2 = 0, '에르그 등급 ', if(pos % 4 = 1, 'x ', '등급')) || {form}").alias("text"))
    return E.erg(lines, "session", "pos").select("session", F.col("level").cast("long").alias("level"), F.col("max_level").cast("long").alias("max_level"), "grade")


# With and without brackets, with a wrong label, and without the word for step.
@query("""SELECT line_id, CASE WHEN ok THEN CASE WHEN line_id % 2 = 0 THEN 'R' ELSE 'S' END END AS type, CASE WHEN ok AND line_id % 10 BETWEEN 1 AND 8 THEN line_id % 10 END AS level FROM (SELECT *, line_id % 3 <> 0 AND line_id % 7 <> 0 AS ok FROM noisy_lines)""")
def ext_special_upgrade(t):
    form = "case line_id % 5 when 0 then ' (' || line_id % 10 || '단계)' when 1 then line_id % 10 || '단계' when 2 then '[ ' || line_id % 10 || ' 단계]' else ' ' || line_id % 10 || if(line_id % 7 = 0, '', '단계') end"
    lines = t.noisy_lines.select("line_id", F.expr(f"if(line_id % 3 = 0, gt, '특별 개') || if(line_id % 2 = 0, ' R', ' S') || if(line_id % 7 = 0, line_id % 10 || '', {form})").alias("text"))
    return lines.select("line_id", E.special_upgrade(F.col("text"), "특별 개조").alias("u")).select("line_id", "u.type", "u.level")


@query(f"""WITH RECURSIVE pairs AS (SELECT a, b FROM (SELECT DISTINCT text AS a FROM noisy_lines), (SELECT name AS b FROM dict_names) WHERE 200 * least(length(a), length(b)) >= 90 * (length(a) + length(b))), {_LCS},
best AS (SELECT a, arg_min(b, (-score, b)) AS b FROM ratios WHERE score >= 90 GROUP BY a) SELECT line_id, b AS set_name, CAST(line_id % 9 AS INT) AS level FROM noisy_lines JOIN best ON a = text""")
def ext_set_effects(t):
    lines = t.noisy_lines.select("line_id", F.expr("text || ' +' || line_id % 9").alias("text"))
    return E.set_effects(lines, t.dict_names).select("line_id", "set_name", "level")


# Ranges with a bonus behind, fractions with a remark, percentages with and without the sign, sums and single numbers.
@query("""SELECT id AS session, CAST(damage AS DOUBLE) AS damage, CAST(defense AS DOUBLE) AS defense, CASE WHEN id % 2 = 0 THEN CAST(price % 100 AS DOUBLE) END AS balance, CASE WHEN id % 3 <> 0 THEN CAST(price % 30 AS DOUBLE) END AS durability,
 CAST(price % 7 AS DOUBLE) AS piercing, CASE WHEN id % 4 <> 0 THEN CAST(price % 5 AS DOUBLE) END AS additional_piercing FROM listings WHERE price IS NOT NULL""")
def ext_item_attrs(t):
    forms = (
        "'damoge 1' || if(id % 2 = 0, '~', ' / ') || damage || ' +5'", "'defense ' || defense || ' (+9)'", "'balance ' || price % 100 || if(id % 2 = 0, ' % 3', '')", "'durabilty ' || if(id % 3 = 0, '', '11/') || price % 30 || ' (5)'",
        "'piercing ' || price % 7 || case id % 4 when 0 then '' when 1 then '+ ' || price % 5 else ' +' || price % 5 end", "'damage'", "'damage  '",
    )
    kinds = {"damage": "range", "defense": "first", "balance": "percent", "durability": "fraction", "piercing": "sum"}
    # all lines of a listing at once: its view takes joins and windows; equal rows have equal lines, and without a column of it the join with part goes
    listings = t.listings.select("id", "price", "damage", "defense").distinct()
    lines = listings.select(F.col("id").alias("session"), F.explode(F.array(*map(F.expr, forms))).alias("text")).filter("text is not null")
    return E.item_attributes(lines, "session", kinds)
