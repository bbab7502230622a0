"""Queries over lines, logs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.functions import text as X
from bazaarlake.operators import lines as L
from bazaarlake.operators import logs as G
from bazaarlake.operators import search as S
from bazaarlake.plans.registry import query
from bazaarlake.plans.search import RESOLVED

_S, _P = ["session_id"], "pos"

# --- aggregates -------------------------------------------------------------------------


@query("SELECT l.id, count(DISTINCT o.id) AS n_options FROM listings l LEFT JOIN listing_options o ON o.listing_id = l.id GROUP BY l.id")
def agg_option_count(t):
    return G.option_counts(t.listings.select("id"), t.listing_options)


@query("SELECT t.id, t.name, count(x.target_id) AS n_targets FROM tags t LEFT JOIN tag_targets x ON x.tag_id = t.id GROUP BY t.id, t.name ORDER BY 3 DESC")
def agg_tag_usage(t):
    return G.ordered_tags(G.usage_counts(t.tags, t.tag_targets, "tag_id", "n_targets"), "-usage").select("id", "name", "n_targets")


@query("SELECT c.id, c.name, count(e.id) AS n_effects FROM enchants c LEFT JOIN enchant_effects e ON e.enchant_id = c.id GROUP BY c.id, c.name")
def agg_effect_count(t):
    return G.usage_counts(t.enchants, t.enchant_effects, "enchant_id", "n_effects").select("id", "name", "n_effects")


@query("SELECT action, count(*) AS n FROM activity_logs GROUP BY action")
def agg_action_counts(t):
    return G.action_counts(t.activity_logs)


_NINE = ("users", "game_items", "enchants", "listings", "listing_options", "tags", "tag_targets", "effects", "enchant_effects")


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {n}) AS {n}" for n in _NINE))
def agg_table_counts(t):
    return G.table_counts({n: getattr(t, n) for n in _NINE})


_USAGE = "SELECT event_type AS action, event_id % 7 AS requests, user_id % 20 AS bucket, event_id % 1000 AS stored FROM events"


@query(f"""WITH u AS ({_USAGE}), r AS (SELECT CAST(sum(CASE WHEN action IN ('click', 'signup') THEN requests ELSE 0 END) AS BIGINT) AS class_a, CAST(sum(CASE WHEN action IN ('click', 'signup') THEN 0 ELSE requests END) AS BIGINT) AS class_b FROM u),
s AS (SELECT CAST(sum(m) AS BIGINT) AS stored FROM (SELECT max(stored) AS m FROM u GROUP BY bucket))
SELECT class_a, class_b, stored, round_even(100 * class_a / 1000000.0::DOUBLE, 1) AS class_a_percent, round_even(100 * stored / 3000000.0::DOUBLE, 1) AS stored_percent FROM r, s""")
def agg_usage_quota(t):
    return G.usage_quota(t.sql(_USAGE), ["click", "signup"], {"class_a": 1e6, "stored": 3e6})


_COSTS = "SELECT n_name AS service, CASE WHEN n_regionkey = 1 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE CAST(c_custkey % 64 AS DOUBLE) / 32 END AS amount FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query(f"""WITH c AS (SELECT service, currency, sum(amount) AS amount FROM ({_COSTS}) GROUP BY service, currency HAVING sum(amount) <> 0)
SELECT service, currency, round_even(amount, 4) AS amount, round_even((SELECT sum(round_even(amount, 4)) FROM c), 4) AS total, (SELECT currency FROM c ORDER BY amount DESC, service DESC LIMIT 1) AS top_currency FROM c""")
def agg_cost_by_service(t):
    return G.cost_by_service(t.sql(_COSTS))


@query("""SELECT listing_id AS session_id, string_agg(option_name, chr(10) ORDER BY id) AS description FROM listing_options GROUP BY listing_id""")
def agg_description(t):
    ordered = F.sort_array(F.collect_list(F.when(F.col("option_name") != "", F.struct("id", "option_name"))))
    return t.listing_options.groupBy(F.col("listing_id").alias("session_id")).agg(F.array_join(ordered["option_name"], "\n").alias("description"))


_CLUSTERED = """g AS (SELECT *, CASE WHEN price - lag(price) OVER (PARTITION BY status ORDER BY price) > 40 THEN 1 ELSE 0 END AS new FROM listings),
c AS (SELECT status, id, price, CAST(sum(new) OVER (PARTITION BY status ORDER BY price RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)"""


@query(f"""WITH {_CLUSTERED} SELECT status, cluster, count(*) AS size, avg(price) AS mean, CAST(median(price) AS DOUBLE) AS median, stddev_pop(price) AS std,
 count(*) / sum(count(*)) OVER (PARTITION BY status) AS share FROM c GROUP BY status, cluster""")
def agg_gap_clusters(t):
    rows = L.gap_clusters(t.listings.select("status", "id", "price"), ["status"], "price", 40)
    return L.cluster_stats(rows, ["status"], "price").select("status", "cluster", "size", "mean", "median", "std", "share")


@query(f"""WITH {_CLUSTERED}, e AS (SELECT *, min(price) OVER w AS low, max(price) OVER w AS high FROM c WINDOW w AS (PARTITION BY status, cluster)),
r AS (SELECT *, CASE WHEN price = low THEN 'low' ELSE 'high' END AS side FROM e WHERE price = low OR price = high)
SELECT status, cluster, id, price, side FROM (SELECT *, row_number() OVER (PARTITION BY status, cluster, side ORDER BY id) AS no FROM r) WHERE no <= 10""")
def agg_extremes(t):
    rows = L.gap_clusters(t.listings.select("status", "id", "price"), ["status"], "price", 40)
    return L.extremes(rows, ["status"], "price", "id").select("status", "cluster", "id", "price", F.col("end").alias("side"))


# --- windows ----------------------------------------------------------------------------


@query(f"WITH {RESOLVED} SELECT listing_id, tag FROM resolved QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY weight DESC, tag) = 1")
def win_dedup_best(t):
    resolved = S.resolve_tags(S.listing_entities(t.listings, t.listing_options), t.tag_targets, t.tags)
    return resolved.groupBy("listing_id").agg(F.min_by("tag", F.struct((-F.col("weight")).alias("w"), "tag")).alias("tag"))


_RUNS = "SELECT user_id AS job, event_id AS run_id, ts AS started_at, event_type AS status FROM events"


@query(f"""WITH r AS ({_RUNS}) SELECT u.id AS job, run_id, status FROM users u LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run_id DESC) = 1) x ON x.job = u.id""")
def win_latest_run(t):
    return G.latest_runs(t.users.select(F.col("id").alias("job")), t.sql(_RUNS)).select("job", "run_id", "status")


@query("SELECT id, action, count(*) OVER () AS total FROM activity_logs WHERE action = 'click' ORDER BY id DESC LIMIT 25 OFFSET 10")
def win_page_total(t):
    return G.log_page(t.activity_logs, F.col("action") == "click", 25, 10).select("id", "action", "total")


@query("SELECT session_id, pos, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS line_index FROM layout_lines")
def win_line_index(t):
    return L.line_index(t.layout_lines, _S, _P).select("session_id", "pos", "line_index")


_PARTS = "SELECT session_id, pos // 2 AS y, pos * 10 AS x, y % 9 + 1 AS width, height, text FROM layout_lines"
_PARTS_SPARK = _PARTS.replace("pos // 2", "pos div 2")


@query(f"""WITH p AS ({_PARTS}) SELECT session_id, y, min(x) AS x, arg_max(x + width, x) - min(x) AS width, arg_min(height, x) AS height, string_agg(text, ' ' ORDER BY x) AS text FROM p GROUP BY session_id, y""")
def win_group_by_y(t):
    return L.group_by_y(t.sql(_PARTS_SPARK), _S)


@query(f"""WITH p AS ({_PARTS}) SELECT session_id, min(x) AS x, arg_min(y, x) AS y, arg_min(height, x) AS height, arg_max(x + width, x) - min(x) AS width FROM p GROUP BY session_id""")
def win_merge_bounds(t):
    return L.merge_bounds(t.sql(_PARTS_SPARK).withColumn("place", F.col("x")), _S, "place")


_GAPS = """g AS (SELECT *, y - lag(y + height) OVER (PARTITION BY session_id ORDER BY pos) AS gap FROM {src}),
m AS (SELECT session_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY session_id),
h AS (SELECT g.*, greatest(2 * gaps[len(gaps) // 2 + 1], gaps[len(gaps) // 2 + 1] + 4) AS threshold FROM g JOIN m USING (session_id))"""


@query(f"WITH {_GAPS.format(src='layout_lines')} SELECT session_id, pos, CAST(sum(CASE WHEN gap >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS group_no FROM h")
def win_distance_groups(t):
    return L.distance_groups(t.layout_lines, _S, _P).select("session_id", "pos", "group_no")


@query(f"WITH {_GAPS.format(src='layout_lines')} SELECT session_id, max(pos) FILTER (gap >= threshold) AS outlier FROM h GROUP BY session_id")
def win_gap_outlier(t):
    return L.gap_outlier(t.layout_lines, _S, _P)


@query(f"""WITH lh AS (SELECT session_id, coalesce(max(pos) FILTER (kind = 'header'), -1) AS last_header FROM layout_lines GROUP BY 1), tail AS (SELECT l.* FROM layout_lines l JOIN lh USING (session_id) WHERE pos > last_header),
{_GAPS.format(src='tail')}, o AS (SELECT session_id, max(pos) FILTER (gap >= threshold) AS outlier FROM h GROUP BY 1)
SELECT l.session_id, l.pos FROM layout_lines l LEFT JOIN o USING (session_id) WHERE outlier IS NULL OR l.pos < outlier""")
def win_trim_tail(t):
    return L.trim_tail(t.layout_lines, _S, _P, F.col("kind") == "header").select("session_id", "pos")


_MERGED = """i AS (SELECT *, sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS island FROM layout_lines),
a AS (SELECT *, CASE WHEN kind IN ('bullet', 'plain') THEN coalesce(last_value(CASE WHEN kind = 'bullet' THEN pos END IGNORE NULLS) OVER (PARTITION BY session_id, island ORDER BY pos ROWS UNBOUNDED PRECEDING), pos) ELSE pos END AS anchor FROM i),
merged AS (SELECT session_id, anchor AS pos, arg_min(kind, pos) AS kind, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n_lines FROM a GROUP BY session_id, anchor)"""


@query(f"WITH {_MERGED} SELECT session_id, pos, kind, text, n_lines FROM merged")
def win_merge_continuation(t):
    return L.merge_continuations(t.layout_lines, _S, _P)


_CONFIDENT = "SELECT session_id, pos, CAST(pos % 5 AS DOUBLE) / 8 AS confidence, pos * 20 + CASE WHEN pos % 3 = 0 THEN 6 ELSE 0 END AS y, CASE WHEN pos % 3 = 1 THEN 20 ELSE 14 END AS height, text FROM layout_lines"


@query(f"""WITH RECURSIVE c AS ({_CONFIDENT}), s AS (SELECT *, CASE WHEN y - lag(y + height) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS group_no FROM s), l AS (SELECT session_id, group_no, string_agg(text, ' ' ORDER BY pos) AS text, list(confidence ORDER BY pos) AS cs FROM g GROUP BY 1, 2)
SELECT session_id, group_no, text, list_reduce(cs, lambda a, x: (a + x) / 2) AS confidence FROM l""")
def win_merge_nextline(t):
    return L.merge_next_lines(t.sql(_CONFIDENT), _S, _P)


@query("SELECT * FROM (SELECT session_id, pos, CAST(sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS slot FROM layout_lines) WHERE slot > 0")
def win_slot_groups(t):
    return L.slot_groups(t.layout_lines, _S, _P, F.col("kind") == "header").select("session_id", "pos", "slot")


@query(f"""WITH {_MERGED}, s AS (SELECT *, CAST(sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS slot FROM merged)
SELECT session_id, slot, count(*) FILTER (kind NOT IN ('header', 'grey')) AS n_effects FROM s WHERE slot > 0 GROUP BY 1, 2""")
def win_effects_per_header(t):
    return L.effects_per_header(t.layout_lines, _S, _P)


@query("""WITH n AS (SELECT *, count(*) FILTER (kind = 'header') OVER (PARTITION BY session_id) AS n, max(CASE WHEN kind = 'grey' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS grey FROM layout_lines),
h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS no FROM n WHERE kind = 'header')
SELECT session_id, pos, CASE WHEN n = 2 THEN CASE WHEN no = 1 THEN 'prefix' ELSE 'suffix' END WHEN n = 1 THEN CASE WHEN grey = 1 THEN 'suffix' ELSE 'prefix' END END AS label FROM h""")
def win_slot_labels(t):
    return L.slot_labels(t.layout_lines, _S, _P)


_READ = "SELECT file_id, line_id // 100 AS place, reader, text, confidence FROM noisy_lines"
_READ_SPARK = _READ.replace("line_id // 100", "line_id div 100")
_PICKED = f"r AS ({_READ}), p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file_id, place ORDER BY confidence DESC, reader, text) = 1)"


@query(f"WITH {_PICKED} SELECT file_id, place, reader, confidence FROM p")
def win_pick_confident(t):
    return L.pick_confident(t.sql(_READ_SPARK), ["file_id", "place"]).select("file_id", "place", "reader", "confidence")


@query(f"WITH {_PICKED}, w AS (SELECT file_id, reader, count(*) AS n FROM p GROUP BY 1, 2) SELECT file_id, reader FROM w QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, reader) = 1")
def win_majority_reader(t):
    return L.majority_reader(t.sql(_READ_SPARK), "file_id", ["place"])


@query("SELECT file_id, section, line_id, row_number() OVER (PARTITION BY file_id, section ORDER BY line_id % 3, line_id) - 1 AS line_index FROM noisy_lines")
def win_section_merge(t):
    return L.merge_sections(t.noisy_lines.withColumn("segment", F.col("line_id") % 3), "file_id", "section", "segment", "line_id").select("file_id", "section", "line_id", "line_index")


@query("SELECT l.session_id, l.pos, l.text, h.header_text FROM layout_lines l LEFT JOIN (SELECT session_id, arg_min(text, pos) AS header_text FROM layout_lines WHERE kind = 'header' GROUP BY 1) h USING (session_id) WHERE kind <> 'header'")
def prj_promote_header(t):
    return L.promote_header(t.layout_lines, _S, _P, F.col("kind") == "header").select("session_id", "pos", "text", "header_text")


@query("SELECT session_id, count(*) FILTER (kind = 'bullet') <= 1 AS abbreviated FROM layout_lines GROUP BY 1")
def prj_abbreviated_flag(t):
    return L.abbreviated(t.layout_lines, _S, F.col("kind") == "bullet")


# --- top-k, texts, extraction -----------------------------------------------------------


@query("SELECT id, name FROM listings ORDER BY id DESC LIMIT 200 OFFSET 30")
def topk_newest(t):
    return G.newest(t.listings, 999, 30).select("id", "name")


@query(r"SELECT event_id, regexp_replace(regexp_replace(props || ' n x', '[0-9]+(?:\.[0-9]+)?', 'N', 'g'), '(^|\W)n(\W|$)', '\1N\2', 'g') AS normal FROM events")
def str_num_normalize(t):
    return t.events.select("event_id", X.normalize_numbers(F.concat("props", F.lit(" n x"))).alias("normal"))


@query(r"SELECT event_id, array_to_string(regexp_extract_all(props || ' ' || event_id || '.5', '[0-9]+(?:\.[0-9]+)?'), '|') AS numbers FROM events")
def str_num_extract(t):
    return t.events.select("event_id", F.array_join(X.numbers(F.expr("props || ' ' || event_id || '.5'")), "|").alias("numbers"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'from ' || event_id || ' to ' || user_id || ' of' WHEN 1 THEN 'dmg ' || event_id || ' ~ ' || user_id || ' up' WHEN 2 THEN 'dmg ' || event_id || ' up' ELSE 'gain  up' END AS filled FROM events")
def str_template_inject(t):
    template = F.expr("case event_id % 4 when 0 then 'from N to N of N' when 3 then 'gain N ~ N up' else 'dmg N ~ N up' end")
    values = F.expr("slice(array(cast(event_id as string), cast(user_id as string)), 1, case event_id % 4 when 2 then 1 when 3 then 0 else 2 end)")
    return t.events.select("event_id", X.inject_numbers(template, values).alias("filled"))


@query("SELECT line_id, CASE line_id % 8 WHEN 6 THEN '* ' || gt WHEN 7 THEN gt ELSE CASE WHEN line_id % 16 = 2 THEN '-' ELSE '' END || gt END AS stripped FROM noisy_lines")
def str_prefix_strip(t):
    bullets = "case line_id % 8 when 0 then '- ' when 1 then ' ㄴ ' when 2 then ',' when 3 then '· ' when 4 then 'L ' when 5 then '.' when 6 then '* ' else '' end"
    text = F.expr(f"{bullets} || if(line_id % 16 = 2, '-', '') || gt")
    return t.noisy_lines.select("line_id", X.strip_prefix(text).alias("stripped"))


@query("""WITH s AS (SELECT c_custkey AS id, chr(CAST(44032 + c_custkey % 11172 AS INT)) AS syllable, c_custkey % 11172 AS i FROM customer)
SELECT id, 'x' || substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', i // 588 + 1, 1) || substr('ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ', i % 588 // 28 + 1, 1)
 || CASE WHEN i % 28 > 0 THEN substr('ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ', i % 28, 1) ELSE '' END AS letters FROM s""")
def str_jamo(t):
    syllable = F.decode(F.unhex(F.concat(F.hex(0xE0 + F.floor((44032 + F.col("i")) / 4096)), F.hex(0x80 + F.floor((44032 + F.col("i")) / 64) % 64), F.hex(0x80 + (44032 + F.col("i")) % 64))), "utf-8")
    rows = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 11172).alias("i"))
    return rows.select("id", X.jamo(F.concat(F.lit("x"), syllable)).alias("letters"))


_EFFECT = "SELECT line_id, gt || CASE WHEN line_id % 3 = 0 THEN '' ELSE ' ' || line_id || CASE WHEN line_id % 2 = 0 THEN '.5%' ELSE '' END || ' up' END AS text FROM noisy_lines"


@query(f"WITH e AS ({_EFFECT}) SELECT e.line_id, CASE WHEN e.line_id % 3 <> 0 THEN gt END AS name, CASE WHEN e.line_id % 3 <> 0 THEN e.line_id + CASE WHEN e.line_id % 2 = 0 THEN 0.5 ELSE 0 END END::DOUBLE AS value FROM e JOIN noisy_lines n ON n.line_id = e.line_id")
def str_effect_number(t):
    name, value = X.effect_number(F.col("text"))
    return t.sql(_EFFECT).select("line_id", name.alias("name"), value.alias("value"))


@query("""SELECT line_id, gt AS option_name, line_id % 2 = 0 AS ranged, line_id::DOUBLE AS low, (CASE WHEN line_id % 2 = 0 THEN line_id + 7 ELSE line_id END)::DOUBLE AS high, 'up' AS suffix FROM noisy_lines""")
def str_range_suffix(t):
    rows = t.sql("SELECT line_id, gt || ' ' || line_id || CASE WHEN line_id % 2 = 0 THEN ' ~ ' || (line_id + 7) ELSE '' END || ' up' AS text FROM noisy_lines")
    return rows.select("line_id", X.range_suffix(F.col("text")).alias("r")).select("line_id", "r.option_name", "r.ranged", F.col("r.min").alias("low"), F.col("r.max").alias("high"), "r.suffix")


@query("SELECT id, CAST(json_extract(metadata, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM activity_logs")
def json_log_fields(t):
    return t.activity_logs.select("id", *X.json_fields("metadata", {"k": "bigint", "missing": "string"}))
