"""Queries over listings: filters, joins, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.functions import text as X
from bazaarlake.operators import hierarchy as H
from bazaarlake.operators import search as S
from bazaarlake.plans.registry import query

_PAIRS = "array_join(transform(tags, t -> t.name || ':' || t.weight), ',')"
#: Tags of a listing, as resolve_tags() finds them.
RESOLVED = """entities AS (
  SELECT id AS listing_id, 'listings' AS target_type, id AS target_id FROM listings
  UNION ALL SELECT id, 'game_items', game_item_id FROM listings UNION ALL SELECT id, 'enchants', prefix_enchant_id FROM listings
  UNION ALL SELECT id, 'enchants', suffix_enchant_id FROM listings UNION ALL SELECT listing_id, option_type, option_id FROM listing_options),
resolved AS (SELECT e.listing_id, t.name AS tag, max(t.weight + tt.weight) AS weight
  FROM entities e JOIN tag_targets tt ON tt.target_type = e.target_type AND tt.target_id = e.target_id JOIN tags t ON t.id = tt.tag_id
  GROUP BY e.listing_id, t.name)"""


def _resolved(t):
    return S.resolve_tags(S.listing_entities(t.listings, t.listing_options), t.tag_targets, t.tags)


# --- filters ----------------------------------------------------------------------------


@query("SELECT id, price, damage FROM listings WHERE price >= 50000 AND damage <= 30 AND defense = 7")
def flt_attr_range(t):
    return S.attr_range(t.listings, {"min_price": "50000", "max_damage": 30, "eq_defense": "7", "min_unknown": 3, "max_balance": "x"}).select("id", "price", "damage")


@query("SELECT id, name FROM game_items WHERE type = 'ECONOMY'")
def flt_string_eq(t):
    return S.string_eq(t.game_items, {"type": "ECONOMY", "name": "", "other": "x"}, ("type",)).select("id", "name")


@query("SELECT id FROM listings WHERE id IN (SELECT listing_id FROM listing_options WHERE option_type = 'reforge_options' AND option_id = 7)")
def flt_option_exists(t):
    return S.with_options(t.listings, t.listing_options, [("reforge_options", 7, None, None)]).select("id")


@query("""SELECT id FROM listings WHERE id IN (SELECT listing_id FROM listing_options WHERE option_type = 'reforge_options' AND rolled_value >= 20 AND option_id = 11)
 OR id IN (SELECT listing_id FROM listing_options WHERE option_type = 'echostone_options' AND option_id = 12 AND rolled_value <= 40)""")
def flt_option_threshold(t):
    one = S.with_options(t.listings, t.listing_options, [("reforge_options", 11, "gte", 20.0)])
    return one.unionByName(S.with_options(t.listings, t.listing_options, [("echostone_options", 12, "lte", 40.0)])).select("id").distinct()


@query("SELECT id FROM listings WHERE prefix_enchant_id = 4 OR suffix_enchant_id = 4")
def flt_enchant_either_slot(t):
    return S.with_enchant(t.listings, 4).select("id")


@query("SELECT id FROM listings WHERE id IN (SELECT listing_id FROM rolls WHERE enchant_id = 6 AND effect_order = 2 AND rolled_value >= 10)")
def flt_effect_threshold(t):
    return S.with_effect(t.listings, t.rolls, 6, 2, ">=", 10.0).select("id")


@query("""WITH f AS (SELECT c_custkey AS search_id, c_custkey AS option_id, c_custkey % 40 AS level FROM customer)
SELECT search_id, listing_id, false AS unfiltered FROM f JOIN listing_options o ON o.option_id = f.option_id AND o.option_type = 'reforge_options' AND
 CASE WHEN search_id % 3 = 1 THEN rolled_value <= level ELSE rolled_value >= level END WHERE search_id % 5 <> 0 GROUP BY search_id, listing_id
UNION ALL SELECT search_id, NULL, true FROM f WHERE search_id % 5 = 0""")
def flt_filter_json(t):
    searches = t.sql("""SELECT c_custkey AS search_id, CASE WHEN c_custkey % 15 = 0 THEN '[{"type":"x"}]' WHEN c_custkey % 5 = 0 THEN 'not json' ELSE '[{"type":"reforge_options","id":' || c_custkey || ',"op":"'
      || CASE c_custkey % 3 WHEN 0 THEN 'gte' WHEN 1 THEN 'lte' ELSE '?' END || '","level":' || c_custkey % 40 || '},{"type":"x"}]' END AS filters FROM customer""")
    return S.run_saved_searches(S.saved_option_filters(searches), t.listing_options)


@query("""WITH f AS (SELECT c_custkey AS search_id, c_custkey AS e, CAST(c_custkey % 3 + 1 AS INT) AS o, c_custkey % 40 AS v FROM customer),
r AS (SELECT DISTINCT search_id, listing_id FROM f JOIN rolls ON enchant_id = e AND effect_order = o AND CASE WHEN search_id % 3 = 1 THEN rolled_value <= v ELSE rolled_value >= v END)
SELECT f.search_id, l.id AS listing_id, false AS unfiltered FROM f JOIN listings l ON l.prefix_enchant_id = e OR l.suffix_enchant_id = e LEFT JOIN r ON r.search_id = f.search_id AND r.listing_id = l.id
 WHERE f.search_id % 5 <> 0 AND (f.search_id % 4 = 1 OR r.listing_id IS NOT NULL) UNION ALL SELECT search_id, NULL, true FROM f WHERE search_id % 5 = 0""")
def flt_enchant_filter_json(t):
    effect = """'{"enchant_id":' || c_custkey || ',"effect_order":' || (c_custkey % 3 + 1) || ',"op":"' || CASE c_custkey % 3 WHEN 0 THEN 'gte' WHEN 1 THEN 'lte' ELSE '?' END || '","value":' || c_custkey % 40 || '},'"""
    searches = t.sql(f"""SELECT c_custkey AS search_id, CASE WHEN c_custkey % 15 = 0 THEN '[{{"effects":[]}}]' WHEN c_custkey % 5 = 0 THEN 'not json' ELSE
      '[{{"id":' || c_custkey || ',"effects":[' || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE {effect} END || '{{"effect_order":2}}]}},{{"effects":[]}}]' END AS filters FROM customer""")
    return S.run_saved_enchants(S.saved_enchant_filters(searches), t.listings, t.rolls)


@query("SELECT id, name FROM game_items WHERE name ILIKE '%RING%' ORDER BY name, id LIMIT 20")
def flt_ilike_names(t):
    return S.names_like(t.game_items, "RING", 20).select("id", "name")


@query("SELECT name, weight FROM tags WHERE name ILIKE '%brand#1%' AND weight > 0 ORDER BY weight DESC, name LIMIT 5")
def flt_tag_suggest(t):
    return S.suggest_tags(t.tags, "brand#1", 5).select("name", "weight")


@query("SELECT id, name FROM game_items WHERE searchable AND contains(lower(name), 'small') ORDER BY id LIMIT 10")
def flt_searchable_items(t):
    return S.searchable_items(t.game_items, "Small", 10).select("id", "name")


@query("SELECT id, true AS public FROM listings WHERE status = 1 UNION ALL SELECT id, false FROM listings WHERE status <> 3")
def flt_status_visible(t):
    return S.visible(t.listings).select("id", F.lit(True).alias("public")).unionByName(S.visible(t.listings, owner=True).select("id", F.lit(False).alias("public")))


_ENCHANTS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'UNKNOWN' ELSE c_mktsegment END AS restriction FROM customer"


@query(f"""WITH e AS ({_ENCHANTS}) SELECT id, restriction FROM e WHERE restriction IS NULL
 OR restriction IN (SELECT restriction FROM restriction_map WHERE node IN ('NATION_3', 'NATION_4'))""")
def flt_restriction_overlap(t):
    return S.allowed_enchants(t.sql(_ENCHANTS), t.restriction_map, ["NATION_3", "NATION_4"])


_RULES = "SELECT n_name AS node, 'attr_' || (n_nationkey % 6) AS facet FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT r_name, 'region_' || r_regionkey FROM region"
_ONLY = "SELECT n_name AS node, 'only_' || n_nationkey AS facet FROM nation WHERE n_nationkey % 10 = 0"
_ANCESTORS = "anc(item, ancestor) AS (SELECT child, child FROM hierarchy UNION SELECT child, parent FROM hierarchy UNION SELECT h.child, g.parent FROM hierarchy h JOIN hierarchy g ON g.child = h.parent)"


@query(f"""WITH rules AS ({_RULES}), lone AS ({_ONLY}), {_ANCESTORS},
f AS (SELECT item, string_agg(DISTINCT facet, ',' ORDER BY facet) AS facets FROM anc LEFT JOIN rules ON node = ancestor GROUP BY item),
o AS (SELECT item, min(facet) AS lone_facet FROM anc JOIN lone ON node = ancestor GROUP BY item)
SELECT f.item, coalesce(lone_facet, facets, '') AS facets FROM f LEFT JOIN o ON o.item = f.item""")
def flt_facets_for_type(t):
    found = S.facets_for_items(H.ancestors(t.hierarchy), t.sql(_RULES), t.sql(_ONLY))
    return found.select("item", F.array_join("facets", ",").alias("facets"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS damage, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS price FROM orders""")
def prj_safe_int_attrs(t):
    rows = t.sql("""SELECT o_orderkey AS id, map('damage', CASE WHEN o_orderkey % 3 = 0 THEN '1.5' ELSE ' ' || o_orderkey % 50 || ' ' END, 'colour', '7') AS attrs,
      CASE WHEN o_orderkey % 2 = 0 THEN '' || o_orderkey ELSE 'free' END AS price FROM orders""")
    return X.safe_int_attrs(rows, "attrs", ("damage",), "price").select("id", "damage", F.col("price").cast("long").alias("price"))


@query("""SELECT page_id, trim(regexp_replace(html, '<[^>]*>?', '', 'g'), ' ') AS name, nullif(trim(regexp_replace(url, '<[^>]*>?', '', 'g'), ' '), '') AS description FROM pages""")
def prj_strip_html(t):
    return t.pages.select("page_id", F.coalesce(X.strip_html(F.col("html")), F.lit("")).alias("name"), F.nullif(X.strip_html(F.col("url")), F.lit("")).alias("description"))


@query("""SELECT p_partkey AS id, CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'option_type' END AS bad_type, CASE WHEN length(p_brand) > 7 THEN 'tag' END AS bad_tag,
 CASE WHEN length(p_name) > 10 THEN 'description' END AS bad_description FROM part""")
def prj_validate_rows(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("option_type"), F.col("p_brand").alias("tag"), F.col("p_name").alias("description"))
    checked = X.validate(rows, {"option_type": F.col("option_type").isin("ECONOMY", "STANDARD", "PROMO"), "tag": F.length("tag") <= 7, "description": F.length("description") <= 10})
    reason = lambda name: F.when(F.array_contains("reasons", name), name)
    return checked.select("id", reason("option_type").alias("bad_type"), reason("tag").alias("bad_tag"), reason("description").alias("bad_description"))


@query("""SELECT id, CASE WHEN option_id % 7 = 0 OR option_id % 5 = 3 THEN NULL WHEN rolled_value = max_level THEN 'max' WHEN option_name = 'small ring' THEN 'other'
 WHEN (rolled_value - option_id % 3 * 10) / (max_level - option_id % 3 * 10) >= 0.8 THEN 'high' WHEN (rolled_value - option_id % 3 * 10) / (max_level - option_id % 3 * 10) >= 0.3 THEN 'mid' ELSE 'low' END AS quality FROM listing_options""")
def prj_roll_quality(t):
    low = F.when(F.col("option_id") % 7 == 0, F.lit(None)).when(F.col("option_id") % 5 == 3, F.col("max_level")).otherwise(F.col("option_id") % 3 * 10)
    return t.listing_options.select("id", X.roll_quality(F.col("rolled_value"), low, F.col("max_level"), F.col("option_name") == "small ring").alias("quality"))


@query("SELECT listing_id, tag, weight, least(weight // 10, 17) AS tier FROM (WITH " + RESOLVED + " SELECT * FROM resolved)")
def prj_tag_tier(t):
    return _resolved(t).withColumn("tier", X.tag_tier(F.col("weight")))


@query("SELECT id, printf('%.2f', rolled_value * p_size / 4) || '%' AS shown FROM listing_options JOIN part ON p_partkey = option_id")
def prj_option_display(t):
    per_level = t.part.select(F.col("p_partkey").alias("option_id"), (F.col("p_size") / 4).alias("value_per_level"))
    shown = t.listing_options.join(per_level, "option_id")
    return shown.select("id", X.option_display(F.col("rolled_value"), F.col("value_per_level"), F.lit("%")).alias("shown"))


# --- joins and sets ---------------------------------------------------------------------


@query("""SELECT l.id, l.name, i.name AS item_name, p.name AS prefix_name, s.name AS suffix_name, u.game_id AS seller FROM listings l LEFT JOIN game_items i ON i.id = game_item_id
 LEFT JOIN enchants p ON p.id = prefix_enchant_id LEFT JOIN enchants s ON s.id = suffix_enchant_id LEFT JOIN users u ON u.id = user_id""")
def join_listing_summary(t):
    return S.listing_summary(t.listings, t.game_items, t.enchants, t.users).select("id", "name", "item_name", "prefix_name", "suffix_name", "seller")


@query(f"WITH {RESOLVED} SELECT listing_id, tag, weight, row_number() OVER (PARTITION BY listing_id ORDER BY weight DESC, tag) AS place FROM resolved")
def join_tag_resolve(t):
    return S.nest_tags(_resolved(t)).select("listing_id", F.posexplode("tags").alias("pos", "x")).select("listing_id", F.col("x.name").alias("tag"), "x.weight", (F.col("pos") + 1).alias("place"))


@query("SELECT listing_id, string_agg(option_name || '=' || CAST(rolled_value AS INT), ',' ORDER BY id) AS options FROM listing_options GROUP BY listing_id")
def join_options_nest(t):
    return S.nest_options(t.listing_options).select("listing_id", F.expr("array_join(transform(options, o -> o.option_name || '=' || cast(o.rolled_value as int)), ',')").alias("options"))


@query("""SELECT l.id AS listing_id, e.effect_order, f.name AS effect_name, max(r.rolled_value) AS rolled_value FROM listings l JOIN enchant_effects e ON e.enchant_id = l.prefix_enchant_id
 LEFT JOIN effects f ON f.id = e.effect_id LEFT JOIN rolls r ON r.listing_id = l.id AND r.enchant_id = e.enchant_id AND r.effect_order = e.effect_order GROUP BY 1, 2, 3""")
def join_effect_roll_detail(t):
    return S.effect_rolls(t.enchant_effects, t.effects, t.rolls, t.listings).select("listing_id", "effect_order", "effect_name", "rolled_value")


@query(f"""WITH {RESOLVED}, nt AS (SELECT listing_id, string_agg(tag || ':' || weight, ',' ORDER BY weight DESC, tag) AS tags FROM resolved GROUP BY 1),
no AS (SELECT listing_id, count(*) AS n_options FROM listing_options GROUP BY 1), ne AS (SELECT l.id AS listing_id, count(*) AS n_effects FROM listings l JOIN enchant_effects e ON e.enchant_id = l.prefix_enchant_id GROUP BY 1)
SELECT l.id, i.name AS item_name, u.game_id AS seller, tags, n_options, n_effects FROM listings l LEFT JOIN game_items i ON i.id = game_item_id LEFT JOIN users u ON u.id = user_id
 LEFT JOIN nt ON nt.listing_id = l.id LEFT JOIN no ON no.listing_id = l.id LEFT JOIN ne ON ne.listing_id = l.id""")
def join_listing_detail(t):
    summary = S.listing_summary(t.listings, t.game_items, t.enchants, t.users)
    detail = S.listing_detail(summary, S.nest_options(t.listing_options), S.nest_tags(_resolved(t)), S.effect_rolls(t.enchant_effects, t.effects, t.rolls, t.listings))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return detail.select("id", "item_name", "seller", F.expr(_PAIRS).alias("tags"), n("options").alias("n_options"), n("prefix_effects").alias("n_effects"))


@query("""SELECT l.id, 2 AS tier FROM listings l JOIN game_items i ON i.id = l.game_item_id WHERE i.name ILIKE '%ring%'""")
def set_cascade_search(t):
    return _cascade(t, "ring")


@query(f"WITH {RESOLVED} SELECT DISTINCT listing_id AS id, 1 AS tier FROM resolved WHERE tag ILIKE '%brand#1%'")
def set_cascade_tags(t):
    return _cascade(t, "brand#1")


@query("SELECT id, 3 AS tier FROM listings WHERE name ILIKE '%urgent%'")
def set_cascade_names(t):
    return _cascade(t, "urgent")


def _cascade(t, text: str):
    s = _stored(t)
    return S.cascade_search(s.listings, s.listing_options, s.game_items, s.tag_targets, s.tags, text)


def _stored(t):
    """The views that a search reads several times, each computed once."""
    return t.stored("option_rows", "listings", "listing_options")


@query(f"WITH {RESOLVED} SELECT listing_id AS id FROM resolved WHERE tag IN ('Brand#11', 'Brand#12') GROUP BY listing_id HAVING count(DISTINCT tag) = 2")
def set_tag_division(t):
    s = _stored(t)
    return S.tag_division(s.listings, s.listing_options, s.tag_targets, s.tags, ["Brand#11", "Brand#12"]).select("id")


@query(f"""WITH {RESOLVED}, page AS (SELECT l.id, l.name, l.price FROM listings l JOIN game_items i ON i.id = l.game_item_id WHERE l.status = 1 AND l.price >= 1000 AND i.name ILIKE '%small%'
 AND l.id IN (SELECT listing_id FROM listing_options WHERE option_type = 'reforge_options' AND option_id % 1 = 0 AND rolled_value >= 1)
 AND l.id IN (SELECT listing_id FROM resolved WHERE tag = 'Brand#11') ORDER BY l.id DESC LIMIT 40 OFFSET 2)
SELECT id, name, price, (SELECT string_agg(tag || ':' || weight, ',' ORDER BY weight DESC, tag) FROM resolved r WHERE r.listing_id = page.id) AS tags,
 (SELECT count(*) FROM listing_options o WHERE o.listing_id = page.id) AS n_options FROM page""")
def search_listings(t):
    return _search_page(t, 2, ("Brand#11",))


def newest_listings(t):
    """The first page of the search without tags, for the flagship query."""
    return _search_page(t, 0, ())


def _search_page(t, offset: int, tags):
    s = _stored(t)
    rolled = s.listing_options.filter("option_type = 'reforge_options' and rolled_value >= 1").select(F.col("listing_id").alias("id"))
    spec = S.SearchSpec(text="small", tags=tags, ranges={"min_price": 1000}, limit=40, offset=offset)
    found = S.search_listings(spec, s.listings.join(rolled, "id", "left_semi"), s.listing_options, s.game_items, s.tag_targets, s.tags)
    return found.select("id", "name", "price", F.expr(_PAIRS).alias("tags"), F.size("options").alias("n_options"))


@query("""SELECT 'tag' AS kind, row_number() OVER (ORDER BY weight DESC, name) AS rank, name AS label FROM (SELECT * FROM tags WHERE name ILIKE '%r%' AND weight > 0 ORDER BY weight DESC, name LIMIT 5)
 UNION ALL SELECT 'item', row_number() OVER (ORDER BY id), name FROM (SELECT * FROM game_items WHERE searchable AND contains(lower(name), 'r') ORDER BY id LIMIT 3)
 UNION ALL SELECT 'listing', row_number() OVER (ORDER BY id DESC), name FROM (SELECT * FROM listings WHERE status = 1 AND name ILIKE '%r%' ORDER BY id DESC LIMIT 5)""")
def set_suggestions(t):
    return S.suggestions(t.tags, t.game_items, t.listings, "r")


_NAMES = "SELECT 'game_items' AS target_type, id AS target_id, name AS display_name FROM game_items UNION ALL SELECT 'listings', id, name FROM listings UNION ALL SELECT 'enchants', id, name FROM enchants"


def _named(t):
    return S.display_names(t.tag_targets, {"game_items": t.game_items, "listings": t.listings, "enchants": t.enchants})


@query(f"WITH n AS ({_NAMES}) SELECT tag_id, t.target_type, t.target_id, display_name FROM tag_targets t LEFT JOIN n ON n.target_type = t.target_type AND n.target_id = t.target_id")
def join_display_name(t):
    return _named(t).select("tag_id", "target_type", "target_id", "display_name")


@query(f"""WITH n AS ({_NAMES}) SELECT g.id, g.name, string_agg(t.target_type || '/' || t.target_id || '/' || coalesce(display_name, ''), ',' ORDER BY t.target_type, t.target_id) AS targets
 FROM tags g JOIN tag_targets t ON t.tag_id = g.id LEFT JOIN n ON n.target_type = t.target_type AND n.target_id = t.target_id GROUP BY g.id, g.name""")
def join_tag_detail(t):
    nested = _named(t).groupBy("tag_id").agg(F.sort_array(F.collect_list(F.struct("target_type", "target_id", "display_name"))).alias("targets"))
    text = F.expr("array_join(transform(targets, x -> x.target_type || '/' || x.target_id || '/' || coalesce(x.display_name, '')), ',')")
    return t.tags.join(nested.withColumnRenamed("tag_id", "id"), "id").select("id", "name", text.alias("targets"))


@query("SELECT e.id, c.name AS enchant_name, f.name AS effect_name FROM enchant_effects e JOIN enchants c ON c.id = e.enchant_id LEFT JOIN effects f ON f.id = e.effect_id")
def join_enchant_effects(t):
    enchant = t.enchants.select(F.col("id").alias("enchant_id"), F.col("name").alias("enchant_name"))
    effect = t.effects.select(F.col("id").alias("effect_id"), F.col("name").alias("effect_name"))
    return t.enchant_effects.join(enchant, "enchant_id").join(effect, "effect_id", "left").select("id", "enchant_name", "effect_name")


@query("""SELECT u.id, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features, string_agg(DISTINCT CAST(r.role_id AS VARCHAR), ',' ORDER BY CAST(r.role_id AS VARCHAR)) AS roles
 FROM users u JOIN user_roles r ON r.user_id = u.id LEFT JOIN role_features f ON f.role_id = r.role_id GROUP BY u.id""")
def join_user_features(t):
    # features are gathered per role before the users are joined, so rows don't multiply
    per_role = t.role_features.groupBy("role_id").agg(F.collect_set("feature").alias("features"))
    rows = t.user_roles.join(per_role, "role_id", "left").groupBy(F.col("user_id").alias("id"))
    rows = rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))).alias("f"), F.array_sort(F.collect_set(F.col("role_id").cast("string"))).alias("r"))
    return t.users.join(rows, "id").select("id", F.array_join("f", ",").alias("features"), F.array_join("r", ",").alias("roles"))


_SUBMITTED = "SELECT line_id, file_id, section, CASE WHEN line_id % 3 = 0 THEN gt || ' ' ELSE text END AS text FROM noisy_lines"


@query(f"""WITH s AS ({_SUBMITTED}) SELECT o.file_id, o.section, o.line_id, o.text AS original_text, s.text AS submitted, o.confidence
 FROM s JOIN noisy_lines o ON o.file_id = s.file_id AND o.section = s.section AND o.line_id = s.line_id WHERE trim(s.text) <> trim(o.text)""")
def join_correction_diff(t):
    from bazaarlake.operators.corrections import correction_diff

    return correction_diff(t.sql(_SUBMITTED), t.noisy_lines, ["file_id", "section", "line_id"]).select("file_id", "section", "line_id", "original_text", "submitted", "confidence")


@query()
def join_option_link(t):
    from bazaarlake.operators.corrections import link_options

    detected = t.noisy_lines.select(F.expr("line_id div 40").alias("session"), F.col("line_id").alias("place"), "text")
    dictionary = t.game_items.groupBy("name").agg(F.min("id").alias("option_id"))
    return link_options(detected, dictionary).select("session", "place", "option_id", "exact")


@query("""WITH d AS (SELECT name, min(id) AS by_name FROM game_items GROUP BY name) SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN option_id END, by_name) AS resolved_id, id % 2 = 0 OR by_name IS NOT NULL AS ok
 FROM listing_options LEFT JOIN d ON d.name = CASE WHEN id % 5 = 0 THEN 'no such' ELSE option_name END""")
def join_option_id_resolve(t):
    from bazaarlake.operators.corrections import resolve_option_ids

    given = t.listing_options.select("id", F.when(F.col("id") % 2 == 0, F.col("option_id")).alias("option_id"), F.when(F.col("id") % 5 == 0, "no such").otherwise(F.col("option_name")).alias("name"))
    found, rejected = resolve_option_ids(given, t.game_items.groupBy("name").agg(F.min("id").alias("id")))
    return found.select("id", "resolved_id", F.lit(True).alias("ok")).unionByName(rejected.select("id", F.lit(None).cast("long").alias("resolved_id"), F.lit(False).alias("ok")))


@query("SELECT line_id, text, item_id FROM noisy_lines LEFT JOIN (SELECT name, min(id) AS item_id FROM game_items GROUP BY name) i ON i.name = text")
def join_item_match(t):
    items = t.game_items.groupBy(F.col("name").alias("text")).agg(F.min("id").alias("item_id"))
    return t.noisy_lines.join(items, "text", "left").select("line_id", "text", "item_id")


@query(f"WITH {_ANCESTORS} SELECT item, string_agg(DISTINCT ancestor, ',' ORDER BY ancestor) AS ancestors FROM anc GROUP BY item")
def rec_ancestors(t):
    return H.ancestors(t.hierarchy).groupBy("item").agg(F.array_join(F.sort_array(F.collect_set("ancestor")), ",").alias("ancestors"))


@query("""SELECT count(*) FILTER (child NOT IN (SELECT parent FROM hierarchy)) AS leaves, (SELECT count(DISTINCT parent) FROM hierarchy) AS interior FROM (SELECT DISTINCT child FROM hierarchy)""")
def rec_hierarchy_counts(t):
    return H.node_counts(t.hierarchy)


# A tag for each customer; only the lowest ids are attached to anything.
_OWN_TAGS = "SELECT c_custkey AS id, c_name AS name, c_custkey % 5 * 40 AS weight FROM customer"


@query(f"""WITH g AS ({_OWN_TAGS}) SELECT id, name FROM g WHERE weight = 0 AND NOT EXISTS (SELECT 1 FROM tag_targets x JOIN listings l ON l.id = x.target_id WHERE x.target_type = 'listings' AND x.tag_id = g.id AND l.status NOT IN (2, 3))""")
def anti_orphan_tags(t):
    from bazaarlake.operators.tags import orphan_tags

    return orphan_tags(t.sql(_OWN_TAGS), t.tag_targets, t.listings).select("id", "name")


@query("""SELECT user_id AS session_id, max(created_at) AS last_at FROM activity_logs GROUP BY user_id HAVING max(created_at) < TIMESTAMP '2024-01-29 12:00:00'
 AND user_id NOT IN (SELECT user_id FROM activity_logs WHERE action = 'error' AND user_id % 3 = 0)""")
def anti_stale_sessions(t):
    from bazaarlake.operators.corrections import stale_sessions

    sessions = t.activity_logs.groupBy(F.col("user_id").alias("session_id")).agg(F.max("created_at").alias("last_at"))
    corrected = t.activity_logs.filter("action = 'error' and user_id % 3 = 0").select(F.col("user_id").alias("session_id"))
    return stale_sessions(sessions, corrected, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 24)
