"""Faceted listing search: filters, cascading text search, tag resolution, nested details."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.sources.scratch import stored

#: Columns that range filters may use; other names are ignored.
RANGE_COLUMNS = ("price", "damage", "magic_damage", "additional_damage", "balance", "defense", "protection", "magic_defense", "magic_protection", "durability", "piercing_level", "erg_level")
STRING_COLUMNS = ("erg_grade", "special_upgrade_type")
_OPERATORS = {"gte": lambda a, b: a >= b, ">=": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "<=": lambda a, b: a <= b, "eq": lambda a, b: a == b, "=": lambda a, b: a == b}


def compare(a: Column, op: str | None, b) -> Column:
    """a op b; an unknown operator means >=."""
    return _OPERATORS.get(op or ">=", _OPERATORS[">="])(a, b)


def attr_range(listings: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """min_x, max_x and eq_x on known columns, all of them; names and values that don't fit are ignored; null never matches."""
    for key, value in wanted.items():
        kind, _, column = key.partition("_")
        op = {"min": ">=", "max": "<=", "eq": "="}.get(kind)
        try:
            number = int(str(value))
        except ValueError:
            continue
        if op and column in RANGE_COLUMNS and column in listings.columns:
            listings = listings.filter(compare(F.col(column), op, F.lit(number)))
    return listings


def string_eq(rows: DataFrame, wanted: dict[str, str], columns: Sequence[str] = STRING_COLUMNS) -> DataFrame:
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]) if kv[0] in columns and kv[1] else df, wanted.items(), rows)


def with_options(listings: DataFrame, options: DataFrame, wanted: Iterable[tuple[str, int, str | None, float | None]]) -> DataFrame:
    """Listings for which each (type, id, op, level) holds for some option row (level None: it is enough that there is one). One pass over the options for all."""
    wanted = list(wanted)
    if not wanted:
        return listings
    conditions = [(F.col("option_type") == t) & (F.col("option_id") == i) & (F.lit(True) if level is None else compare(F.col("rolled_value"), op, F.lit(level))) for t, i, op, level in wanted]
    some = reduce(lambda a, b: a | b, conditions)
    met = options.filter(some).groupBy("listing_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"c{n}") for n, c in enumerate(conditions)])
    every = reduce(lambda a, b: a & b, [F.col(f"c{n}") for n in range(len(conditions))])
    return listings.join(met.filter(every).select(F.col("listing_id").alias("id")), "id", "left_semi")


def with_enchant(listings: DataFrame, enchant: int) -> DataFrame:
    return listings.filter((F.col("prefix_enchant_id") == enchant) | (F.col("suffix_enchant_id") == enchant))


def with_effect(listings: DataFrame, rolls: DataFrame, enchant: int, effect_order: int, op: str, value: float) -> DataFrame:
    """rolls: listing_id, enchant_id, effect_order, rolled_value."""
    hit = rolls.filter((F.col("enchant_id") == enchant) & (F.col("effect_order") == effect_order) & compare(F.col("rolled_value"), op, F.lit(value)))
    return listings.join(hit.select(F.col("listing_id").alias("id")), "id", "left_semi")


def saved_option_filters(searches: DataFrame, column: str = "filters") -> DataFrame:
    """JSON lists of option filters, one row each: unknown operators mean >=, items without id are skipped. Bad or empty JSON means no filter: such a search has one row, without type and id."""
    parsed = F.from_json(column, "array<struct<type: string, id: bigint, op: string, level: double>>")
    good = F.filter(parsed, lambda f: f["id"].isNotNull())
    rows = searches.withColumn("f", F.explode_outer(F.when(F.size(good) > 0, good)))
    op = F.when(F.col("f.op").isin("gte", ">="), ">=").when(F.col("f.op").isin("lte", "<="), "<=").when(F.col("f.op").isin("eq", "="), "=").otherwise(">=")
    return rows.select(*[c for c in searches.columns if c != column], F.col("f.type").alias("option_type"), F.col("f.id").alias("option_id"), op.alias("op"), F.col("f.level").alias("level"))


def run_saved_searches(searches: DataFrame, options: DataFrame, key: str = "search_id") -> DataFrame:
    """(search, listing, unfiltered): the listings for which every filter of the search holds. filters come from saved_option_filters().

    A search without filters holds for all listings: it has one row with unfiltered = true and no listing, not a row for each.
    """
    holds = F.expr("level is null or case op when '>=' then rolled_value >= level when '<=' then rolled_value <= level else rolled_value = level end")
    distinct = F.count_distinct("option_type", "option_id", "op", F.coalesce("level", F.lit(float("nan"))))
    filtered = searches.filter("option_id is not null")
    needed = filtered.groupBy(key).agg(distinct.alias("needed"))
    met = filtered.join(options, ["option_type", "option_id"]).filter(holds).groupBy(key, "listing_id").agg(distinct.alias("met"))
    found = met.join(needed, key).filter("met = needed").select(key, "listing_id", F.lit(False).alias("unfiltered"))
    free = searches.filter("option_id is null").select(key, F.lit(None).cast(options.schema["listing_id"].dataType).alias("listing_id"), F.lit(True).alias("unfiltered"))
    return found.unionByName(free)


def saved_enchant_filters(searches: DataFrame, column: str = "filters") -> DataFrame:
    """JSON lists of enchant filters with nested effects, a row for each enchant (effect_order null) and each of its effects.

    Unknown operators mean >=; enchants without id are skipped, and effects without enchant, order or value. Bad or empty JSON means no filter: such a search has one row, without enchant.
    """
    parsed = F.from_json(column, "array<struct<id: bigint, effects: array<struct<enchant_id: bigint, effect_order: int, op: string, value: double>>>>")
    good = F.filter(parsed, lambda f: f["id"].isNotNull())
    none = F.lit(None)
    slot = F.transform(good, lambda f: F.struct(f["id"].alias("enchant_id"), none.cast("int").alias("effect_order"), none.cast("string").alias("op"), none.cast("bigint").alias("value")))
    whole = F.filter(F.flatten(F.transform(good, lambda f: F.coalesce(f["effects"], F.array()))), lambda e: e["enchant_id"].isNotNull() & e["effect_order"].isNotNull() & e["value"].isNotNull())
    op = lambda e: F.when(e["op"].isin("lte", "<="), "<=").when(e["op"].isin("eq", "="), "=").otherwise(">=")
    effects = F.transform(whole, lambda e: F.struct(e["enchant_id"].alias("enchant_id"), e["effect_order"].alias("effect_order"), op(e).alias("op"), e["value"].cast("bigint").alias("value")))
    rows = searches.withColumn("f", F.explode_outer(F.when(F.size(good) > 0, F.array_distinct(F.concat(slot, effects)))))
    return rows.select(*[c for c in searches.columns if c != column], "f.*")


def run_saved_enchants(searches: DataFrame, listings: DataFrame, rolls: DataFrame, key: str = "search_id") -> DataFrame:
    """(search, listing, unfiltered): the listings that have every enchant of the search in either slot, and rolls for which all its effects hold. filters come from saved_enchant_filters(); a search without any has one row, as in run_saved_searches()."""
    filtered = searches.filter("enchant_id is not null").distinct()
    slots = listings.select(F.col("id").alias("listing_id"), F.explode(F.array_distinct(F.array("prefix_enchant_id", "suffix_enchant_id"))).alias("enchant_id"))
    worn = filtered.filter("effect_order is null").join(slots, "enchant_id")
    holds = F.expr("case op when '>=' then rolled_value >= value when '<=' then rolled_value <= value else rolled_value = value end")
    rolled = filtered.filter("effect_order is not null").join(rolls.select("listing_id", "enchant_id", "effect_order", "rolled_value"), ["enchant_id", "effect_order"]).filter(holds)
    columns = [key, "listing_id", "enchant_id", "effect_order", "op", "value"]
    met = worn.select(*columns).unionByName(rolled.select(*columns)).distinct().groupBy(key, "listing_id").agg(F.count("*").alias("met"))
    needed = filtered.groupBy(key).agg(F.count("*").alias("needed"))
    found = met.join(needed, key).filter("met = needed").select(key, "listing_id", F.lit(False).alias("unfiltered"))
    free = searches.filter("enchant_id is null").select(key, F.lit(None).cast(listings.schema["id"].dataType).alias("listing_id"), F.lit(True).alias("unfiltered"))
    return found.unionByName(free)


def names_like(rows: DataFrame, text: str, limit: int, column: str = "name") -> DataFrame:
    """Case-insensitive substring search, by name; % and _ keep their meaning."""
    return rows.filter(F.col(column).ilike(f"%{text}%")).orderBy(column, "id").limit(limit)


def suggest_tags(tags: DataFrame, text: str, limit: int) -> DataFrame:
    return tags.filter(F.col("name").ilike(f"%{text}%") & (F.col("weight") > 0)).orderBy(F.desc("weight"), "name").limit(limit)


def searchable_items(items: DataFrame, text: str, limit: int) -> DataFrame:
    return items.filter(F.col("searchable") & F.lower("name").contains(text.lower())).orderBy("id").limit(limit)


def visible(listings: DataFrame, owner: bool = False) -> DataFrame:
    return listings.filter("status <> 3" if owner else "status = 1")


def allowed_enchants(enchants: DataFrame, restrictions: DataFrame, ancestors: Sequence[str] | None) -> DataFrame:
    """enchants with a nullable `restriction`; restrictions: (restriction, node). Without an item type all stay."""
    if ancestors is None:
        return enchants
    nodes = restrictions.groupBy("restriction").agg(F.collect_set("node").alias("nodes"))
    joined = enchants.join(nodes, "restriction", "left")
    return joined.filter(F.col("restriction").isNull() | F.coalesce(F.arrays_overlap("nodes", F.array(*map(F.lit, ancestors))), F.lit(False))).drop("nodes").select(*enchants.columns)


def facets_for_items(ancestors: DataFrame, rules: DataFrame, only: DataFrame) -> DataFrame:
    """Filter keys of each item from its ancestors. rules: (node, facet) accumulate; only: (node, facet) replace all others."""
    found = ancestors.join(F.broadcast(rules), ancestors["ancestor"] == rules["node"], "left").groupBy("item").agg(F.sort_array(F.collect_set("facet")).alias("facets"))
    special = ancestors.join(F.broadcast(only), ancestors["ancestor"] == only["node"]).groupBy("item").agg(F.min("facet").alias("only"))
    return found.join(special, "item", "left").select("item", F.when(F.col("only").isNotNull(), F.array("only")).otherwise(F.col("facets")).alias("facets"))


# --- joins ------------------------------------------------------------------------------


def listing_summary(listings: DataFrame, items: DataFrame, enchants: DataFrame, users: DataFrame) -> DataFrame:
    """Listings with item name, both enchants' names and the seller; all joins are left."""
    item = items.select(F.col("id").alias("game_item_id"), F.col("name").alias("item_name"))
    enchant = lambda slot: enchants.select(F.col("id").alias(f"{slot}_enchant_id"), F.col("name").alias(f"{slot}_name"))
    seller = users.select(F.col("id").alias("user_id"), F.col("game_id").alias("seller"), "verified")
    return listings.join(item, "game_item_id", "left").join(enchant("prefix"), "prefix_enchant_id", "left").join(enchant("suffix"), "suffix_enchant_id", "left").join(seller, "user_id", "left")


def listing_entities(listings: DataFrame, options: DataFrame) -> DataFrame:
    """(listing_id, target_type, target_id): the listing itself, its item, its options and both enchants. One scan of the listings, and one of the options."""
    entity = lambda kind, column: F.struct(F.lit(kind).alias("target_type"), F.col(column).alias("target_id"))
    own = F.array(entity("listings", "id"), entity("game_items", "game_item_id"), entity("enchants", "prefix_enchant_id"), entity("enchants", "suffix_enchant_id"))
    rows = listings.select(F.col("id").alias("listing_id"), F.explode(own).alias("e")).select("listing_id", "e.*").filter("target_id is not null")
    return rows.unionByName(options.select("listing_id", F.col("option_type").alias("target_type"), F.col("option_id").alias("target_id")))


def resolve_tags(entities: DataFrame, targets: DataFrame, tags: DataFrame) -> DataFrame:
    """(listing_id, tag, weight): weights of tag and target added, the best per listing and tag name."""
    named = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"), F.col("weight").alias("tag_weight"))
    weighed = targets.join(named, "tag_id").select("target_type", "target_id", "tag", (F.col("tag_weight") + F.col("weight")).alias("weight"))
    # of several targets of one entity only the best weight per name matters: combined before the large join
    weighed = weighed.groupBy("target_type", "target_id", "tag").agg(F.max("weight").alias("weight"))
    return entities.join(weighed, ["target_type", "target_id"]).groupBy("listing_id", "tag").agg(F.max("weight").alias("weight"))


def nest_tags(resolved: DataFrame) -> DataFrame:
    """Tags of each listing: by weight, largest first, then name."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "tag", "weight")))
    return resolved.groupBy("listing_id").agg(F.transform(ordered, lambda x: F.struct(x["tag"].alias("name"), x["weight"].alias("weight"))).alias("tags"))


def nest_options(options: DataFrame) -> DataFrame:
    """Options of each listing in order of their ids."""
    return options.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("id", "option_type", "option_id", "option_name", "rolled_value", "max_level"))).alias("options"))


def effect_rolls(enchant_effects: DataFrame, effects: DataFrame, rolls: DataFrame, listings: DataFrame) -> DataFrame:
    """All effects of each listing's prefix enchant, with this listing's roll if it has one, by effect_order."""
    wanted = listings.filter("prefix_enchant_id is not null").select(F.col("id").alias("listing_id"), F.col("prefix_enchant_id").alias("enchant_id"))
    named = enchant_effects.join(effects.select(F.col("id").alias("effect_id"), F.col("name").alias("effect_name")), "effect_id", "left")
    best = rolls.groupBy("listing_id", "enchant_id", "effect_order").agg(F.max("rolled_value").alias("rolled_value"))
    return wanted.join(named.select("enchant_id", "effect_order", "effect_name", "min_value", "max_value"), "enchant_id").join(best, ["listing_id", "enchant_id", "effect_order"], "left")


def listing_detail(summary: DataFrame, options: DataFrame, tags: DataFrame, effects: DataFrame) -> DataFrame:
    """One nested record per listing."""
    nested = effects.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("effect_order", "effect_name", "rolled_value"))).alias("prefix_effects"))
    keyed = summary.withColumn("listing_id", F.col("id"))
    return keyed.join(options, "listing_id", "left").join(tags, "listing_id", "left").join(nested, "listing_id", "left").drop("listing_id")


def tagged(listings: DataFrame, options: DataFrame, targets: DataFrame, tags: DataFrame, wanted: Column) -> DataFrame:
    """(listing_id, tag) of the given listings and of the tags that are wanted: from the few tags to their targets, and only then to listings and options."""
    few = tags.filter(wanted).select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    where = targets.join(few, "tag_id").select("target_type", "target_id", "tag").distinct()
    mine = options.join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")
    return listing_entities(listings, mine).join(where, ["target_type", "target_id"]).select("listing_id", "tag").distinct()


def tag_division(listings: DataFrame, options: DataFrame, targets: DataFrame, tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Listings that carry all of the tags."""
    if not names:
        return listings
    found = tagged(listings, options, targets, tags, F.col("name").isin(*names))
    every = found.groupBy("listing_id").agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(set(names)))
    return listings.join(every.select(F.col("listing_id").alias("id")), "id", "left_semi")


def cascade_search(listings: DataFrame, options: DataFrame, items: DataFrame, targets: DataFrame, tags: DataFrame, text: str, among: DataFrame | None = None) -> DataFrame:
    """Listings (of `among`, if given) by the first tier whose dimension has a match at all: tags, then item names, then listing names; tier says which.

    Which tier holds is one row, found first, so only that tier's search runs.
    """
    among = listings if among is None else among
    like = F.col("name").ilike(f"%{text}%")
    found = items.filter(like).select(F.col("id").alias("game_item_id"))
    if not tags.filter(like).isEmpty():
        ids, tier = tagged(among, options, targets, tags, like).select(F.col("listing_id").alias("id")).distinct(), 1
    elif not found.isEmpty():
        ids, tier = among.join(found, "game_item_id", "left_semi").select("id"), 2
    else:
        ids, tier = among.filter(like).select("id"), 3
    return ids.withColumn("tier", F.lit(tier))


@dataclass
class SearchSpec:
    """What a listing search asks for."""

    text: str = ""
    tags: Sequence[str] = ()
    ranges: dict[str, object] = field(default_factory=dict)
    options: Sequence[tuple[str, int, str | None, float | None]] = ()
    strings: dict[str, str] = field(default_factory=dict)
    enchant: int | None = None
    #: (enchant, effect_order, op, value): one roll of the listing must meet each.
    effects: Sequence[tuple[int, int, str, float]] = ()
    limit: int = 50
    offset: int = 0


def search_listings(spec: SearchSpec, listings: DataFrame, options: DataFrame, items: DataFrame, targets: DataFrame, tags: DataFrame, rolls: DataFrame | None = None) -> DataFrame:
    """Public listings that meet the whole spec, newest first, with nested tags and options of the page alone. rolls: for effect filters.

    In stages, each written once: what the filters on columns and options leave, the page (200 rows at most), and the page's options;
    so tags are looked up for few listings, and no stage plans the ones before it again.
    """
    shown = visible(listings)
    found = with_options(string_eq(attr_range(shown, spec.ranges), spec.strings), options, spec.options)
    if spec.enchant is not None:
        found = with_enchant(found, spec.enchant)
    for enchant, effect_order, op, value in spec.effects:
        found = with_effect(found, rolls, enchant, effect_order, op, value)
    if spec.tags or spec.text:
        found = stored(found, "found")
    if spec.text:
        found = found.join(cascade_search(shown, options, items, targets, tags, spec.text, found).select("id"), "id", "left_semi")
    found = tag_division(stored(found, "found") if spec.text and spec.tags else found, options, targets, tags, spec.tags)
    page = stored(found.orderBy(F.desc("id")).offset(spec.offset).limit(max(1, min(200, spec.limit))), "page")
    mine = stored(options.join(F.broadcast(page.select(F.col("id").alias("listing_id"))), "listing_id", "left_semi"), "page-options")  # 200 listings at most
    detail = page.withColumn("listing_id", F.col("id"))
    detail = detail.join(nest_tags(resolve_tags(listing_entities(page, mine), targets, tags)), "listing_id", "left").join(nest_options(mine), "listing_id", "left")
    return detail.drop("listing_id").orderBy(F.desc("id"))  # the joins don't keep the page's order


def suggestions(tags: DataFrame, items: DataFrame, listings: DataFrame, text: str, n_tags: int = 5, n_items: int = 3, n_listings: int = 5) -> DataFrame:
    """(kind, rank, label): tags, then items, then listings."""
    from pyspark.sql import Window

    def ranked(df: DataFrame, order: list, kind: int, label: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind_no"), F.lit(label).alias("kind"), F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("name").alias("label"))

    by_newest = visible(listings).filter(F.col("name").ilike(f"%{text}%")).orderBy(F.desc("id")).limit(n_listings)
    parts = (
        ranked(suggest_tags(tags, text, n_tags), [F.desc("weight"), "name"], 0, "tag"),
        ranked(searchable_items(items, text, n_items), ["id"], 1, "item"),
        ranked(by_newest, [F.desc("id")], 2, "listing"),
    )
    return reduce(DataFrame.unionByName, parts).orderBy("kind_no", "rank").select("kind", "rank", "label")


def display_names(targets: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Targets with the name of what they point at: the dimensions (id, name) united by type, and one left join."""
    named = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("target_type"), F.col("id").cast("long").alias("target_id"), F.col("name").alias("display_name")) for kind, df in dimensions.items()])
    return targets.join(named, ["target_type", "target_id"], "left")
