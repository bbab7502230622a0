"""Dictionary ingestion: nested sources, upserts with reports, ids, exports, generated listings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.sources import snapshots
from bazaarlake.sources.scratch import scratch_table, stored


def explode_effects(records: DataFrame, key: str = "id", effects: str = "effects") -> tuple[DataFrame, DataFrame]:
    """Parent rows, and a row per nested (condition, effect) with a 1-based effect_order and raw_text."""
    children = records.select(F.col(key).alias("parent_id"), F.posexplode(effects).alias("pos", "e"))
    raw = F.concat_ws(" ", F.nullif(F.col("e.condition"), F.lit("")), F.col("e.effect"))
    return records.drop(effects), children.select("parent_id", (F.col("pos") + 1).alias("effect_order"), "e.*", raw.alias("raw_text"))


def flatten_options(maps: DataFrame, column: str, source: str) -> DataFrame:
    """Map name -> options (option_id, option_name), flattened; of rows with one id the first in order of (source, place in the map, place in the list) stays."""
    rows = maps.select(source, F.posexplode(F.map_entries(column)).alias("entry_no", "entry")).select(source, "entry_no", F.col("entry.key").alias("name"), F.posexplode("entry.value").alias("no", "o"))
    first = F.min_by(F.struct("name", "o"), F.struct(source, "entry_no", "no"))
    return rows.groupBy("o.option_id").agg(first.alias("x")).select("option_id", "x.name", "x.o.option_name")


def rank_number(rank: Column) -> Column:
    """A..F are 10..15, else an integer; what is neither is null."""
    letter = F.instr(F.lit("ABCDEF"), F.upper(F.trim(rank)))
    return F.when((F.length(F.trim(rank)) == 1) & (letter > 0), letter + 9).otherwise(rank.try_cast("int"))


def header_texts(entries: DataFrame, keep_numbers: bool = True) -> DataFrame:
    """entries: (ord, slot_name, name, rank). '[slot] name (랭크 rank)', without the rank if it is a number and keep_numbers is off; each text once, in order of first sight."""
    full = F.format_string("[%s] %s (랭크 %s)", "slot_name", "name", "rank")
    short = F.format_string("[%s] %s", "slot_name", "name")
    text = full if keep_numbers else F.when(F.col("rank").try_cast("int").isNotNull(), short).otherwise(full)
    return entries.select(text.alias("text"), "ord").groupBy("text").agg(F.min("ord").alias("ord"))


def set_names(items: DataFrame, pattern: str, suffix: str) -> DataFrame:
    """Distinct names that the pattern's first group finds, and without the suffix; sorted."""
    found = items.select(F.regexp_extract("name", pattern, 1).alias("set_name")).filter("set_name <> ''").distinct()
    return found.withColumn("trimmed", F.regexp_replace("set_name", re.escape(suffix) + "$", "")).orderBy("set_name")


def parse_effects(texts: DataFrame, effects: DataFrame, up: str = "증가", down: str = "감소") -> DataFrame:
    """texts: (id, text) '<name> min[~max][%] up|down' -> id, effect_name, min_value, max_value (negative for down); all null unless name or 'name (%)' is a known effect (name).

    The last word is the direction, in front of it stands a number or a range, with or without a percent sign, and the rest is the name.
    """
    bare = F.trim("text")
    direction = F.when(bare.endswith(up), up).when(bare.endswith(down), down)
    body = F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - F.length(direction)))
    at = F.regexp_instr(body, F.lit(r"\s[0-9.]+(\s*~\s*[0-9.]+)?\s*%?$"))
    values = F.transform(F.split(F.trim(F.substring(body, at, F.length(body)), F.lit(" %")), "~"), lambda x: F.trim(x).try_cast("double"))
    low, high = values[0], F.try_element_at(values, F.lit(-1))
    good = (at > 1) & low.isNotNull() & high.isNotNull()
    name = F.when(good, F.rtrim(F.substring(body, F.lit(1), at - 1)))
    sign = F.when(direction == down, -1.0).otherwise(1.0)
    rows = texts.select("id", name.alias("n"), F.when(good, low * sign + 0.0).alias("low"), F.when(good, high * sign + 0.0).alias("high"))
    known = effects.select(F.col("name").alias("n"), F.col("name").alias("plain"))
    percent = effects.select(F.regexp_replace("name", r" \(%\)$", "").alias("n"), F.col("name").alias("percent")).filter("n <> percent")
    rows = rows.join(known, "n", "left").join(percent, "n", "left").withColumn("effect_name", F.coalesce("plain", "percent"))
    return rows.select("id", "effect_name", *[F.when(F.col("effect_name").isNotNull(), F.col(a)).alias(b) for a, b in (("low", "min_value"), ("high", "max_value"))])


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The target after the upsert, with action: inserted, updated (some column differs, nulls compared as values), unchanged, or kept (not in the source)."""
    values = [c for c in target.columns if c != key]
    a = target.select(key, F.struct(*values).alias("old"))
    b = source.select(key, F.struct(*values).alias("new"))
    rows = a.join(b, key, "full")
    same = F.col("old").eqNullSafe(F.col("new"))
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    now = F.coalesce("new", "old")
    return rows.select(key, *[now[c].alias(c) for c in values], action.alias("action"))


def upsert_report(upserted: dict[str, DataFrame]) -> DataFrame:
    """(table, inserted, updated, unchanged)."""
    parts = [df.select(F.lit(name).alias("table"), "action") for name, df in upserted.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("table").pivot("action", ["inserted", "updated", "unchanged"]).count().na.fill(0)


def write_upsert(target_path: str, source: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """Upserts a table of sources.snapshots: the new state is written whole beside the old one and becomes the next version in one step, so a failed write
    changes nothing, a reader keeps the version that it has, and of two writers at once one gets a Conflict. Returns the report; dry_run writes nothing."""
    spark = source.sparkSession
    after = snapshots.latest(spark, target_path)
    merged = upsert(snapshots.read(spark, target_path), source, key)
    if dry_run:
        return upsert_report({target_path: merged})
    actions = stored(merged, "upserted")
    snapshots.publish(spark, target_path, snapshots.stage(actions.drop("action"), target_path), after)
    return upsert_report({target_path: actions})


def write_fresh(rows: DataFrame, path: str) -> int:
    """Replaces the rows of a table of sources.snapshots; returns the version."""
    return snapshots.write(rows, path)


def source_digest(files: DataFrame) -> DataFrame:
    """files: (path, content), as Spark's binaryFile source gives them -> one SHA-256 over the files' digests in order of their paths. A row per file is combined."""
    each = files.select("path", F.sha2("content", 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("path", "d")))["d"], ""), 256).alias("digest"))


def file_digests(files: DataFrame) -> DataFrame:
    """files: (path, content) -> (path, digest). Spark's binaryFile source gives no row for an empty file, and none above 2 GB."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


def tree_digest(digests: DataFrame, bucket: int = 256) -> DataFrame:
    """(path, digest) -> one row: root, a digest of all paths and digests, however many there are.

    The paths' own digests are a tree of 16 branches a level, with so many levels that a leaf holds about `bucket` files or fewer: leaves digest their files
    in order, a node the digests of its branches in order. So no task has more than a leaf's or a node's rows, and equal sets of files have equal
    roots in any partitioning. Without files the root is the digest of an empty text.
    """
    n, levels = digests.count(), 0
    while n > bucket * 16**levels:
        levels += 1
    place = F.sha2(F.col("path").cast("binary"), 256)
    combine = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: F.concat(x["at"], F.lit(":"), F.coalesce(x["digest"], F.lit("-")))), "\n"), 256)
    nodes = digests.select(F.coalesce(place, F.lit("-")).alias("at"), "digest")
    for level in range(levels, -1, -1):
        nodes = nodes.groupBy(F.substring("at", 1, level).alias("node")).agg(combine.alias("digest")).withColumnRenamed("node", "at") if level else nodes.agg(combine.alias("root"))
    return nodes


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, digest) of both -> (path, digest, change): added, changed, unchanged, or removed (with a null digest)."""
    rows = now.withColumn("there", F.lit(True)).join(before.select("path", F.col("digest").alias("old"), F.lit(True).alias("was")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("there").isNull(), "removed").when(F.col("digest").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return rows.select("path", "digest", change.alias("change"))


def refresh_files(files: DataFrame, state_path: str) -> DataFrame:
    """The changes of files (path, content) against the state in a table of sources.snapshots, which gets a new version if there are any. Without a state all files are added; of two runs at once that find changes, one gets a Conflict."""
    spark = files.sparkSession
    now, after = stored(file_digests(files), "digests"), snapshots.latest(spark, state_path)
    before = snapshots.read(spark, state_path) if after else now.limit(0)
    changes = stored(changed_files(now, before), "changes")
    if not after or changes.filter("change <> 'unchanged'").limit(1).count():
        snapshots.publish(spark, state_path, snapshots.stage(now, state_path), after)
    return changes


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: the digest, and whether it differs from the stored one (digest), or none is stored."""
    last = stored.agg(F.max("digest").alias("stored"))
    return source_digest(files).join(F.broadcast(last)).select("digest", (~F.col("digest").eqNullSafe(F.col("stored"))).alias("changed"))


def assign_ids(rows: DataFrame, natural_key: Sequence[str], id_col: str = "id") -> DataFrame:
    """Missing ids become a digest of the natural key; given ones stay, and reruns agree."""
    key = F.to_json(F.struct(*natural_key))
    return rows.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.substring(F.sha2(key, 256), 1, 32)))


def backfill_key(rows: DataFrame, dimension: DataFrame, name: str, key: str) -> DataFrame:
    """Fills a null foreign key from the equality of names; dimension: (id, name)."""
    found = dimension.groupBy(F.col("name").alias(name)).agg(F.min("id").alias("found"))
    return rows.join(found, name, "left").withColumn(key, F.coalesce(F.col(key), F.col("found"))).drop("found")


def seed_rules(existing: DataFrame, seeds: DataFrame, force: bool = False) -> DataFrame:
    """Inserts by unique name; existing rules stay, or take the seeds' other columns with force."""
    if force:
        kept = existing.join(seeds.select("name"), "name", "left_anti")
        return kept.select(*existing.columns).unionByName(seeds.select(*existing.columns))
    return existing.unionByName(seeds.join(existing.select("name"), "name", "left_anti").select(*existing.columns))


def generate_listings(spark: SparkSession, n: int, items: DataFrame, seed: int = 1, null_share: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeded listings, options (0 to 3 each) and tags (1 to 5 each, with weights 80, 60, 30, 0, 0). Every value is a hash of the row's number, so any partitioning gives the same rows. items: (place, id) numbered from 0."""
    draw = lambda what, m, *more: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what), *more), F.lit(m))
    n_items = items.agg((F.max("place") + 1).alias("n_items"))
    base = spark.range(n).select(F.col("id")).join(F.broadcast(n_items))  # one row
    rows = base.withColumn("place", F.pmod(F.xxhash64("id", F.lit(seed), F.lit("item")), F.col("n_items"))).join(items.select("place", F.col("id").alias("game_item_id")), "place")
    maybe = lambda what, value: F.when(draw(f"{what}?", 1000) >= int(1000 * null_share), value)
    listings = rows.select("id", "game_item_id", (draw("status", 3) + 1).alias("status"), maybe("price", draw("price", 1_000_000)).alias("price"), maybe("damage", draw("damage", 100)).alias("damage"))
    options = listings.select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("no")).filter(F.col("no") <= draw("options", 4))
    options = options.select(F.col("id").alias("listing_id"), "no", draw("option", 500, F.col("no")).alias("option_id"), (draw("value", 50, F.col("no")) + 1).alias("rolled_value"))
    tags = listings.select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("no")).filter(F.col("no") <= draw("tags", 5) + 1)
    weight = F.element_at(F.array(*map(F.lit, (80, 60, 30, 0, 0))), F.col("no"))
    return listings, options, tags.select(F.col("id").alias("listing_id"), "no", F.concat(F.lit("t"), draw("tag", 40, F.col("no"))).alias("name"), weight.alias("weight"))


def nested_export(rows: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str = "options") -> DataFrame:
    """One document per entity with its sorted nested rows; write.json makes the file."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))


def flat_export(rows: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    return rows.select(*columns).distinct().orderBy(order)


def label_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (value) 'file<tab>label' -> (file, label) and the rejected lines; blank ones go."""
    parts = lines.filter(F.trim("value") != "").withColumn("p", F.split("value", "\t", 2))
    good = (F.size("p") == 2) & (F.col("p")[0] != "") & (F.get("p", F.lit(1)) != "")
    return parts.filter(good).select(F.col("p")[0].alias("file"), F.col("p")[1].alias("label")), parts.filter(~good).select("value")


def pair_truth(files: DataFrame, truths: DataFrame, forms: Sequence[str]) -> DataFrame:
    """files (file) with the first of the name forms ({} is the name without its ending) that is among truths (truth); files without one go."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    candidates = F.array(*[F.format_string(form.replace("{}", "%s"), stem) for form in forms])
    rows = files.select("file", F.posexplode(candidates).alias("no", "truth")).join(truths, "truth", "left_semi")
    return rows.groupBy("file").agg(F.min_by("truth", "no").alias("truth"))


def image_label_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """images (path, width, height), labels (path, text), paired by name without folder and ending; without empty labels and empty images; numbered from 1 by name."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[^./]*)?$", 1)
    good = images.filter("width > 0 and height > 0").select(stem("path").alias("name"), F.col("path").alias("image"))
    rows = good.join(labels.filter(F.trim("text") != "").select(stem("path").alias("name"), F.trim("text").alias("label")), "name")
    return number_rows(rows, "name")


def number_rows(rows: DataFrame, order: str, start: int = 1, name: str = "number") -> DataFrame:
    """Consecutive numbers in order. Rows are range-partitioned and sorted; each partition numbers its own, and is shifted by the sizes of those before it (a row per partition is broadcast)."""
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()  # partition in the upper bits, row of the partition in the lower 33
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).withColumn("_place", place)
    path = scratch_table(spark, "numbered")
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path).withColumn("_part", F.shiftright("_place", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = kept.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return shifted.withColumn(name, F.col("_place").bitwiseAND((1 << 33) - 1) + F.col("_before") + start).drop("_part", "_place", "_before")
