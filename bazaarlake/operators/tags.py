"""Assignment and upkeep of tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of a listing's first user tags, by position; later ones get 0.
POSITIONS = (80, 60, 30)


def orphan_tags(tags: DataFrame, targets: DataFrame, listings: DataFrame, any_target: bool = False) -> DataFrame:
    """Tags of weight 0 that no listing other than sold and deleted ones carries. any_target: attachments to other things keep a tag as well."""
    live = listings.filter("status not in (2, 3)").select(F.col("id").alias("target_id"))
    held = targets.filter("target_type = 'listings'").join(live, "target_id", "left_semi").select(F.col("tag_id").alias("id"))
    if any_target:
        held = held.unionByName(targets.filter("target_type <> 'listings'").select(F.col("tag_id").alias("id")))
    return tags.filter("weight = 0").join(held, "id", "left_anti")


def positional_weights(requests: DataFrame, tags: DataFrame, names: str = "names") -> DataFrame:
    """requests: (target_id, names array). Weight of each given tag: max(0, position's - the tag's own); blank names take a position and go."""
    rows = requests.select("target_id", F.posexplode(names).alias("pos", "name")).withColumn("name", F.trim("name")).filter("name <> ''")
    place = F.coalesce(F.get(F.array(*map(F.lit, POSITIONS)), F.col("pos")), F.lit(0))
    own = tags.select("name", F.col("weight").alias("own"))
    first = rows.groupBy("target_id", "name").agg(F.min("pos").alias("pos"))
    return first.join(own, "name", "left").select("target_id", "name", F.greatest(F.lit(0), place - F.coalesce("own", F.lit(0))).alias("weight"))


def add_auto_tags(attached: DataFrame, auto: DataFrame) -> DataFrame:
    """(target_id, name, weight) with automatic tags (target_id, name) of weight 0 where they aren't attached yet."""
    new = auto.select("target_id", "name").distinct().join(attached, ["target_id", "name"], "left_anti")
    return attached.unionByName(new.withColumn("weight", F.lit(0)))


def bulk_attach(names: DataFrame, targets: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every name with every target (a request lists both), and per name how many are created and how many were there."""
    listed = names.agg(F.array_sort(F.collect_set("name")).alias("listed"))  # one row: the names of a request
    wanted = targets.join(F.broadcast(listed)).withColumn("name", F.explode("listed")).drop("listed")
    there = existing.select("name", "target_type", "target_id", F.lit(True).alias("there")).distinct()
    marked = wanted.join(there, ["name", "target_type", "target_id"], "left")
    counts = marked.groupBy("name").agg(F.count(F.when(F.col("there").isNull(), 1)).alias("created"), F.count("there").alias("duplicates"))
    return marked.filter("there is null").drop("there"), counts


def update_weight(tags: DataFrame, ids: Sequence[int], weight: int) -> DataFrame:
    return tags.withColumn("weight", F.when(F.col("id").isin(*ids), weight).otherwise(F.col("weight")))
