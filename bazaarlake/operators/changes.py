"""Change capture and workflows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Never part of an audit record.
UNAUDITED = ("id", "created_at", "updated_at")


def audit_diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, action, before, after) as name -> value maps: create has all of the new values, delete all of the old, update those that changed; rows without change have none."""
    names = [c for c in before.columns if c not in UNAUDITED and c != key]

    def values(df: DataFrame, name: str) -> DataFrame:
        pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
        return df.select(key, F.create_map(*pairs).alias(name))

    rows = values(before, "b").join(values(after, "a"), key, "full")
    differs = lambda k, v: ~F.coalesce(F.col("a"), F.create_map())[k].eqNullSafe(F.coalesce(F.col("b"), F.create_map())[k])
    action = F.when(F.col("b").isNull(), "create").when(F.col("a").isNull(), "delete").otherwise("update")
    shown = lambda m, other: F.when(F.col(other).isNull(), F.col(m)).otherwise(F.map_filter(m, differs))
    rows = rows.select(key, action.alias("action"), shown("b", "a").alias("before"), shown("a", "b").alias("after"))
    return rows.filter((F.col("action") != "update") | (F.size("after") > 0))


def status_updates(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """requests: (id, user_id, new_status) -> with reason: null if it is done; else why not (status, unknown, owner)."""
    own = listings.select("id", F.col("user_id").alias("owner"), "status")
    reason = F.when(~F.col("new_status").between(0, 3), "status").when(F.col("owner").isNull(), "unknown").when(F.col("owner") != F.col("user_id"), "owner")
    return requests.join(own, "id", "left").select("id", "user_id", "new_status", reason.alias("reason"))


def correction_states(corrections: DataFrame, decisions: DataFrame) -> DataFrame:
    """corrections: (id, state, text); decisions: (id, action, text). approve and edit hold only for pending rows; edit also replaces the text."""
    made = decisions.select("id", "action", F.col("text").alias("new_text"))
    rows = corrections.join(made, "id", "left")
    taken = (F.col("state") == "pending") & F.col("action").isin("approve", "edit")
    return rows.select(
        "id", F.when(taken, "approved").otherwise(F.col("state")).alias("state"), F.when(taken & (F.col("action") == "edit"), F.col("new_text")).otherwise(F.col("text")).alias("text"),
        (F.col("action").isNotNull() & ~F.coalesce(taken, F.lit(False))).alias("rejected"),
    )


def unverify(users: DataFrame, changes: DataFrame, watched: Sequence[str] = ("server", "game_id")) -> DataFrame:
    """users after changes (id and new values, null: no change); a change of a watched column clears verified."""
    new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in watched])
    rows = users.join(new, "id", "left")
    moved = F.lit(False)
    for c in watched:
        moved = moved | (F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)))
    return rows.select("id", *[F.coalesce(f"new_{c}", c).alias(c) for c in watched], F.when(moved, False).otherwise(F.col("verified")).alias("verified"))


def mark_trained(corrections: DataFrame, used: DataFrame, version: str) -> DataFrame:
    """Used corrections get the state trained and the version."""
    rows = corrections.join(used.select("id", F.lit(True).alias("used")), "id", "left")
    with_default = lambda c: F.col(c) if c in corrections.columns else F.lit(None).cast("string")
    return rows.select(*[c for c in corrections.columns if c not in ("state", "version")], F.when(F.col("used"), "trained").otherwise(F.col("state")).alias("state"), F.when(F.col("used"), version).otherwise(with_default("version")).alias("version"))


def register(payloads: DataFrame, sources: Sequence[str] = ("enchants", "reforges", "echostones", "murias")) -> tuple[DataFrame, DataFrame]:
    """payloads: (id, name, slots array<struct<slot, enchant_id>>, one array<struct<option_id, rolled_value>> for each source) -> listing rows and option rows. Of several entries of a slot the last wins."""
    def last(slot: int) -> Column:
        return F.try_element_at(F.filter("slots", lambda x: x["slot"] == slot), F.lit(-1))["enchant_id"]

    listing = payloads.select("id", "name", last(0).alias("prefix_enchant_id"), last(1).alias("suffix_enchant_id"))

    def tagged(source: str) -> Column:
        rows = F.coalesce(F.col(source), F.array().cast("array<struct<option_id:bigint,rolled_value:double>>"))
        return F.transform(rows, lambda x: F.struct(F.lit(source).alias("option_type"), x["option_id"].alias("option_id"), x["rolled_value"].alias("rolled_value")))

    options = payloads.select(F.col("id").alias("listing_id"), F.posexplode(F.concat(*map(tagged, sources))).alias("pos", "o")).select("listing_id", "pos", "o.*")
    return listing, options
