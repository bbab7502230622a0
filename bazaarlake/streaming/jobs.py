"""Structured Streaming jobs: activity logs, verification codes, tags on arrival. Each agrees with its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long a verification code holds.
LIFETIME = "30 minutes"


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Runs a query over all data that is there, and ends."""
    stream.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(sink).awaitTermination()


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


# --- activity ---------------------------------------------------------------------------


def activity_rows(events: DataFrame) -> DataFrame:
    """Append form of action events: ids as texts, metadata only if it is a JSON object. For batches and streams."""
    clean = F.when(F.try_parse_json("props").isNotNull() & F.col("props").startswith("{"), F.col("props"))
    return events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), clean.alias("metadata"), F.col("ts").alias("created_at"))


def action_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("action").agg(F.count("*").alias("n"))


def write_latest(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of complete counts: each batch replaces the table, so a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


# --- verification codes -----------------------------------------------------------------


def live_codes(requests: DataFrame) -> DataFrame:
    """(user_id, code, issued_at, expires_at): the latest request of each user replaces those before."""
    last = requests.groupBy("user_id").agg(F.max_by(F.struct("code", "issued_at"), F.struct("issued_at", "code")).alias("r"))
    return last.select("user_id", "r.*").withColumn("expires_at", F.col("issued_at") + F.expr(f"INTERVAL {LIFETIME}"))


def eligible(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (user_id, code, issued_at) of known users (id, server, game_id, verified) that aren't verified and have a server and a game id, with these."""
    open_users = users.filter("not verified and server is not null and game_id is not null").select(F.col("id").alias("user_id"), "server", "game_id")
    return requests.join(open_users, "user_id")


_CODE = "user_id long, code string, issued_at timestamp_ntz"


def _millis(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def latest_request(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a user's latest request as state while its code lives, and emits it when it changes."""
    if state.hasTimedOut:
        state.remove()
        return
    best = state.get if state.exists else None
    new = best
    for frame in frames:
        for code, at in zip(frame["code"], frame["issued_at"], strict=True):
            if new is None or (at, code) > (new[1], new[0]):
                new = (code, at.to_pydatetime())
    if new is not None and new != best:
        yield pd.DataFrame({"user_id": [key[0]], "code": [new[0]], "issued_at": [new[1]]})
    expires = _millis(new[1]) + _millis(pd.Timestamp(0) + pd.Timedelta(LIFETIME))
    if expires > state.getCurrentWatermarkMs():
        state.update(new)
        state.setTimeoutTimestamp(expires)
    elif state.exists:
        state.remove()


def stream_codes(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Streaming form of live_codes: an update per change; the last one of a user holds. The state of a user goes when the code has expired."""
    timed = requests.withColumn("issued_at", F.col("issued_at").cast("timestamp")).withWatermark("issued_at", late)
    return timed.groupBy("user_id").applyInPandasWithState(latest_request, _CODE, "code string, issued_at timestamp_ntz", "update", GroupStateTimeout.EventTimeTimeout)


def unexpired(codes: DataFrame, now) -> DataFrame:
    return codes.filter(F.col("expires_at") > now)


def verified_users(messages: DataFrame, codes: DataFrame, lifetime: str = LIFETIME) -> DataFrame:
    """(user_id, verified_at): users whose message holds their code while it lives; the first such message.

    messages: (server, game_id, sent_at, message); codes: (user_id, server, game_id, code, issued_at), as
    from eligible(). A code lives until the user's next request replaces it, and no longer than `lifetime`.
    Only messages of the same game id on the same server meet a code (an equi-join).
    """
    following = F.lead("issued_at").over(Window.partitionBy("user_id").orderBy("issued_at", "code"))
    spans = codes.withColumn("ends_at", F.least(following, F.col("issued_at") + F.expr(f"INTERVAL {lifetime}")))
    hits = messages.join(spans, ["server", "game_id"]).filter((F.col("sent_at") >= F.col("issued_at")) & (F.col("sent_at") < F.col("ends_at")) & F.contains(F.col("message"), F.col("code")))
    return hits.groupBy("user_id").agg(F.min("sent_at").alias("verified_at"))


_OPEN = "code_at array<bigint>, code array<string>, said_at array<bigint>, said array<string>, found bigint, shown bigint"


def _settle(lifetime: str):
    lasts = int(pd.Timedelta(lifetime).total_seconds() * 1_000_000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A user's codes and messages that the watermark leaves open, the first hit before it, and what was emitted last."""
        code_at, code, said_at, said, found, shown = state.get if state.exists else ([], [], [], [], None, None)
        codes, messages = set(zip(code_at, code, strict=True)), set(zip(said_at, said, strict=True))
        for frame in frames:
            for at, is_code, text in zip(frame["at"], frame["is_code"], frame["text"], strict=True):
                (codes if is_code else messages).add((int(pd.Timestamp(at).value // 1000), text))
        ordered = sorted(codes)
        following = [*(x[0] for x in ordered[1:]), 1 << 62][: len(ordered)]  # a user whose messages come before any code has none
        ends = [min(at + lasts, after) for (at, _), after in zip(ordered, following, strict=True)]
        hits = [t for t, text in messages for (at, c), end in zip(ordered, ends, strict=True) if at <= t < end and c in text]
        best = min([*hits, *([found] if found is not None else [])], default=None)
        row = lambda final: pd.DataFrame({"user_id": [key[0]], "verified_at": [pd.Timestamp(best * 1000) if best is not None else pd.NaT], "final": [final]})
        if state.hasTimedOut:  # the watermark is behind all that is known: nothing can change any more
            if best is not None:
                yield row(True)
            state.remove()
            return
        if best != shown:  # a late request may replace a code that was already met: then the hit is taken back
            yield row(False)
        # requests before the watermark can't come any more: messages before it are settled, and of codes the last one before it and those after it count
        mark = state.getCurrentWatermarkMs() * 1000
        found = min([*(t for t in hits if t < mark), *([found] if found is not None else [])], default=None)
        done = max((at for at, _ in ordered if at < mark), default=None)
        ordered = [x for x in ordered if x[0] >= (done or 0) and x[0] + lasts > mark]
        kept = sorted(x for x in messages if x[0] >= mark)
        if ordered or kept or found is not None:
            state.update(([x[0] for x in ordered], [x[1] for x in ordered], [x[0] for x in kept], [x[1] for x in kept], found, best))
            ends_at = max([*(x[0] + lasts for x in ordered), *(x[0] for x in kept), *([found] if found is not None else [])])
            state.setTimeoutTimestamp(max(ends_at, mark) // 1000 + 1)
        elif state.exists:
            state.remove()

    return run


def stream_verified(messages: DataFrame, codes: DataFrame, lifetime: str = LIFETIME, late: str = "1 hour") -> DataFrame:
    """Streaming form of verified_users: an update whenever a user's first hit changes (null: taken back, as a late request replaced the code), and a last one, marked final, once the
    watermark has passed all that is open. The first final hit of a user holds, or, without one, the last update.

    Messages carry the user_id that their game id and server stand for (a static join before). The state of a user holds what the watermark leaves open, and the
    hit; it goes when its codes have expired.
    """
    said = messages.select("user_id", F.col("sent_at").cast("timestamp").alias("at"), F.lit(False).alias("is_code"), F.col("message").alias("text"))
    issued = codes.select("user_id", F.col("issued_at").cast("timestamp").alias("at"), F.lit(True).alias("is_code"), F.col("code").alias("text"))
    both = said.unionByName(issued).withWatermark("at", late)
    return both.groupBy("user_id").applyInPandasWithState(_settle(lifetime), "user_id long, verified_at timestamp_ntz, final boolean", _OPEN, "update", GroupStateTimeout.EventTimeTimeout)


# --- tags on arrival --------------------------------------------------------------------


def tag_batches(path: str, tagger: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: tags (target_id, tag) of the arrived listings, in a folder per batch. A repeated batch overwrites its own, and a read takes distinct rows, so attaching is idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        tagger(batch).distinct().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
