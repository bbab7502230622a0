"""Queries over evaluation, training sets, recommendations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.operators import evaluation as V
from bazaarlake.operators import recommend as N
from bazaarlake.operators.ingest import number_rows
from bazaarlake.plans.registry import query
from bazaarlake.sources.exports import read_ordered, write_ordered
from bazaarlake.sources.scratch import scratch_table, stored
from bazaarlake.streaming import jobs as J


def _compared(t):
    lines = t.noisy_lines.drop("gt").withColumn("corrected", F.col("line_id") % 4 == 1)
    return V.compare_lines(lines, t.noisy_lines.select("file_id", "line_id", "gt"), ["file_id", "line_id"])


@query()
def agg_accuracy_file(t):
    return V.accuracy_by_file(_compared(t), "file_id")


@query()
def agg_accuracy_total(t):
    return V.accuracy_total(V.accuracy_by_file(_compared(t), "file_id"))


@query()
def agg_accuracy_section(t):
    return V.accuracy_by_section(_compared(t).withColumn("section", F.when(F.col("line_id") % 11 != 0, F.col("section"))))


@query()
def agg_model_gate(t):
    return V.model_gate(_compared(t), "reader", "a", "b")


@query("SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def agg_label_distribution(t):
    return V.label_distribution(t.labels, "toxic")


@query("SELECT lang, string_agg(c, '' ORDER BY c) AS charset FROM (SELECT DISTINCT lang, unnest(string_split(text || source, '')) AS c FROM documents) GROUP BY lang")
def agg_charset(t):
    return V.charset(t.documents, ["text", "source"], ["lang"])


_MODELS = "SELECT p_type AS model, string_agg(DISTINCT c, '' ORDER BY c) AS charset FROM (SELECT p_type, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY p_type"


@query(f"""WITH m AS ({_MODELS}), c AS (SELECT DISTINCT line_id, section, unnest(string_split(text, '')) AS c FROM noisy_lines),
odd AS (SELECT line_id, string_agg(c, '' ORDER BY c) AS odd FROM c LEFT JOIN m ON m.model = c.section WHERE c <> ' ' AND NOT contains(coalesce(charset, ''), c) GROUP BY line_id)
SELECT n.line_id, odd FROM noisy_lines n LEFT JOIN odd ON odd.line_id = n.line_id""")
def agg_charset_mismatch(t):
    charsets = V.charset(t.part.withColumnRenamed("p_type", "model"), ["p_name"], ["model"])
    return V.charset_mismatch(t.noisy_lines.withColumnRenamed("section", "model"), charsets, "model").select("line_id", "odd")


# --- training sets ----------------------------------------------------------------------

_ALLOWED = "abcdefghiklmnoprstuvwxy"
_CORRECTIONS = "SELECT line_id AS id, CASE WHEN line_id % 5 = 0 THEN 'pending' ELSE 'approved' END AS state, reader, text, 'f' || line_id AS file FROM noisy_lines"


@query(f"""SELECT id, CASE WHEN state <> 'approved' THEN 'state' WHEN reader <> 'a' THEN 'reader' WHEN NOT regexp_full_match(text, '[{_ALLOWED} ]*') THEN 'charset' WHEN id % 7 = 0 THEN 'file' END AS reason FROM ({_CORRECTIONS})""")
def ts_select_corrections(t):
    files = t.noisy_lines.filter("line_id % 7 <> 0").select(F.expr("'f' || line_id").alias("file"))
    return V.select_corrections(t.sql(_CORRECTIONS), ["a"], _ALLOWED, files).select("id", "reason")


@query("SELECT line_id, copy, 1000 + row_number() OVER (ORDER BY line_id, copy) AS number FROM noisy_lines, (SELECT 0 AS copy UNION ALL SELECT 1 UNION ALL SELECT 2) c WHERE reader = 'a'")
def ts_oversample(t):
    return V.oversample(t.noisy_lines.filter("reader = 'a'"), "line_id", 1000).select("line_id", "copy", "number")


@query("SELECT 'b/' || line_id || chr(9) || gt AS value FROM noisy_lines UNION ALL SELECT 'c/' || line_id || chr(9) || text FROM noisy_lines WHERE reader = 'a'")
def ts_manifest(t):
    base = t.noisy_lines.select(F.expr("'b/' || line_id").alias("path"), F.col("gt").alias("label"))
    lines = V.manifest(base, t.noisy_lines.filter("reader = 'a'").select(F.expr("'c/' || line_id").alias("path"), F.col("text").alias("label")))
    path = scratch_table(t.spark, "manifest")
    write_ordered(lines, path, [F.split_part("value", F.lit("\t"), F.lit(1)), "value"], "text")
    return read_ordered(t.spark, path).select("value")


@query("""WITH l AS (SELECT gt AS label FROM noisy_lines UNION SELECT p_type || ' ' || p_brand FROM part) SELECT label, copy FROM l LEFT JOIN (SELECT DISTINCT p_name, length(p_name) % 3 AS copies FROM part) b ON b.p_name = l.label,
 (SELECT 0 AS copy UNION ALL SELECT 1 UNION ALL SELECT 2) c WHERE copy <= coalesce(copies, 0)""")
def ts_label_mix(t):
    boosts = t.part.select(F.col("p_name").alias("label"), (F.length("p_name") % 3).alias("copies")).distinct()
    return V.label_mix(t.noisy_lines.select(F.col("gt").alias("label")), t.part.select(F.expr("p_type || ' ' || p_brand").alias("label")), boosts).select("label", "copy")


@query("""WITH e AS (SELECT DISTINCT p_brand AS file, p_name AS entry FROM part) SELECT file, entry, count(*) AS copies, true AS filled FROM e JOIN tags ON tags.name = e.file, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) c
 WHERE k <= tags.id % 3 + 1 GROUP BY file, entry""")
def ts_weighted_dict(t):
    entries = t.part.select(F.col("p_brand").alias("file"), F.concat("p_name", F.lit(" N/N")).alias("entry")).distinct()
    weights = t.tags.select(F.col("name").alias("file"), (F.col("id") % 3 + 1).alias("weight"))
    rows = V.weighted_entries(entries, weights).withColumn("plain", F.regexp_replace("entry", " N/N$", ""))
    ok = F.col("text").rlike(r" ([1-9]\d?)/([1-9]\d?)$") & F.col("text").startswith(F.col("plain"))
    return rows.groupBy("file", F.col("plain").alias("entry")).agg(F.count("*").alias("copies"), F.min(ok).alias("filled"))


@query("SELECT line_id AS id, variant, true AS near, true AS ordered FROM noisy_lines, (SELECT 1 AS variant UNION ALL SELECT 2) v")
def ts_number_variants(t):
    texts = t.noisy_lines.select(F.col("line_id").alias("id"), F.expr("gt || ' ' || line_id || '~' || (line_id + 3) || ' up'").alias("text"))
    rows = V.number_variants(texts, 2).withColumn("n", F.transform(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1), lambda x: x.cast("long")))
    near = (F.abs(F.col("n")[0] - F.col("id")) <= 5) & (F.col("n")[1] <= F.col("id") + 8)
    return rows.select("id", "variant", near.alias("near"), (F.col("n")[0] <= F.col("n")[1]).alias("ordered"))


# --- recommendations --------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in N.STOP_WORDS)
#: Items: a name and category per brand and name, so that tokens are shared.
_ITEMS = "SELECT min(p_partkey) AS id, p_name AS name, p_type AS category, p_brand AS description FROM part GROUP BY p_name, p_type, p_brand"
_TFIDF = f"""items AS ({_ITEMS}), tok AS (SELECT id, unnest(regexp_extract_all(lower(name || ' ' || category || ' ' || description), '\\w\\w+')) AS token FROM items),
tf AS (SELECT id, token, count(*) AS tf FROM tok WHERE token NOT IN ({_STOP}) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT id, token, tf * (ln((1 + (SELECT count(*) FROM items)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)),
v AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""


def _vectors(t):
    return N.tfidf(t.sql(_ITEMS), ["name", "category", "description"])


@query(f"WITH {_TFIDF} SELECT id, token, weight FROM v")
def rec_tfidf(t):
    return _vectors(t)


_TOP = """s AS (SELECT a.id, b.id AS other, round(sum(a.weight * b.weight), 9) AS score FROM v a JOIN v b ON a.token = b.token AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5)"""


def _similar(t):
    # the stated query set: every item whose id is divisible by 50, against all
    items = stored(t.sql(_ITEMS), "items")
    return N.similar_topk(N.tfidf(items, ["name", "category", "description"]), 40, items.filter("id % 50 = 0"), items=items, unit=True)


@query(f"WITH {_TFIDF}, {_TOP} SELECT id, place, score FROM top")
def rec_similar_topk(t):
    return _similar(t).filter("place <= 5").select("id", "place", "score")


# every pair of the query set has a score, 0 without a common token
_HISTORY = """asked AS (SELECT id AS item, row_number() OVER (ORDER BY id) - 1 AS place FROM items WHERE id % 50 = 0),
scored AS (SELECT a.id AS asked, b.id AS other, coalesce(score, 0) AS score FROM items a JOIN items b ON a.id <> b.id LEFT JOIN s ON s.id = a.id AND s.other = b.id WHERE a.id % 50 = 0),
near AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, other) <= 40),
history AS (SELECT DISTINCT user_id, item FROM activity_logs JOIN asked ON place = id % (SELECT count(*) FROM asked) WHERE action = 'purchase'),
found AS (SELECT user_id, other AS item, round(sum(score), 9) AS score FROM history JOIN near ON asked = item GROUP BY 1, 2),
fresh AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS place FROM found WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM history)),
first AS (SELECT id AS item, row_number() OVER (ORDER BY id) AS place FROM items)"""


@query(f"""WITH {_TFIDF}, {_TOP.split(",\ntop")[0]}, {_HISTORY} SELECT user_id, item, place FROM fresh WHERE place <= 3
UNION ALL SELECT id, item, place FROM users, first WHERE place <= 3 AND id NOT IN (SELECT user_id FROM history)""")
def rec_user_history(t):
    # a purchase is of one of the items of the query set, all of which have their turn
    asked = number_rows(t.sql(_ITEMS).filter("id % 50 = 0").select(F.col("id").alias("item")), "item", start=0, name="place")
    n = asked.agg(F.count("*").alias("n"))  # one row
    bought = t.activity_logs.filter("action = 'purchase'").join(F.broadcast(n)).select("user_id", F.expr("pmod(id, n)").alias("place"))
    history = bought.join(asked, "place").select("user_id", "item").distinct()
    users = t.users.select(F.col("id").alias("user_id"))
    return N.from_history(history, _similar(t), t.sql(_ITEMS), users, 3).select("user_id", "item", "place")


# --- streams ----------------------------------------------------------------------------


def _arriving(t, view: str, columns: str):
    """A view as a stream: its rows are written as files, which a file source reads in four batches at most. More of a larger table would each touch most of its users, so the calls would grow faster than it."""
    path = scratch_table(t.spark, view)
    rows = t.sql(f"SELECT {columns} FROM {view}")
    rows.write.parquet(path)
    files = len(t.spark.read.schema(rows.schema).parquet(path).inputFiles())
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(4, -(-files // 4))).parquet(path)


def _sink(t, stream, what, mode="append"):
    out = scratch_table(t.spark, what)
    J.run_to_end(stream, out, scratch_table(t.spark, "progress"), mode)
    return t.spark.read.schema(stream.schema).parquet(out)


_EVENTS = "event_id, ts, user_id, event_type, value, props"


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action, props AS metadata FROM events")
def st_activity_append(t):
    return _sink(t, J.activity_rows(_arriving(t, "events", _EVENTS)), "activity").select("id", "user_id", "action", "metadata")


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def st_activity_counts(t):
    counts = J.action_counts(J.activity_rows(_arriving(t, "events", _EVENTS)))
    out = scratch_table(t.spark, "counts")
    writer = counts.writeStream.outputMode("complete").foreachBatch(J.write_latest(out)).option("checkpointLocation", scratch_table(t.spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(counts.schema).parquet(out)


def _updates(t, updates, what):
    """All updates of a stream, with the number of their batch."""
    out = scratch_table(t.spark, what)
    writer = updates.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    writer.option("checkpointLocation", scratch_table(t.spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.option("basePath", out).schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in updates.schema)}, batch int").parquet(out)


@query("SELECT user_id, arg_max(code, (issued_at, code)) AS code, max(issued_at) AS issued_at FROM code_requests GROUP BY user_id")
def st_issue_codes(t):
    updates = J.stream_codes(_arriving(t, "code_requests", "user_id, code, issued_at"))
    return J.live_codes(_updates(t, updates, "codes")).select("user_id", "code", "issued_at")


@query("SELECT user_id, max(issued_at) AS issued_at FROM code_requests GROUP BY user_id HAVING max(issued_at) + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-28 12:00:00'")
def st_expire_codes(t):
    return J.unexpired(J.live_codes(t.code_requests), F.lit("2024-01-28 12:00:00").cast("timestamp_ntz")).select("user_id", "issued_at")


_OPEN_USERS = "SELECT id AS user_id, server, game_id FROM users WHERE NOT verified AND game_id IS NOT NULL AND server IS NOT NULL"


@query(f"""WITH u AS ({_OPEN_USERS}), c AS (SELECT r.user_id, server, game_id, code, issued_at, least(issued_at + INTERVAL 7 DAY, lead(issued_at) OVER (PARTITION BY r.user_id ORDER BY issued_at, code)) AS ends_at FROM code_requests r JOIN u ON u.user_id = r.user_id)
SELECT c.user_id, min(sent_at) AS verified_at FROM c JOIN users s ON s.server = c.server AND s.game_id = c.game_id JOIN chat_messages m ON m.user_id = s.id
WHERE contains(message, code) AND sent_at >= issued_at AND sent_at < ends_at GROUP BY c.user_id""")
def st_verify_codes(t):
    requests = J.eligible(_arriving(t, "code_requests", "user_id, code, issued_at"), t.users)
    # a message names a game id and a server; the open users' table says whose they are
    senders = t.sql("SELECT id, server, game_id FROM users").withColumnRenamed("id", "sender")
    said = _arriving(t, "chat_messages", "user_id, sent_at, message").withColumnRenamed("user_id", "sender").join(senders, "sender").drop("sender")
    hits = J.stream_verified(said.join(t.sql(_OPEN_USERS), ["server", "game_id"]), requests, "7 days", "60 days")
    last = F.coalesce(F.min(F.when(F.col("final"), F.col("verified_at"))), F.max_by("verified_at", F.when(~F.col("final"), F.col("batch"))))
    return _updates(t, hits, "verified").groupBy("user_id").agg(last.alias("verified_at")).filter("verified_at is not null")


@query("SELECT id AS target_id, CASE WHEN price >= 200000 THEN 'dear' ELSE 'cheap' END AS tag FROM listings WHERE price IS NOT NULL")
def st_autotag_on_arrival(t):
    from bazaarlake.operators.rules import run_rules

    def rule(n, op, tag):
        return {"id": n, "config": {"tag_template": tag, "conditions": [{"table": "listing", "column": "price", "op": op, "value": 200000}]}}

    def tagger(batch):
        rows = run_rules(batch.withColumn("listing", F.struct("id", "price")), [rule(1, ">=", "dear"), rule(2, "<", "cheap")], {"listing": F.col("listing")}, {})
        return rows.select(F.col("id").alias("target_id"), F.explode("tags").alias("tag"))

    out = scratch_table(t.spark, "tags")
    stream = _arriving(t, "listings", "id, price").writeStream.foreachBatch(J.tag_batches(out, tagger)).option("checkpointLocation", scratch_table(t.spark, "progress"))
    stream.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("target_id long, tag string").parquet(f"{out}/batch=*").distinct()


