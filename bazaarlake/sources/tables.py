"""Tables: reading with a fixed schema, and marketplace views over the given tables.

The views are plain SQL that Spark and DuckDB both accept, so an oracle can use them as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bazaarlake.sources.scratch import scratch_table

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


#: Schemas of the given tables; nothing is inferred from data.
SCHEMAS = {
    "region": _struct(r_regionkey=_I, r_name=_S),
    "nation": _struct(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _struct(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": _struct(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": _struct(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _struct(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_TS, o_orderpriority=_S),
    "lineitem": _struct(
        l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_TS
    ),
    "events": _struct(event_id=_L, ts=_TS, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _struct(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "pages": _struct(page_id=_L, url=_S, html=_S),
    "benchmark": _struct(item_id=_L, text=_S),
    "labels": _struct(doc_id=_L, quality=_I, toxic=_I),
    "conversations": _struct(conv_id=_L, turn=_L, role=_S, text=_S),
}

VIEWS = {
    "users": "SELECT c_custkey AS id, c_name AS game_id, c_nationkey AS server, c_acctbal > 0 AS verified FROM customer",
    "game_items": "SELECT p_partkey AS id, p_name AS name, p_type AS type, p_size >= 25 AS searchable FROM part",
    "enchants": "SELECT s_suppkey AS id, s_suppkey % 2 AS slot, s_name AS name, s_nationkey % 15 + 1 AS rank FROM supplier",
    "option_rows": """SELECT l_orderkey AS listing_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
 l_partkey, l_suppkey, l_quantity FROM lineitem""",
    "listings": """SELECT o.o_orderkey AS id, o.o_custkey AS user_id,
 CASE o.o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS status,
 o.o_orderpriority || ' ' || p.p_name AS name, CAST(floor(o.o_totalprice) AS BIGINT) AS price,
 a.l_partkey AS game_item_id, CASE WHEN a.l_suppkey % 2 = 0 THEN a.l_suppkey END AS prefix_enchant_id,
 CASE WHEN b.l_suppkey % 2 = 1 THEN b.l_suppkey END AS suffix_enchant_id,
 CAST(a.l_quantity AS INT) AS damage, CAST(b.l_quantity AS INT) AS defense, o.o_orderdate AS created_at
 FROM orders o LEFT JOIN option_rows a ON a.listing_id = o.o_orderkey AND a.pos = 1
 LEFT JOIN option_rows b ON b.listing_id = o.o_orderkey AND b.pos = 2
 LEFT JOIN part p ON p.p_partkey = a.l_partkey""",
    "listing_options": """SELECT listing_id * 1000 + pos AS id, listing_id,
 CASE pos % 3 WHEN 0 THEN 'reforge_options' WHEN 1 THEN 'echostone_options' ELSE 'enchant_effects' END AS option_type,
 l_partkey AS option_id, p_name AS option_name, l_quantity AS rolled_value, 50 AS max_level
 FROM option_rows JOIN part ON p_partkey = l_partkey""",
    "tags": "SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS id, p_brand AS name, CAST(substr(p_brand, 7) AS INT) % 5 * 40 AS weight FROM part",
    "tag_targets": """SELECT CAST(substr(p_brand, 7) AS INT) AS tag_id, 'game_items' AS target_type, p_partkey AS target_id, p_size AS weight FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT CAST(o_orderkey % 25 + 1 AS INT), 'listings', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 80 WHEN 1 THEN 60 ELSE 30 END FROM orders WHERE o_orderkey % 7 = 0
 UNION ALL SELECT CAST(s_suppkey % 25 + 1 AS INT), 'enchants', s_suppkey, 0 FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT CAST(substr(p_brand, 7) AS INT), 'reforge_options', p_partkey, 0 FROM part WHERE p_partkey % 9 = 0""",
    "enchant_effects": """SELECT CAST(s_suppkey * 10 + n AS BIGINT) AS id, s_suppkey AS enchant_id, n AS effect_order, CASE WHEN n < 3 THEN CAST(n AS BIGINT) * 7 + s_nationkey END AS effect_id,
 CAST(n * 2 AS DOUBLE) AS min_value, CAST(n * 2 + s_suppkey % 3 AS DOUBLE) AS max_value FROM supplier JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k ON n <= s_suppkey % 4""",
    "effects": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "rolls": """SELECT o.id, o.listing_id, l.prefix_enchant_id AS enchant_id, CAST(o.option_id % 3 + 1 AS INT) AS effect_order, o.rolled_value FROM listing_options o
 JOIN listings l ON l.id = o.listing_id WHERE o.option_type = 'enchant_effects' AND l.prefix_enchant_id IS NOT NULL""",
    "activity_logs": "SELECT event_id AS id, user_id, event_type AS action, props AS metadata, ts AS created_at FROM events",
    "hierarchy": "SELECT r_name AS parent, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "noisy_lines": """SELECT p_partkey AS line_id, p_partkey % 50 AS file_id, p_type AS section, p_name AS gt,
 CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'e', 'o') WHEN 2 THEN '- ' || p_name || ' ' || p_size ELSE substr(p_name, 2) END AS text,
 p_retailprice / 2000 AS confidence, p_size % 10 = 0 AS skipped, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS reader FROM part""",
    "dict_names": "SELECT DISTINCT p_name AS name FROM part",
    "snapshot_before": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 10 <> 0",
    "snapshot_after": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 10 <> 1",
    "code_requests": "SELECT user_id, ts AS issued_at, CAST(event_id % 5 AS VARCHAR(4)) AS code FROM events WHERE event_type = 'signup'",
    "chat_messages": "SELECT event_id AS msg_id, user_id, ts AS sent_at, 'v-' || CAST(event_id % 5 AS VARCHAR(4)) AS message FROM events WHERE event_type = 'view'",
    "layout_lines": "SELECT listing_id AS session_id, pos, CAST(l_quantity AS INT) % 12 + pos * 20 AS y, 14 AS height, CASE WHEN l_suppkey % 9 = 0 THEN 'header' WHEN l_suppkey % 3 = 0 THEN 'bullet' WHEN l_suppkey % 7 = 0 THEN 'grey' ELSE 'plain' END AS kind, 'p' || l_partkey AS text FROM option_rows",
    "user_roles": "SELECT c_custkey AS user_id, c_nationkey % 5 AS role_id FROM customer UNION SELECT c_custkey, c_custkey % 5 FROM customer",
    "role_features": "SELECT n_regionkey AS role_id, n_name AS feature FROM nation",
    "restriction_map": "SELECT c_mktsegment AS restriction, n_name AS node FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment, n_name",
}

_ALL = {**VIEWS, **SCHEMAS, "embeddings": None}


def mentioned(sql: str, views: dict[str, str] = VIEWS) -> list[str]:
    """Views and tables whose names stand in the SQL, those that others need first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in _ALL:
            if name not in out and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                if name in views:
                    visit(views[name])
                out.append(name)

    visit(sql)
    return out


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """The SQL with the views that it uses as CTEs."""
    ctes = ", ".join(f"{name} AS ({views[name]})" for name in mentioned(sql, views) if name in views)
    if not ctes:
        return sql
    text = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(start):
            return f"{start}{ctes}, {text[len(start) :]}"
    return f"WITH {ctes} {text}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with its schema (embeddings: as stored)."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the stored tables for which a shuffle has a partition to begin with, and what Spark joins small ones up to, unless the session says so.
PARTITION_BYTES, JOINED = 4_000_000, "16m"


def fit_partitions(spark: SparkSession, sf_dir: str) -> None:
    """Shuffles begin with partitions in proportion to the folder's bytes, of which Spark joins small ones: so what a task sorts or gathers stays about the same, however large the tables. Holds for the session until the next folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-size // PARTITION_BYTES))))
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED)


class Tables:
    """Tables and views of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str, views: dict[str, str] = VIEWS):
        self.spark, self.sf_dir, self.views = spark, sf_dir, views
        fit_partitions(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in _ALL:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over tables and views. The tables' temporary views are resolved at once, so later folders don't disturb it."""
        for name in mentioned(text, self.views):
            if name not in VIEWS:
                read_table(self.spark, self.sf_dir, name).createOrReplaceTempView(name)
        return self.spark.sql(with_views(text, self.views))

    def stored(self, *names: str) -> Tables:
        """The same tables with these views as scratch tables, one after the other: a view that several parts of a query use is computed once, and views over it read it."""
        out = self
        for name in names:
            path = scratch_table(self.spark, name)
            getattr(out, name).write.parquet(path)
            out = Tables(self.spark, self.sf_dir, {**out.views, name: f"SELECT * FROM parquet.`{path}`"})
        return out
