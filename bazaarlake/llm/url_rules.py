"""URL filters as a sort-merge range join, in DataFrame functions only.

A host's labels, reversed and each ended by a separator that sorts below every label byte,
form its key: a rule's host and all its subdomains are exactly the keys that begin with the
rule's key, one interval. The intervals of hosts with rules are nested or disjoint, so a sweep over
keys in order needs a stack of active hosts. The stack at the start of each interval depends on
the rules alone and is computed once; in the sorted sweep (a window that carries the last
interval start forward) every url finds the stack at its place and drops what has ended. A second
sweep of the same kind goes over (host of the rules, path): a rule's path is the interval of all paths that
begin with it, and a stack holds the nested rules of one host alone. So a row carries as
many hosts as its own has labels, and as many rules as are nested at one path, however many a host has.

The sweeps run in blocks. Starts of intervals that a hash picks (about one in `_RANGE`) cut the keys into
ranges, which urls and starts share; every url of a range has a start of its range before it, so nothing is
carried over an edge. The urls of a range are dealt evenly to as many blocks as their share of all urls asks
for, so a host with a third of all rows is no hot key, and a block gets the starts of its own range
only: in all, starts + blocks x a range's starts are copied. Up to about `_RANGE` rules are one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends each label in a key, and follows everything that begins with a key.
_SEP, _AFTER = "\x01", "\x02"

#: Starts of a range, on average.
_RANGE = 1000

#: The rules of the production query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _SEP), F.lit(_SEP))


def _host_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key, and the keys of all rule hosts whose interval holds it.

    A host's enclosing intervals are those of its own suffixes, so the hosts meet themselves by an
    equi-join on suffix keys (as many as a host has labels), not by comparing all with all.
    """
    own = rules.select("key").distinct()
    part = lambda i: F.concat(F.array_join(F.slice("parts", F.lit(1), i), _SEP), F.lit(_SEP))
    suffixes = own.withColumn("parts", F.split("key", _SEP)).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), part)).alias("outer"))
    return suffixes.join(own.withColumnRenamed("key", "outer"), "outer").groupBy("key").agg(F.sort_array(F.collect_set("outer")).alias("stack"))


def _path_stacks(rules: DataFrame) -> DataFrame:
    """One row per (host key, path) of the rules: the host's rules whose path it begins with (an equi-join on its beginnings)."""
    own = rules.select(F.col("key").alias("outer"), "path").distinct()
    beginnings = own.select("outer", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))).alias("beginning"))
    inner = rules.select(F.col("key").alias("outer"), F.col("path").alias("beginning"), F.struct("key", "host", "path", "verdict").alias("rule"))
    return beginnings.join(inner, ["outer", "beginning"]).groupBy("outer", "path").agg(F.sort_array(F.collect_set("rule")).alias("stack"))


def _blocks(urls: DataFrame, starts: DataFrame, cuts: DataFrame | None, n_blocks: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """Urls with their block, and starts copied to the blocks of their range. cuts: one row with `cuts`, the sorted starts at which ranges begin; None for one range."""
    if cuts is None:
        return urls.withColumn("block", F.pmod("deal", F.lit(n_blocks)).cast("string")), starts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("block", F.col("block").cast("string"))
    ranged = lambda df: df.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.struct(*order)))).drop("cuts")
    urls, starts = ranged(urls), ranged(starts)
    sizes = urls.groupBy("range").agg(F.count("*").alias("n"))  # a row per range, and one of all urls
    shares = sizes.join(F.broadcast(sizes.agg(F.sum("n").alias("total")))).select("range", (F.floor(n_blocks * F.col("n") / F.col("total")) + 1).cast("int").alias("share"))
    block = F.concat_ws("-", "range", "salt")
    dealt = urls.join(shares, "range").withColumn("salt", F.pmod("deal", "share")).withColumn("block", block).drop("range", "salt", "share")
    copied = starts.join(shares, "range").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("share") - 1))).withColumn("block", block).drop("range", "salt", "share")
    return dealt, copied


def _sweep(urls: DataFrame, starts: DataFrame, cuts: DataFrame | None, n_blocks: int, *order: str) -> DataFrame:
    """Adds `active` to the urls: the stack of the last start before each, in their block."""
    dealt, copied = _blocks(urls, starts, cuts, n_blocks, *order)
    events = dealt.withColumn("is_url", F.lit(1)).unionByName(copied.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    window = Window.partitionBy("block").orderBy(*order, "is_url").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("active", F.last("stack", ignorenulls=True).over(window)).filter("is_url = 1").drop("stack", "is_url")


def _cuts(rules: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The starts at which ranges begin, of hosts and of hosts and paths; None if there are none."""
    picked = lambda *c: F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64(*c), F.lit(_RANGE)) == 0, F.struct(*c))))
    both = rules.agg(picked("key").alias("hosts"), picked(F.col("key").alias("outer"), "path").alias("paths"))  # one start in _RANGE
    some = rules.agg(*[F.max(F.pmod(F.xxhash64(*c), F.lit(_RANGE)) == 0) for c in (("key",), ("key", "path"))]).first()
    return tuple(both.select(F.col(c).alias("cuts")) if there else None for c, there in zip(("hosts", "paths"), some, strict=True))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The longest rule that fits each url. rules: host, path, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's. Longest:
    most characters of host and path together; then the longer host, then the smaller text, then
    block before allow. Returns one row per row of `pages`: the id, host, path, rule (host and
    path; null if none fits) and verdict (the rule's, else `default`). Defined cases: null urls and
    those without :// have empty host and path and fit no rule; urls of any length are used whole;
    rules with a null or empty host are ignored, a null path counts as empty; repeated pages are
    judged each, repeated rules count once; empty tables work; other columns are ignored.
    """
    n_blocks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''").withColumn("key", host_key(F.col("host")))
    host_cuts, path_cuts = _cuts(rules)
    rules = rules.distinct()
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("deal", F.xxhash64("id", "host", "path"))
    urls = urls.withColumns({"key": host_key(F.col("host")), "row": F.monotonically_increasing_id()})
    hosts = _sweep(urls, _host_stacks(rules), host_cuts, n_blocks, "key").drop("block")
    hosts = hosts.withColumn("outer", F.explode_outer(F.filter("active", lambda k: F.col("key").startswith(k)))).drop("active")
    swept = _sweep(hosts, _path_stacks(rules), path_cuts, n_blocks, "outer", "path")
    fits = F.filter("active", lambda r: (r["key"] == F.col("outer")) & F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((-(F.length(r["host"]) + F.length(r["path"]))).alias("a"), (-F.length(r["host"])).alias("b"), F.concat(r["host"], r["path"]).alias("rule"), F.when(r["verdict"] == "block", 0).otherwise(1).alias("c"), r["verdict"].alias("verdict")))
    best = swept.withColumn("best", F.array_min(ranked)).groupBy(*(["block"] if path_cuts is None else []), "row").agg(*[F.first(c).alias(c) for c in ("id", "host", "path")], F.min("best").alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP6_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p)
SELECT page_id, q.host, q.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM q LEFT JOIN r ON (q.host = r.host OR q.host LIKE '%.' || r.host) AND starts_with(q.path, r.path)
GROUP BY page_id, q.host, q.path
"""
