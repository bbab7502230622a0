"""Merkle manifest of a dataset: checkpoint every few levels, recompute the levels between.

How it works
------------
1. Each row becomes a leaf. Leaves are numbered in their tree (one per source) by range partitions over (tree, id),
   so a source that holds a third of all rows is dealt out; only digests and ids are moved, never the texts.
2. Levels are built `stride` at a time: the fanout ** stride nodes of an aligned subtree make one group, whose
   interior nodes exist inside one expression only. The group's root is stored, and what it was made of, nothing between.
   The roots of the trees are the leaves of one more tree.
3. Proofs come from the top down. Each stored node passes its path to the root on to the aligned subtree under it;
   there the missing interior nodes are made again from the stored descendants, their digests are emitted as siblings, and
   the nodes are dropped. A path is an array of (before, after): the digests on either side, as joined text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlake.llm.common import cut

FANOUT, STRIDE = 16, 2
_PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """`-` for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _number(rows: DataFrame) -> DataFrame:
    """(tree, id, node, ...) -> with pos (from 0, by id, nulls first, then by digest) in the tree, and n, the tree's size."""
    rows = cut(rows.withColumn("no", F.monotonically_increasing_id()), "leaves")
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("node"), F.col("no")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("no").withColumn("at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("part", F.shiftright("at", 33)), "dealt")
    runs = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))  # a row per partition and tree
    before = Window.partitionBy("tree").orderBy("part")
    runs = runs.select("tree", "part", (F.sum("c").over(before) - F.col("c") - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    return cut(dealt.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"), "numbered")


class _Forest:
    """Trees whose leaves are numbered, with every `stride`-th level stored."""

    def __init__(self, leaves: DataFrame, fanout: int, stride: int):
        self.fanout, self.stride, self.size = fanout, stride, fanout**stride
        self.levels = [leaves]
        n = leaves.agg(F.max("n")).first()[0] or 0
        while n > 1:
            self.levels.append(cut(self._up(self.levels[-1]), "level"))
            n = -(-n // self.size)

    def _groups(self, nodes: DataFrame, *carried: str) -> DataFrame:
        """Aligned subtrees: tree, n, group, and the members in order."""
        members = F.sort_array(F.collect_list(F.struct("pos", "node", *carried)))
        return nodes.filter("n > 1").groupBy("tree", "n", F.expr(f"pos div {self.size}").alias("group")).agg(members.alias("members"))

    def _interior(self, groups: DataFrame) -> DataFrame:
        """Adds level0 .. : the digests of the group by level, from its members to its root's children (null where the tree ends below)."""
        out = groups.withColumn("level0", F.transform("members", lambda m: m["node"]))
        for i in range(1, self.stride):
            runs = f"transform(sequence(0, (size(level{i - 1}) - 1) div {self.fanout}), i -> sha2(array_join(slice(level{i - 1}, i * {self.fanout} + 1, {self.fanout}), ''), 256))"
            out = out.withColumn(f"level{i}", F.expr(f"if(n > {self.fanout**i}, {runs}, null)"))
        return out

    def _up(self, nodes: DataFrame) -> DataFrame:
        """The next stored level."""
        top = F.coalesce(*(F.col(f"level{i}") for i in reversed(range(self.stride))))
        made = self._interior(self._groups(nodes)).select("tree", F.expr(f"(n - 1) div {self.size} + 1").alias("n"), F.col("group").alias("pos"), F.sha2(F.array_join(top, ""), 256).alias("node"))
        return made

    def roots(self) -> DataFrame:
        """tree, node."""
        out = self.levels[0].filter("n = 1").select("tree", "node")
        for nodes in self.levels[1:]:
            out = out.unionByName(nodes.filter("n = 1").select("tree", "node"))
        return out

    def paths(self, above: DataFrame, carried: list[str], passed: list[str]) -> DataFrame:
        """above: tree, path, and `passed` columns of each root -> tree, node, path, `carried` columns of the leaves, `passed` columns."""
        paths = None
        for level in reversed(range(len(self.levels))):
            nodes, own = self.levels[level], carried if level == 0 else []
            found = nodes.filter("n = 1").join(above, "tree").select("tree", "pos", "node", *own, "path", *passed)
            if paths is not None:
                found = found.unionByName(self._down(nodes, paths, own, passed))
            paths = found if level == 0 else cut(found, "paths")
        return paths.select("tree", "node", "path", *carried, *passed)

    def _down(self, nodes: DataFrame, paths: DataFrame, own: list[str], passed: list[str]) -> DataFrame:
        """Each member of an aligned subtree with the path of the subtree's root, and its own before it."""
        of = paths.select("tree", F.col("pos").alias("group"), "path", *passed)
        groups = self._interior(self._groups(nodes, *own)).join(of, ["tree", "group"])
        f, steps = self.fanout, []
        for i in range(self.stride):
            at = f"(m.pos % {self.size}) div {f**i}"  # place in the level, from 0
            before = f"array_join(slice(level{i}, cast({at} - {at} % {f} + 1 as int), cast({at} % {f} as int)), '')"
            after = f"array_join(slice(level{i}, cast({at} + 2 as int), cast({f - 1} - {at} % {f} as int)), '')"
            steps.append(f"if(level{i} is null, null, named_struct('before', {before}, 'after', {after}))")
        columns = ", ".join(f"'{c}', m.{c}" for c in ["pos", "node", *own])
        each = f"transform(members, m -> named_struct({columns}, 'path', concat(filter(array({', '.join(steps)}), x -> x is not null), path)))"
        return groups.select("tree", F.expr(f"inline({each})"), *passed).select("tree", "pos", "node", *own, "path", *passed)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", tree_col: str = "source", fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """Leaf, proof and roots of each row.

    Returns one row per row of `docs`: the id, leaf, subroot, root, and path: from the leaf to the root, the joined digests
    before and after the row's own node on each level. To check a row later, `fold` the `leaf_of` its present values along its path.
    Defined cases: nulls are told apart from empty values; a null id comes first in its tree, a null tree is a tree of its own and comes
    first; rows with one id are ordered by leaf, equal rows each have a leaf; a tree of one row is its own subroot, a manifest of one
    tree has the root of that tree; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    return _manifest(docs, {}, columns, id_col, tree_col, fanout, stride).select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path")


def leaf_of(columns: list[Column]) -> Column:
    """The leaf of a row with these values."""
    return digest(*map(field, columns))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def _manifest(docs: DataFrame, carried: dict[str, Column], columns, id_col: str, tree_col: str, fanout: int, stride: int) -> DataFrame:
    """tree, id, node, subroot, root, path and the carried columns of each row."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))  # null first, then bytewise
    rows = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_of([F.col(c) for c in columns]).alias("node"), *(c.alias(name) for name, c in carried.items()))
    trees = _Forest(_number(rows), fanout, stride)
    top = _Forest(_number(trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("id"), "node")), fanout, stride)
    no_path = top.roots().select("tree", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("node").alias("root"))
    above = top.paths(no_path, ["id"], ["root"]).select(F.col("id").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    return trees.paths(above, ["id", *carried], ["subroot", "root"])


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of([lowered if c == "text" else F.col(c) for c in columns]))
    found = _manifest(docs, {"tampered": tampered}, columns, "doc_id", "source", FANOUT, STRIDE)
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "node"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    return found.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _op11_sql(levels: int = 4, top: int = 3) -> str:
    """Levels one after the other: runs of 16, then every document's place in them."""
    put = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join(put(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, y: xor(x >> 8, list_reduce([(xor(x, y) & 255)::BIGINT] || range(8)::BIGINT[], lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END))), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS tampered FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d)",
        "t0 AS (SELECT tree, i, n, leaf AS h FROM s0)",
    ]

    def rise(name: str, k: int) -> str:
        return f"SELECT tree, i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, max(n) AS below, list(h ORDER BY i) AS hs FROM {name}{k - 1} GROUP BY tree, i // 16"

    ctes += [f"t{k} AS ({rise('t', k)})" for k in range(1, levels + 1)]
    ctes.append(f"u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h, tree AS of FROM t{levels})")
    ctes += [f"u{k} AS ({rise('u', k)})" for k in range(1, top + 1)]
    ctes.append(f"f0 AS (SELECT s0.doc_id, s0.leaf, s0.tree, s0.i, u0.i AS j, u0.h AS subroot, coalesce(tampered, leaf) AS f, '' AS proof, (SELECT h FROM u{top}) AS root FROM s0 JOIN u0 ON u0.of = s0.tree)")
    for k in range(1, levels + top + 1):
        x, at, name = (k, "i", "t") if k <= levels else (k - levels, "j", "u")
        place = f"({at} // {16 ** (x - 1)} % 16)"
        before, after = f"array_to_string(g.hs[1:{place}], '')", f"array_to_string(g.hs[{place} + 2:], '')"
        on = f"g.i = {at} // {16**x}" + (" AND g.tree = p.tree" if name == "t" else "")
        columns = f"p.* EXCLUDE (f, proof), CASE WHEN g.below > 1 THEN sha256({before} || f || {after}) ELSE f END AS f, CASE WHEN g.below > 1 THEN proof || {before} || {after} ELSE proof END AS proof"
        columns = columns.replace(place, place.replace(at + " ", f"p.{at} "))
        ctes.append(f"f{k} AS (SELECT {columns} FROM f{k - 1} p JOIN {name}{x} g ON {on.replace(f'= {at} ', f'= p.{at} ')})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{levels + top}"


OP11_SQL = _op11_sql()
