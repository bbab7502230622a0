"""Exact top-k inner products by a dual-tree search over cover trees.

How it works
------------
1. Vectors are assigned to their nearest pivot (a sample of at most PIVOTS vectors; it decides where a vector lies, not
   whether it is found). Sorted by cell, distance and id over range partitions, they are cut into chunks of at most CHUNK rows, so
   a vector that a third of all rows repeat is dealt out. Each chunk becomes a cover tree; so do the queries, in groups.
2. A cover tree: points in farthest-first order; the net of level i (points over 2**i apart that cover all others within 2**i) is
   a prefix of that order, and the parent of a point is its nearest one in the net of its level. Each node has a covering
   radius: the distance to its farthest descendant. Equal vectors are one point.
3. A query node (centre a, radius s) and a data node (centre c, radius r) can't score above a c + |a| r + |c| s + r s. A pair whose
   bound is below the worst k-th score of the group's queries goes: cells first, then chunks, then nodes of both trees.
4. A group starts with its best chunk; rounds over its best cells (1, 8, 64, ... of them) follow, each with the k-th scores so far.
   Chunks stay where they are, groups travel to them; a chunk that many groups need is copied.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlake.llm.common import cut, small_batches

#: Pivots at most; rows of a chunk, and of a group of queries; groups that meet one copy of a chunk, about.
PIVOTS, CHUNK, GROUP, AROUND = 1024, 2048, 256, 64
#: Cells of a round, by rank.
ROUNDS = (0, 1, 9, 73, 585, PIVOTS)
_EXACT = 2.0**53


# --- one tree -----------------------------------------------------------------------------


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between all rows of x and y."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    return np.sqrt(np.maximum(d, 0))


class Tree:
    """A cover tree over distinct vectors: points in farthest-first order, `starts[i]` points in the net of level i, coarsest first."""

    def __init__(self, x: np.ndarray):
        n, norm = len(x), (x * x).sum(1)
        order, gap, near = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        order[0] = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
        for i in range(1, n):
            last = order[i - 1]
            near = np.minimum(near, norm - 2 * (x @ x[last]) + norm[last])
            near[last] = -1
            order[i] = int(np.argmax(near))
            gap[i] = near[order[i]]
        self.order, self.x = order, x[order]
        level = np.ceil(0.5 * np.log2(np.maximum(gap[1:], 1e-9))).astype(np.int64)  # gaps fall, so a level is a run of points
        self.starts = [*(1 + np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])[: n - 1])).tolist(), n] if n > 1 else [1]
        self.parent = np.zeros(n, np.int64)
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            self.parent[a:b] = np.argmin(_distance(self.x[a:b], self.x[:a]), axis=1)
        self.radius = []
        for a in self.starts:
            r = np.zeros(a)
            np.maximum.at(r, self.above(a), np.sqrt(((self.x - self.x[self.above(a)]) ** 2).sum(1)))
            self.radius.append(r * (1 + 1e-9))
        self.norm = np.sqrt((self.x * self.x).sum(1)) * (1 + 1e-9)

    def above(self, start: int) -> np.ndarray:
        """Each point's ancestor in the net that the first `start` points make."""
        out = np.arange(len(self.x))
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            if a >= start:
                out[a:b] = out[self.parent[a:b]]
        return out


def dual(query: Tree, data: Tree, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of both trees that are left when no pair of nodes can be pruned; worst: the score that each query point has to reach."""
    a = b = 0
    rows, cols, alive = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones((1, 1), bool)
    while True:
        needed = np.full(query.starts[a], np.inf)
        np.minimum.at(needed, query.above(query.starts[a]), worst)
        r, s = data.radius[b][cols], query.radius[a][rows]
        centre = query.x[rows] @ data.x[cols].T
        bound = centre + query.norm[rows][:, None] * r + s[:, None] * (data.norm[cols] + r)
        bound += 1e-9 * (np.abs(bound) + query.norm[rows][:, None] * data.norm[cols]) + 1e-6
        alive &= bound >= needed[rows][:, None]
        i, j = alive.any(1), alive.any(0)
        rows, cols, alive = rows[i], cols[j], alive[np.ix_(i, j)]
        ends = a + 1 == len(query.starts), b + 1 == len(data.starts)
        if not alive.size or all(ends):
            return rows, cols
        if ends[0] or not ends[1] and r.max() >= s.max():
            cols, alive = _open(data, b, cols, alive.T)
            alive, b = alive.T, b + 1
        else:
            rows, alive = _open(query, a, rows, alive)
            a += 1


def _open(tree: Tree, level: int, nodes: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of these nodes (each is its own first child); alive: a row for each node."""
    place = np.full(tree.starts[level], -1)
    place[nodes] = np.arange(len(nodes))
    below = np.arange(tree.starts[level], tree.starts[level + 1])
    from_ = place[tree.parent[below]]
    return np.concatenate([nodes, below[from_ >= 0]]), np.concatenate([alive, alive[from_[from_ >= 0]]])


def _scores(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers; most: a bound of their sizes. Python's integers where doubles can't hold them."""
    if most < _EXACT:
        return (q @ x.T).astype(np.int64)
    return (q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T).astype(np.int64)  # OverflowError beyond 64 bits


class Bundle:
    """The rows of a chunk or of a group: a tree over the distinct vectors, and the ids of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keep: int | None):
        distinct, code = np.unique(x, axis=0, return_inverse=True)
        self.tree = Tree(distinct.astype(np.float64))
        self.tree.x = self.tree.x.astype(np.int64 if np.abs(distinct).max(initial=0) > 30_000 else np.int16)
        of = np.argsort(self.tree.order)[code.ravel()]
        order = np.lexsort((ids, of))
        of, ids = of[order], ids[order]
        first = np.concatenate([[True], (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])])[: len(of)]
        of, ids = of[first], ids[first]
        if keep is not None:  # the smallest ids of a vector win every tie
            place = np.arange(len(of)) - np.searchsorted(of, of)
            of, ids = of[place < keep], ids[place < keep]
        self.of, self.ids = of, ids

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__ | {"tree": self.tree.__dict__}, protocol=5)

    @staticmethod
    def load(blob: bytes) -> Bundle:
        out, tree = Bundle.__new__(Bundle), Tree.__new__(Tree)
        out.__dict__.update(pickle.loads(blob))
        tree.__dict__.update(out.tree)
        tree.x = tree.x.astype(np.float64)
        out.tree = tree
        return out


def _search(group: Bundle, chunk: Bundle, score: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, id, score of what a chunk adds; score, least: each query's k-th score so far and that one's id."""
    worst = np.full(len(group.tree.x), np.inf)
    np.minimum.at(worst, group.of, score)
    rows, cols = dual(group.tree, chunk.tree, worst)
    if not len(rows) or not len(cols):
        return (np.zeros(0, np.int64),) * 3
    most = float(group.tree.norm[rows].max() * chunk.tree.norm[cols].max()) * 1.01
    s = _scores(group.tree.x[rows], chunk.tree.x[cols], most)
    place = np.full(len(group.tree.x), -1)
    place[rows] = np.arange(len(rows))
    mine = np.flatnonzero(place[group.of] >= 0)  # the queries, not their distinct vectors
    s = s[place[group.of[mine]]]
    floor = score[mine]
    if s.shape[1] > k + 1 and len(np.unique(chunk.ids)) == len(chunk.ids):
        floor = np.maximum(floor, np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1])
    i, j = np.nonzero(s >= floor[:, None])
    lo, hi = np.searchsorted(chunk.of, cols[j]), np.searchsorted(chunk.of, cols[j], side="right")
    each = np.repeat(np.arange(len(i)), hi - lo)
    ids = chunk.ids[np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(len(each))] if len(each) else np.zeros(0, np.int64)
    q, v = mine[i[each]], s[i[each], j[each]]
    better = (ids != group.ids[q]) & ((v > score[q]) | (ids < least[q]))
    q, v, ids = q[better], v[better], ids[better]
    order = np.lexsort((-v, ids, q))  # once for each id, then the k best
    q, v, ids = q[order], v[order], ids[order]
    first = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])[: len(q)]
    q, v, ids = q[first], v[first], ids[first]
    order = np.lexsort((ids, -v, q))
    q, v, ids = q[order], v[order], ids[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return group.ids[q[best]], ids[best], v[best]


# --- the tables ---------------------------------------------------------------------------


def _whole(dims: int, scale: int):
    """(id, vector) -> id and floor(scale * x) as whole numbers of 4 or 8 bytes; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.floor(scale * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
            end = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size]))
            if np.abs(x, where=np.isfinite(x), out=np.zeros(len(x))).max(initial=0) >= _EXACT:
                raise ValueError("components times the scale must be below 2**53")
            out = np.zeros((len(good), dims), np.int64)
            for row, i in enumerate(good.tolist()):
                out[row, : size[i]] = x[end[i] - size[i] : end[i]]
            kind = "<i4" if np.abs(out).max(initial=0) < 1 << 31 else "<i8"
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array([v.tobytes() for v in out.astype(kind)], pa.binary())], ["id", "v"])

    return run


def _matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    if not dims:
        return np.zeros((len(blobs), 1), np.int64)
    return np.stack([np.frombuffer(b, "<i4" if len(b) == 4 * dims else "<i8").astype(np.int64) for b in blobs]) if blobs else np.zeros((0, dims), np.int64)


def _assign(pivots: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distance(_matrix(batch.column(1).to_pylist(), dims).astype(np.float64), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), batch.column(0), batch.column(1)], ["cell", "d", "id", "v"])

    return run


_BUNDLES = "bundle long, cell int, reach double, centre binary, norm double, radius double, ids array<long>, blob binary"


def _bundles(rows: int, keep: int | None, dims: int):
    """Rows in order of cell, distance and id -> bundles of at most `rows` rows of one cell."""

    def bundle(no: int, cell: int, held: list[tuple]) -> pa.RecordBatch:
        made = Bundle(np.array([h[1] for h in held], np.int64), _matrix([h[2] for h in held], dims), keep)
        values = [no, cell, max(h[0] for h in held) * (1 + 1e-9) + 1e-6, made.tree.x[0].astype(np.float64).tobytes(), float(made.tree.norm[0]), float(made.tree.radius[0][0]), made.ids.tolist() if keep is None else None, made.dump()]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], _BUNDLES.replace(",", "").split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, at, held = TaskContext.get().partitionId() << 32, None, []
        for batch in batches:
            for cell, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (cell != at or len(held) == rows):
                    yield bundle(no, at, held)
                    no, held = no + 1, []
                at = cell
                held.append(tuple(row))
        if held:
            yield bundle(no, at, held)

    return run


def _bound(a: np.ndarray, norm: float, radius: float, c: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What no query of a group can exceed in bundles with these centres, norms and radii."""
    x = c @ a
    out = x + norm * radii + radius * (norms + radii)
    return out + 1e-9 * (np.abs(out) + norm * norms) + 1e-6


def _cells(centres: np.ndarray, reach: np.ndarray, lo: int, hi: int):
    """Groups -> the cells from place lo to hi, by bound, that can hold something for them."""
    norms = np.sqrt((centres * centres).sum(1)) * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, cells = [], []
            for g, centre, norm, radius, worst in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                bound = np.where(reach >= 0, _bound(np.frombuffer(centre), norm, radius, centres, norms, np.maximum(reach, 0)), -np.inf)
                place = np.argsort(-bound, kind="stable")[lo:hi]
                place = place[(bound[place] >= worst) & (reach[place] >= 0)]
                groups += [g] * len(place)
                cells += place.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(cells, pa.int32())], ["group", "cell"])

    return run


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, centre, norm, radius, worst, bundle, centre, norm, radius) -> group, bundle, bound of those that can reach the worst score."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for g, a, norm, s, worst, b, c, n, r in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            bound = float(_bound(np.frombuffer(a), norm, s, np.frombuffer(c)[None, :], np.array([n]), np.array([r]))[0])
            if bound >= worst:
                for column, value in zip(out, (g, b, bound), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["group", "bundle", "bound"])


def _meet(k: int):
    """Rows in order of chunk and copy, the chunk's own first -> query, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            out = []
            for kind, blob, known in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                bundle = Bundle.load(blob.as_py())
                if not kind:
                    chunk = bundle
                    continue
                score, least = np.full(len(bundle.ids), -(1 << 63)), np.full(len(bundle.ids), (1 << 63) - 1)
                if known:
                    q, s, t = (np.array([x[c] for x in known], np.int64) for c in ("query", "s", "t"))
                    order = np.argsort(q)
                    at = np.minimum(np.searchsorted(q[order], bundle.ids), len(q) - 1)
                    hit = q[order][at] == bundle.ids
                    score[hit], least[hit] = s[order][at][hit], t[order][at][hit]
                out.append(_search(bundle, chunk, score, least, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query", "id", "score"])

    return run


def top_k_search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """The k highest inner products of floor(scale * x) for each query, exact.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Defined cases: vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part; a shorter vector counts as filled up with zeros; a row is no candidate of a query
    with its own id; rows that share an id count once, with the best score, as queries and as candidates; fewer than k candidates
    are all returned; an empty table gives an empty result; other columns are ignored, whatever their names. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")]
    dims = max(df.agg(F.max(F.size(vec_col))).first()[0] or 0 for df in (vectors, queries))
    whole = lambda df: cut(df.select(*columns).mapInArrow(_whole(dims, scale), "id long, v binary"), "vectors")
    rows, asked = whole(vectors), whole(queries)
    n = rows.count()
    sample = rows.select("v", F.xxhash64("id").alias("x")).orderBy("x", "v").limit(4 * PIVOTS).collect()
    pivots = _matrix(list(dict.fromkeys(bytes(r["v"]) for r in sample))[: max(1, min(PIVOTS, -(-n // CHUNK)))], dims).astype(np.float64)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def bundles(df: DataFrame, size: int, keep: int | None) -> DataFrame:
        parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = df.mapInArrow(_assign(pivots, dims), "cell int, d double, id long, v binary").repartitionByRange(parts, "cell", "d", "id").sortWithinPartitions("cell", "d", "id")
        return cut(dealt.select("cell", "d", "id", "v").mapInArrow(_bundles(size, keep, dims), _BUNDLES), "bundles")

    chunks = bundles(rows, CHUNK, k + 1)
    groups = bundles(asked, GROUP, None).withColumnRenamed("bundle", "group")
    member = groups.select("group", F.explode("ids").alias("query"))
    reach = np.full(len(pivots), -1.0)
    for r in chunks.groupBy("cell").agg(F.max("reach").alias("reach")).collect():  # a row for each pivot at most
        reach[r["cell"]] = r["reach"]
    summary = chunks.select("cell", "bundle", "centre", "norm", "radius")
    state = groups.select("group", "centre", "norm", "radius", "blob", F.lit(float("-inf")).alias("worst"), F.expr("cast(null as array<struct<query: bigint, s: bigint, t: bigint>>)").alias("known"))

    def promising(lo: int, hi: int) -> DataFrame:
        found = state.select("group", "centre", "norm", "radius", "worst").mapInArrow(_cells(pivots, reach, lo, hi), "group long, cell int")
        met = found.join(state.select("group", "centre", "norm", "radius", "worst"), "group").join(summary.select("cell", "bundle", *(F.col(c).alias(f"c_{c}") for c in ("centre", "norm", "radius"))), "cell")
        return met.select("group", "centre", "norm", "radius", "worst", "bundle", "c_centre", "c_norm", "c_radius").mapInArrow(_promising, "group long, bundle long, bound double")

    def meet(pairs: DataFrame) -> DataFrame:
        copies = pairs.groupBy("bundle").agg(F.ceil(F.count("*") / AROUND).cast("int").alias("copies"))
        own = chunks.select("bundle", "blob").join(copies, "bundle").select("bundle", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), "blob", F.expr("cast(null as array<struct<query: bigint, s: bigint, t: bigint>>)").alias("known"))
        sent = pairs.join(copies, "bundle").join(state.select("group", "blob", "known"), "group").select("bundle", F.pmod(F.hash("group"), F.col("copies")).alias("salt"), F.lit(1).alias("kind"), "blob", "known")
        parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return own.unionByName(sent).repartition(parts, "bundle", "salt").sortWithinPartitions("bundle", "salt", "kind").mapInArrow(_meet(k), "query long, id long, score long")

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    ranked = lambda df: cut(df.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "top")
    seeds = cut(promising(0, 1).groupBy("group").agg(F.max_by("bundle", F.struct("bound", "bundle")).alias("bundle")), "seeds")
    top = ranked(meet(seeds))
    for lo, hi in zip(ROUNDS, ROUNDS[1:], strict=False):
        if lo >= len(pivots):
            break
        last = top.filter(F.col("rank") == k).select("query", F.col("score").alias("s"), F.col("id").alias("t"))
        known = member.join(last, "query", "left").groupBy("group").agg(F.min(F.coalesce("s", F.lit(-(1 << 63)))).cast("double").alias("worst"), F.collect_list(F.when(F.col("s").isNotNull(), F.struct("query", "s", "t"))).alias("known"))
        state = cut(groups.select("group", "centre", "norm", "radius", "blob").join(known, "group"), "groups")
        pairs = cut(promising(lo, hi).select("group", "bundle").join(seeds, ["group", "bundle"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            top = ranked(top.drop("rank").unionByName(meet(pairs)))
    return top.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op12_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k_search(vectors, vectors.filter("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
