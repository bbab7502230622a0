"""N-gram Jaccard join: a blocked sparse product of the document x shingle incidence.

How it works
------------
1. Documents with equal shingle sets become one class (partial aggregation, so a group of
   thousands of copies shrinks before the shuffle). Only class representatives go on.
2. Product over the lowest quarter of the hash range. The incidence entries (shingle, class)
   of that range are packed and dealt out in blocks of the hash range. A first pass counts each
   class's frequent shingles (of more than HOT classes); in the second, the classes that share
   an infrequent one get an overlap count in each block, unless their sizes and its places in their
   sorted shingles already rule a link out. Summed over the blocks, a count bounds
   the full overlap from above: the part outside of the range and the frequent shingles count as
   shared. Pairs whose bound is below what their sizes need go. By the prefix filter principle
   (order: frequent shingles last, then by hash) every pair that can reach the threshold is
   found here, unless both classes are scarce: have too few infrequent shingles in the range.
3. Scarce classes (large families of near copies, short texts) get a second product: their own
   document frequencies order the shingles, and the rarest n - ceil(t n) + 1 of each are the keys.
   A key group of over SMALL classes is compared with its smallest member (a star) instead of within itself;
   members that differ from that one are compared with those whose distance to it (Jaccard
   distance is a metric; groups are split into rings of the threshold's width, and a ring meets its neighbours),
   size and position of the key allow a link, unless they are known to be connected.
4. Every remaining pair is verified on the full shingle sets of the whole texts. First each
   class meets its smallest partner, then only pairs that are not connected yet are compared:
   links within a component change nothing.
5. Components by alternating stars; every document gets its class's component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import SPACED, cut, mix, shingles, slices, small_batches
from bazaarlake.llm.components import connected_components

#: A shingle of more classes than this is frequent: it is put last in the order.
HOT = 8
#: Key groups of the second product up to this size are compared within themselves.
SMALL = 4
#: Share of the hash range of the first product.
RANGE = 0.25
#: Entries that a task packs at once, and aims at in a block.
FLUSH, BLOCK = 300_000, 600_000
#: Stars per large group before the remaining members are compared by distance.
STARS = 2
#: Longs of 64 parity bits of a class: bits in which two classes differ are shingles that one of them alone has.
SIGNS = 4
#: Members that meet one copy of their pivot, about; a pivot of more is copied, and its members are spread by salt.
AROUND = 256


def _sets(width: int):
    """(id, text) -> id, n, two hashes of the set, the hashes in the range."""
    top = np.uint64(int(RANGE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, low = [], [], [], []
            for part in slices(batch.column(1), SPACED):
                for s in shingles(part, width):
                    n.append(len(s))
                    k1.append(int(mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64)) - (1 << 63))
                    k2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCDEF987654321)), initial=np.uint64(0))) - (1 << 63))
                    low.append(s[: np.searchsorted(s, top)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(low, pa.binary())], ["id", "n", "k1", "k2", "low"])

    return run


_ENTRY = np.dtype([("h", "<u8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])
#: Marks in the place of n: this shingle is frequent; (added to n) this class is scarce.
_FREQUENT, _SCARCE = -1, 1 << 30


def _pack(n_blocks: int):
    """(id, n, hashes) -> incidence entries of many classes, packed by block of the hash range; a shingle frequent in this batch becomes one mark, and a count for each class."""
    width = int(RANGE * 2**64) // n_blocks + 1

    def flush(held: list[tuple[int, int, np.ndarray]]):
        sizes = [len(x[2]) for x in held]
        rows = np.empty(sum(sizes), _ENTRY)
        rows["h"], rows["id"], rows["n"] = np.concatenate([x[2] for x in held]), np.repeat([x[0] for x in held], sizes), np.repeat([x[1] for x in held], sizes)
        rows["pos"] = np.concatenate([np.arange(size) for size in sizes])
        rows = rows[np.argsort(rows["h"], kind="stable")]
        length = _runs(rows["h"])
        hot = length > HOT
        ids, count = np.unique(rows["id"][hot], return_counts=True)
        marks = rows[hot & np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])[: len(rows)]].copy()
        marks["n"] = _FREQUENT
        rows = np.concatenate([rows[~hot], marks])
        block = (rows["h"] // np.uint64(width)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        rows, block = rows[order], block[order]
        at = np.searchsorted(block, np.arange(n_blocks + 1))
        full = np.unique(block).tolist()
        blocks, blobs, frequent = list(full), [rows[at[b] : at[b + 1]].tobytes() for b in full], [b""] * len(full)
        place = (mix(ids.astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int64)
        for b in np.unique(place).tolist():
            mine = place == b
            blocks.append(b), blobs.append(b""), frequent.append(np.stack([ids[mine], count[mine]], 1).astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary()), pa.array(frequent, pa.binary())], ["block", "rows", "frequent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, n, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = np.frombuffer(low.as_buffer(), np.uint64)
                held.append((i, n, h))
                size += len(h)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _runs(h: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each place of a sorted array belongs to."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(h)))
    return np.repeat(length, length)


def _block(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one block in order of the shingles, and which of them are of frequent ones."""
    rows = np.frombuffer(b"".join(frame["rows"]), _ENTRY)
    rows = rows[np.argsort(rows["h"], kind="stable")]
    hot = _runs(rows["h"]) > HOT
    mark = rows["n"] == _FREQUENT
    if mark.any():
        hot |= np.isin(rows["h"], rows["h"][mark])
    return rows[~mark], hot[~mark]


def _count_frequent(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Frequent shingles of each class in one block."""
    rows, hot = _block(frame)
    known = np.frombuffer(b"".join(frame["frequent"]), "<i8").reshape(-1, 2)
    ids, count = np.unique(rows["id"][hot], return_counts=True)
    return pd.DataFrame({"id": np.concatenate([known[:, 0], ids]), "hot": np.concatenate([known[:, 1], count])}).astype("int64")


def _multiply(percent: int):
    """One block of the product: pairs of classes (not both scarce) with the number of infrequent shingles that they share."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows, hot = _block(frame)
        rows = rows[~hot]
        length = _runs(rows["h"])
        rows, length = rows[length > 1], length[length > 1]
        h, ids, scarce = rows["h"], rows["id"], rows["n"] >= _SCARCE
        n, pos = rows["n"].astype(np.int64) % _SCARCE, rows["pos"].astype(np.int64)
        left, right = [], []
        for step in range(1, HOT):
            if len(h) <= step:
                break
            i = np.flatnonzero((length[:-step] > step) & (h[:-step] == h[step:]) & ~(scarce[:-step] & scarce[step:]))
            # what stands before a shared shingle in both orders, and what stands behind it, bound the overlap
            j = i + step
            most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
            i = i[(100 + percent) * most >= percent * (n[i] + n[j])]
            left.append(np.minimum(ids[i], ids[i + step]))
            right.append(np.maximum(ids[i], ids[i + step]))
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return pd.DataFrame({"a": a[first], "b": b[first], "shared": np.diff(np.append(first, len(a)))}).astype("int64")

    return run


class _Texts:
    """Access to the whole texts of some documents, and to comparisons of pairs of them."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent

    def of(self, wanted: DataFrame) -> DataFrame:
        """wanted: one row for each id, with other columns -> these columns and the text.

        A bitmap of 2**24 bits (2 MB, at most 262,144 rows) of the wanted ids is broadcast, so that
        few other texts enter the shuffle; the join then decides.
        """
        word = F.shiftright(F.pmod(F.xxhash64("id"), F.lit(1 << 24)), 6)
        bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))")
        bits = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        likely = self.docs.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return likely.select("id", "text").join(wanted, "id")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b) -> a, b, na, nb, shared: exact. Members (a) travel to their pivot (b); a pivot of many members is copied, and they are spread by salt."""
        pivots = pairs.groupBy("b").agg(F.ceil(F.count("*") / AROUND).cast("int").alias("salts"))
        to = F.struct(F.col("b").alias("to"), F.pmod(F.hash("a"), F.col("salts")).alias("salt"))
        places = (
            pairs.join(pivots, "b").groupBy(F.col("a").alias("id")).agg(F.collect_set(to).alias("places"), F.lit(0).alias("salts"))
            .unionByName(pivots.select(F.col("b").alias("id"), F.expr("cast(array() as array<struct<to: bigint, salt: int>>)").alias("places"), "salts"))
            .groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"), F.max("salts").alias("salts"))
        )
        schema = "to long, salt int, member int, id long, s binary"
        sent = self.of(places).select("id", "text", "places.to", "places.salt", "salts").mapInArrow(_send(self.width), schema)
        n = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
        met = sent.repartition(n, "to", "salt").sortWithinPartitions("to", "salt", "member")
        return met.select("to", "salt", "member", "id", "s").mapInArrow(_meet, "a long, b long, na long, nb long, shared long")


def _send(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tos, salts, copies = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for part in slices(batch.column(1), SPACED):
                out: list[list] = [[], [], [], [], []]
                for d, s in enumerate(shingles(part, width)):
                    i, blob = part.lo + d, s.tobytes()
                    rows = [(to, salt, 1) for to, salt in zip(tos[i], salts[i], strict=True)] + [(ids[i], salt, 0) for salt in range(copies[i])]
                    for to, salt, member in rows:
                        for column, value in zip(out, (to, salt, member, ids[i], blob), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["to", "salt", "member", "id", "s"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot, the pivot's own first."""
    pivot, own = None, None
    for batch in batches:
        a, b, na, nb, shared = [], [], [], [], []
        for to, member, i, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            s = np.frombuffer(blob.as_buffer(), np.uint64)
            if not member:
                pivot, own = to, s.copy()
                continue
            assert pivot == to
            at = np.searchsorted(own, s)
            at[at == len(own)] = 0
            a.append(i), b.append(to), na.append(len(s)), nb.append(len(own))
            shared.append(int((own[at] == s).sum()) if len(own) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, na, nb, shared)], ["a", "b", "na", "nb", "shared"])


def _linked(percent: int) -> str:
    return f"100 * shared >= {percent} * (na + nb - shared)"


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are not known to be connected."""
    of_a = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return joined.filter("coalesce(ca, a) <> coalesce(cb, b)").select(*pairs.columns)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of word n-grams have a Jaccard similarity of `percent` / 100 or more.

    Returns one row per row of `docs`: the id, n_shingles, class_id (smallest id with the
    same set) and component_id (smallest id that links reach). Defined cases: null, empty and
    blank texts have an empty set and link with nothing (their own class and component); fewer
    words than `width` make one shingle; rows repeated with the same id and text are one
    document; rows of one id with different texts are linked with each other, and each has the links of its text; ties and repeated
    texts are one class; an empty table gives an empty result; other columns are ignored, whatever their names. A row with a null id
    belongs to the class of its set if a document with an id has the same one (else class and component are null), and links nothing itself.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = cut(docs.mapInArrow(_sets(width), "id long, n long, k1 long, k2 long, low binary"), "sets")
    key = F.struct("k1", "k2", "n")
    several = cut(sets.filter("n > 0 and id is not null").groupBy("id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("id"), "several")
    if several.isEmpty():
        found = _join(docs, sets, None, width, percent)
        return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class_id")
    # rows of such ids get numbers of their own, which are links of one another
    marked = docs.join(several.withColumn("several", F.lit(True)), "id", "left")
    rows = cut(marked.select(F.col("id").alias("of"), F.when(F.col("several"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("id"), "text"), "rows")
    named = rows.select("id", "of").filter("id <> of").distinct()
    sets = cut(rows.select("id", "text").mapInArrow(_sets(width), "id long, n long, k1 long, k2 long, low binary"), "sets")
    found = cut(_join(rows.select("id", "text"), sets, named, width, percent), "found").join(named, "id", "left").withColumn("of", F.coalesce("of", "id"))
    least = lambda column: found.filter(f"{column} is not null").groupBy(column).agg(F.min("of").alias(f"least_{column}"))
    found = found.join(least("component_id"), "component_id", "left").join(least("class_id"), "class_id", "left")
    return found.select(F.col("of").alias(id_col), F.col("n").alias("n_shingles"), F.col("least_component_id").alias("component_id"), F.col("least_class_id").alias("class_id"))


def _join(docs: DataFrame, sets: DataFrame, named: DataFrame | None, width: int, percent: int) -> DataFrame:
    """id, n, component_id, class_id of each row; an id has one set. named (id, of): ids of one `of` are linked."""
    texts = _Texts(docs.filter("id is not null"), width, percent)

    # 1. classes
    classes = cut(sets.filter("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id"))
    given = None
    if named is not None:
        mine = sets.select("id", "k1", "k2", "n").join(named, "id").join(classes, ["k1", "k2", "n"])
        given = cut(mine.join(mine.groupBy("of").agg(F.min("rep").alias("b")), "of").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "given")
    entries = sets.filter("n > 0").select("id", "n", "low").join(reps, "id", "left_semi").dropDuplicates(["id"])

    # 2. first product
    total = sets.agg(F.sum(F.length("low")) / 8).first()[0] or 0
    n_blocks = max(4, int(total // BLOCK) + 1)
    packed = entries.mapInArrow(_pack(n_blocks), "block int, rows binary, frequent binary")
    frequent = packed.groupBy("block").applyInPandas(_count_frequent, "id long, hot long").groupBy("id").agg(F.sum("hot").alias("hot"))
    prefix = f"n - ceil({percent} * n / 100) + 1"
    size = reps.join(sets.select("id", "n", (F.length("low") / 8).cast("long").alias("low")).dropDuplicates(["id"]), "id").join(frequent, "id", "left")
    size = cut(size.select("id", "n", "low", F.coalesce("hot", F.lit(0)).alias("hot")).withColumn("scarce", F.expr(f"low - hot < {prefix}")), "size")
    # of each class the entries up to its prefix's end: that of its first `used` hashes, the frequent ones among them not counted
    size = size.withColumn("used", F.expr(f"least(low, {prefix} + hot)"))
    flags = size.select("id", "used", F.expr(f"cast(n + if(scarce, {_SCARCE}, 0) as long)").alias("n"))
    flagged = sets.select("id", "low").join(flags, "id").dropDuplicates(["id"]).select("id", "n", F.expr("substring(low, 1, cast(8 * used as int))").alias("low"))
    n_blocks = max(4, int((size.agg(F.sum("used")).first()[0] or 0) // BLOCK) + 1)  # fewer entries, fewer blocks that a pair's counts come from
    packed = flagged.mapInArrow(_pack(n_blocks), "block int, rows binary, frequent binary")
    counts = packed.groupBy("block").applyInPandas(_multiply(percent), "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    sa, sb = (size.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("used").alias(f"used{x}"), F.col("hot").alias(f"hot{x}")) for x in "ab")
    # behind the hash at which one of the two ends, no more can be shared than that one has there
    bound = "shared + least(hota, hotb) + greatest(na - useda, nb - usedb)"
    pairs = counts.join(sa, "a").join(sb, "b").filter(f"(100 + {percent}) * ({bound}) >= {percent} * (na + nb)").select("a", "b")

    # 3. second product, for scarce classes
    own = cut(texts.of(size.filter("scarce").select("id")).mapInArrow(_incidence(width), "id long, n long, h long"), "incidence")
    often = own.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = own.join(often, "h", "left").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "h"))).alias("s"))
    keys = ranked.select("id", "n", F.posexplode(F.slice("s", F.lit(1), F.expr(prefix).cast("int"))).alias("pos", "x")).filter("x.c > 1")
    keys = cut(keys.select("id", "n", "pos", "x.h"), "keys")
    group = keys.groupBy("h").agg(F.count("*").alias("members"), F.min("id").alias("pivot")).filter("members > 1")
    met = keys.join(group, "h")
    # sizes, and positions: what stands before the first shared key isn't shared
    near = f"(100 + {percent}) * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)"
    small = met.filter(f"members <= {SMALL}").groupBy("h").agg(F.collect_list(F.struct("id", "n", "pos")).alias("m"))
    small = small.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).filter(f"x.id < y.id and {near}").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    large = cut(met.filter(f"members > {SMALL}").select("h", "pivot", "id", "n", "pos"), "large")
    pairs = cut(pairs.unionByName(small).distinct(), "pairs")

    # 4. verification: stars first, then what they leave apart
    stars = pairs.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    stars = stars.unionByName(large.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()).distinct()
    checked = cut(texts.compare(stars), "checked")
    links = checked.filter(_linked(percent)).select("a", "b")
    links = links if given is None else links.unionByName(given)
    for _ in range(STARS):
        label = connected_components(links)
        rest = cut(_apart(pairs, label), "rest")
        if rest.isEmpty():
            break
        star = rest.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select(F.col("y").alias("a"), F.col("x").alias("b"))
        seen = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = cut(texts.compare(star.join(seen, ["a", "b"], "left_anti")), "checked")
        checked = checked.unionByName(more)
        links = links.unionByName(more.filter(_linked(percent)).select("a", "b"))
        pairs = rest.join(star.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    else:
        label = connected_components(links)
    rest = _apart(pairs, label)
    # in large groups, members that are apart from their pivot and those that can be within reach of them
    far = checked.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("d"))
    far = large.join(far.dropDuplicates(["id", "pivot"]), ["id", "pivot"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    far = far.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    bits = [F.bit_xor(F.when(F.pmod(F.shiftright("h", 6), F.lit(SIGNS)) == i, F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(SIGNS)]
    signs = own.groupBy("id").agg(*bits)
    far = far.join(signs, "id")
    home = label.select(F.col("node").alias("pivot"), F.col("component").alias("home"))
    far = cut(far.join(home, "pivot", "left").withColumn("home", F.coalesce("home", "pivot")), "far")
    reach = (100 - percent) / 100 + 1e-9
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SIGNS)), F.lit(0))
    alike = (100 + percent) * differ <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    ring = F.floor(F.col("d") / reach)
    x = far.filter("component <> home").withColumn("ring", F.explode(F.array(ring - 1, ring, ring + 1))).alias("x")
    y = far.withColumn("ring", ring).alias("y")
    within = (F.col("x.h") == F.col("y.h")) & (F.col("x.ring") == F.col("y.ring")) & (F.abs(F.col("x.d") - F.col("y.d")) <= reach) & alike & (F.col("x.component") != F.col("y.component")) & F.expr(near) & ((F.col("y.component") == F.col("y.home")) | (F.col("x.id") < F.col("y.id")))
    rest = rest.unionByName(x.join(y, within).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))).distinct()
    rest = rest.join(checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    rest = cut(rest, "rest")
    if not rest.isEmpty():
        last = texts.compare(rest)
        label = connected_components(links.unionByName(last.filter(_linked(percent)).select("a", "b")))

    # 5. components of classes, and every document's
    of_class = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", "rep", F.coalesce("component", "rep").alias("component"))
    return sets.select("id", "n", "k1", "k2").join(of_class, ["k1", "k2", "n"], "left").select("id", "n", F.coalesce("component", "id").alias("component_id"), F.coalesce("rep", "id").alias("class_id"))


def _incidence(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in slices(batch.column(1), SPACED):
                sets = shingles(part, width)
                sizes = [len(s) for s in sets]
                mine = ids[part.lo : part.lo + part.n_docs]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "n", "h"])

    return run


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
