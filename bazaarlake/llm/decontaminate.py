"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: a task packs its documents into shards of about
SHARD_WORDS words and stores, for each term of a shard, the sorted list of its positions.
Nothing is gathered by term, so frequent terms are no hot keys. A search looks up the
windows of the test items in every shard: from the term with the shortest list, the
offset-adjusted lists of the others are intersected in order of their length. The windows are a
table in the shared folder, in blocks of about BLOCK_WINDOWS; a task reads one block after
another for each of its shards, so neither the driver nor a task holds the whole benchmark,
and the index is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import ALNUM, cut, new_dir, slices, small_batches

SHARD_WORDS = 400_000
#: Windows of a block, about: x window x 8 bytes, 8 MB for windows of 10.
BLOCK_WINDOWS = 100_000
#: Candidate positions that are held at once.
CANDIDATES = 300_000

_INDEX = "ids binary, known binary, n_words binary, terms binary, starts binary, positions binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    counts: list[np.ndarray] = []
    words: list[np.ndarray] = []
    size = 0

    def shard() -> pa.RecordBatch:
        all_words = np.concatenate(words)
        order = np.argsort(all_words, kind="stable").astype(np.uint32)
        by_term = all_words[order]
        starts = np.flatnonzero(np.concatenate([[True], by_term[1:] != by_term[:-1]])) if len(by_term) else np.zeros(0, np.int64)
        known = np.array([i is not None for i in ids], np.uint8)
        blobs = (np.array([i or 0 for i in ids], np.int64), known, np.concatenate(counts).astype(np.int64), by_term[starts], starts.astype(np.uint32), order)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], [x.split()[0] for x in _INDEX.split(", ")])

    for batch in batches:
        docs = batch.column(0).to_pylist()
        for part in slices(batch.column(1), ALNUM):
            ids += docs[part.lo : part.lo + part.n_docs]
            counts.append(part.counts())
            words.append(part.hashes())
            size += len(part.start)
            if size >= SHARD_WORDS:
                yield shard()
                ids, counts, words, size = [], [], [], 0
    if ids:
        yield shard()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the positional index of all documents in the shared folder; one row is a shard."""
    return cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_build, _INDEX), "index")


def _windows(width: int):
    """Items -> their distinct windows: width consecutive words, or all words of a shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            out: tuple[list, list] = ([], [])
            for part in slices(batch.column(1), ALNUM):
                words, at = part.hashes(), np.concatenate([[0], np.cumsum(part.counts())])
                for d in range(part.n_docs):
                    own = words[at[d] : at[d + 1]]
                    if len(own):
                        size = min(width, len(own))
                        for w in {own[i : i + size].tobytes() for i in range(len(own) - size + 1)}:
                            out[0].append(items[part.lo + d])
                            out[1].append(w)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["item", "words"])

    return run


class Shard:
    """One shard of the index."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.known, self.n_words = read("ids", np.int64), read("known", np.uint8), read("n_words", np.int64)
        self.terms, self.positions = read("terms", np.uint64), read("positions", np.uint32)
        self.starts = read("starts", np.uint32).astype(np.int64)
        self.sizes = np.diff(np.append(self.starts, len(self.positions)))
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        # (term, position) in one number: the postings in order, for intersections by binary search
        self.keys = (np.repeat(np.arange(len(self.terms), dtype=np.uint64), self.sizes) << np.uint64(32)) | self.positions

    def rank(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in this shard, -1 if it isn't there."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (rank.astype(np.uint64) << np.uint64(32)) | position.astype(np.uint64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return self.keys[at] == key

    def expand(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the ranks, in turn, its list of positions: (which, position)."""
        sizes = self.sizes[rank]
        which = np.repeat(np.arange(len(rank)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.positions[self.starts[rank][which] + inside].astype(np.int64)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def blocks(self, sizes: np.ndarray):
        """Ranges of windows of at most about CANDIDATES candidates."""
        total = np.cumsum(sizes)
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CANDIDATES, side="right")))
            yield lo, hi
            lo = hi

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows: hashes, one row each -> (window, start) of all exact occurrences inside documents."""
        ranks = self.rank(windows)
        there = np.flatnonzero((ranks >= 0).all(1))
        ranks, length = ranks[there], windows.shape[1]
        sizes = self.sizes[ranks] if len(there) else np.zeros((0, length), np.int64)
        by_size = np.argsort(sizes, axis=1, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in self.blocks(sizes.min(1)) if len(there) else ():
            rows = np.arange(lo, hi)
            offset = by_size[rows, 0]
            which, position = self.expand(ranks[rows, offset])
            start = position - offset[which]
            ok = (start >= 0) & (start + length <= self.first[-1])
            which, start = which[ok], start[ok]
            for j in range(1, length):
                if not len(which):
                    break
                offset = by_size[rows[which], j]
                ok = self.has(ranks[rows[which], offset], start + offset)
                which, start = which[ok], start[ok]
            ok = self.doc(start) == self.doc(start + length - 1) if len(start) else np.zeros(0, bool)
            found.append((there[rows[which[ok]]], start[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def near(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of places where all terms of a window, in any order, stand within its length + slop words of one document, from the rarest term on."""
        ranks = self.rank(windows)
        there = np.flatnonzero((ranks >= 0).all(1))
        ranks, span = ranks[there], windows.shape[1] + slop
        found: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = self.sizes[ranks] if len(there) else np.zeros((0, 1), np.int64)
        rarest = sizes.argmin(1) if len(there) else np.zeros(0, np.int64)
        for lo, hi in self.blocks(sizes.min(1) * span) if len(there) else ():
            rows = np.arange(lo, hi)
            which, position = self.expand(ranks[rows, rarest[rows]])
            which, start = np.repeat(which, span), (position[:, None] - np.arange(span)).ravel()
            ok = (start >= 0) & (start < self.first[-1])
            which, start = which[ok], start[ok]
            end = np.minimum(start + span, self.first[self.doc(start) + 1])
            for j in range(windows.shape[1]):
                if not len(which):
                    break
                rank = ranks[rows[which], j].astype(np.uint64) << np.uint64(32)
                inside = np.searchsorted(self.keys, rank | start.astype(np.uint64)) < np.searchsorted(self.keys, rank | end.astype(np.uint64))
                which, start, end = which[inside], start[inside], end[inside]
            pairs = np.unique(np.stack([there[rows[which]], start], 1), axis=0)
            found.append((pairs[:, 0], pairs[:, 1]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_FOUND = "id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _read_block(folder: str, b: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Item names of a block of windows, and for each window length (places in the names, hashes)."""
    store, path = fs.FileSystem.from_uri(f"{folder}/block={b}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return [], []
    table = pq.read_table(path, filesystem=store)
    items, words = table.column("item").to_pylist(), table.column("words").to_pylist()
    names = sorted(set(items))
    place = {x: i for i, x in enumerate(names)}
    lengths: dict[int, tuple[list, list]] = {}
    for item, w in zip(items, words, strict=True):
        both = lengths.setdefault(len(w) // 8, ([], []))
        both[0].append(place[item]), both[1].append(w)
    return names, [(np.array(a, np.int64), np.frombuffer(b"".join(w), np.uint64).reshape(-1, size)) for size, (a, w) in sorted(lengths.items())]


def _search(folder: str, n_blocks: int, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = lru_cache(maxsize=2)(lambda b: _read_block(folder, b))
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                n = len(shard.ids)
                cover = np.zeros(shard.first[-1] + 1, np.int64)
                pairs: set[tuple[int, str]] = set()
                for b in range(n_blocks):
                    items, lengths = block(b)
                    for names, windows in lengths:
                        which, start = shard.phrases(windows) if slop is None else shard.near(windows, slop)
                        end = start + windows.shape[1] if slop is None else np.minimum(start + windows.shape[1] + slop, shard.first[shard.doc(start) + 1])
                        np.add.at(cover, start, 1)
                        np.add.at(cover, end, -1)
                        pairs |= {(int(x) // len(items), items[int(x) % len(items)]) for x in np.unique(shard.doc(start) * len(items) + names[which])}
                # places of hit words, cut at documents' borders
                hit = np.cumsum(cover[:-1]) > 0
                prior = np.concatenate([[False], hit[:-1]])
                after = np.concatenate([hit[1:], [False]])
                prior[shard.first[:-1][shard.first[:-1] < len(hit)]] = False
                lasts = shard.first[1:] - 1
                after[lasts[lasts >= 0]] = False
                starts, ends = np.flatnonzero(hit & ~prior), np.flatnonzero(hit & ~after) + 1
                doc = shard.doc(starts)
                at = np.searchsorted(doc, np.arange(n + 1))
                base = shard.first[doc]
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - base, pa.int64())) for x in (starts, ends)]
                found = sorted(pairs)
                at = np.searchsorted(np.array([d for d, _ in found], np.int64), np.arange(n + 1))
                names = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([x for _, x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, mask=shard.known == 0), pa.array(shard.n_words), *lists, names], ["id", "n_words", "starts", "ends", "items"])

    return run


def search_index(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10, slop: int | None = None) -> DataFrame:
    """Occurrences of the items' windows in all documents of an index.

    slop None: exact phrases; a number: places where a window's words stand in any order
    within so many more words (proximity). Returns one row per document: id, n_words, spans
    (start and end of hit words, disjoint and in order) and items (ids as strings, sorted).
    """
    spark = index.sparkSession
    found = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    windows = cut(found.mapInArrow(_windows(width), "item string, words binary").distinct(), "windows")
    n_blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    folder = new_dir(spark, "blocks")
    windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n_blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    return index.mapInArrow(_search(folder, n_blocks, slop), _FOUND).select("id", "n_words", F.arrays_zip("starts", "ends").alias("spans"), "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, slop: int | None = None
) -> DataFrame:
    """Documents with passages of a benchmark.

    A window is `width` consecutive words of an item, or the whole of a shorter one; a document
    word inside any occurrence of a window is hit. Returns one row per row of `docs`: the id,
    n_words, n_hit, n_items, items_sha256 (of the ids of items found, sorted as strings,
    comma-joined), contaminated, spans, items. Defined cases: null and empty texts have no words
    and no hits; items without words or with a null id are ignored; repeated items count once;
    windows don't cross documents; rows with a null or a repeated id are judged each; an empty benchmark
    hits nothing; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    found = search_index(build_index(docs, id_col, text_col), benchmark, item_col, item_text_col, width, slop)
    covered = F.expr("aggregate(spans, 0L, (n, x) -> n + x.ends - x.starts)")
    return found.select(
        F.col("id").alias(id_col), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "spans", "items"
    ).withColumn("contaminated", F.col("n_hit") > 0)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS k FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= size),
hits AS (SELECT doc_id, i, spot.size, item_id FROM spot JOIN win ON win.size = spot.size AND win.k = array_to_string(ws[i:i + spot.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
