"""Phrase collocation mining by dynamic itemset counting.

How it works
------------
1. Texts are tokenized once. Runs of documents of one language become chunks (a dictionary of word
   hashes, and codes with 0 between pieces), which are dealt out over a few shards in turn and stored in the shared folder.
2. Steps scan one shard each, in a cycle. Single words are counted from step 0. A longer phrase is
   active from the step after both of its subphrases (without the last, without the first word) reached the
   threshold, at whatever shard the cycle then stands, and it is counted until it has seen each shard once. So lengths
   interleave: phrases of frequent words are counted while the words' own cycle still runs.
3. Which phrases are active is known from a table of `slots` bytes, which holds the step since which a phrase counts as frequent
   in two slots a phrase. It has a bounded size (16 MB) and goes to each task. Two phrases may share slots; then a
   phrase is counted without need, but still over one full cycle, as each task sees the same table: its count is exact.
4. Counts travel packed, in blocks of the hash range, summed up in each task before. A block's state holds the phrases whose
   cycle runs; it is a written table after each step.
5. The frequent phrases' words are read back in one more scan; cuts, scores and ranks are joins on their hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlake.llm.common import cut, mix, new_dir, slices, small_batches, word_hash

#: Bytes that end a piece, and bytes that end a word.
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE
_WORD[[0x20, 0x09]] = False
#: Bytes of text of a chunk; bytes that a task holds for all languages; entries that a task sums up at once, and words of a block.
CHUNK, PENDING, FLUSH, BLOCK = 4 << 20, 32 << 20, 3_000_000, 2_000_000
#: Slots, at most, of the table of frequent phrases, of one byte each.
SLOTS = 1 << 24
_NEVER = 255
_K = np.uint64(0x9E3779B97F4A7C15)
#: Parts of a language that are ranked apart first.
SALTS = 32


def _chunks(shards: int):
    """(lang, text) -> one row per chunk of documents of one language."""

    def row(lang: str, texts: list[pa.Array], no: int) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(word_hash(b"lang " + lang.encode()))
        for part in slices(pa.concat_arrays(texts), _WORD, 2 * CHUNK):
            if not len(part.start):
                continue
            ends = np.concatenate([[0], np.cumsum(_PIECE[part.data])])[part.start]
            fresh = np.ones(len(ends), bool)
            fresh[1:] = (ends[1:] != ends[:-1]) | (part.doc[1:] != part.doc[:-1])
            words, first, code = np.unique(mix(part.hashes() + salt), return_index=True, return_inverse=True)
            codes = np.zeros(len(code) + int(fresh.sum()), "<u4")
            codes[np.arange(len(code)) + np.cumsum(fresh)] = code + 1
            texts_ = [part.data[a:b].tobytes() for a, b in zip(part.start[first].tolist(), part.end[first].tolist(), strict=True)]
            columns = [pa.array([no % shards], pa.int32()), pa.array([lang]), pa.array([len(code)], pa.int64()), pa.array([words.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([texts_], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "n", "words", "codes", "texts"])
            no += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        no = 0
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            no = no or zlib.crc32(str(langs[:1]).encode()) % shards
            for lang in pd.unique(langs):
                texts = batch.column(1).take(pa.array(np.flatnonzero(langs == lang)))
                held.setdefault(lang, []).append(texts)
                size[lang] = size.get(lang, 0) + texts.nbytes
                while size and (size[lang := max(size, key=size.get)] >= CHUNK or sum(size.values()) >= PENDING):
                    del size[lang]
                    for out in row(lang, held.pop(lang), no):
                        yield out
                        no += 1
        for lang in sorted(held):
            for out in row(lang, held[lang], no):
                yield out
                no += 1

    return run


def _since(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step since which these phrases count as frequent."""
    a, b = _slots(h, len(table))
    return np.maximum(table[a], table[b])


def _slots(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return (x % np.uint64(n)).astype(np.int64), ((x >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(n)).astype(np.int64)


def _extend(words: np.ndarray, codes: np.ndarray, table: np.ndarray, step: int, longest: int):
    """Phrases of 2 and more words at this step: length, places, hashes, the step since which both subphrases are frequent."""
    g = np.append(_since(table, words), np.uint8(_NEVER))[codes.astype(np.int64) - 1]
    at = np.flatnonzero(g <= step)
    g, h = g[at], words[codes[at].astype(np.int64) - 1]
    for length in range(2, longest + 1):
        i = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, since = at[i], np.maximum(g[i], g[i + 1])
        with np.errstate(over="ignore"):
            h = mix(h[i] * _K + words[codes[at + length - 1].astype(np.int64) - 1])
        yield length, at, h, since
        g = np.maximum(_since(table, h), since)  # not before its own subphrases, even where slots are shared
        keep = g <= step
        at, g, h = at[keep], g[keep], h[keep]


def _summed(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """(hash, count, since, length) arrays, a row for each hash, sorted."""
    h, c, a, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c[order], first) if len(first) else c, a[order][first], n[order][first]


_PACKED = "block int, old boolean, h binary, c binary, a binary, l binary"


def _count(step: int, shards: int, longest: int, n_blocks: int, table):
    """Chunks of one shard -> counts of the active phrases, packed by block of the hash range."""
    width = (1 << 64) // n_blocks + 1

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, c, a, n = _summed(held)
        block = (h // np.uint64(width)).astype(np.int64)
        edge = np.searchsorted(block, np.arange(n_blocks + 1))
        full = np.flatnonzero(np.diff(edge)).tolist()
        blobs = [[x[edge[b] : edge[b + 1]].tobytes() for b in full] for x in (h, c, a, n)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([False] * len(full)), *(pa.array(x, pa.binary()) for x in blobs)], ["block", "old", "h", "c", "a", "l"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held, size = table.value, [], 0
        for batch in batches:
            for words, codes in zip(batch.column(0), batch.column(1), strict=True):
                words, codes = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(codes.as_buffer(), "<u4")
                if step < shards:
                    held.append((words, np.bincount(codes, minlength=len(words) + 1)[1:].astype(np.int64), np.zeros(len(words), np.uint8), np.ones(len(words), np.uint8)))
                    size += len(words)
                for length, _, h, since in _extend(words, codes, frequent, step, longest):
                    now = since.astype(np.int64) + shards > step
                    h, first, c = np.unique(h[now], return_index=True, return_counts=True)
                    held.append((h, c.astype(np.int64), since[now][first], np.full(len(h), length, np.uint8)))
                    size += len(h)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _merge(step: int, shards: int, threshold: int):
    """A block's counts and its state -> its next state; what has become frequent; what has seen each shard and is frequent."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        arrays = lambda rows: [tuple(np.frombuffer(x, t) for x, t in zip(r, (np.uint64, np.int64, np.uint8, np.uint8), strict=True)) for r in rows[["h", "c", "a", "l"]].itertuples(index=False)]
        h, c, a, n = _summed(arrays(frame))
        before = np.zeros(len(h), np.int64)
        if len(old := frame[frame["old"]]):
            known = _summed(arrays(old))
            before[np.searchsorted(h, known[0])] = known[1]
        over = a.astype(np.int64) + shards <= step + 1
        parts = {"state": ~over, "fresh": (c >= threshold) & (before < threshold), "done": over & (c >= threshold)}
        rows = [(key[0], True, h[x].tobytes(), c[x].tobytes(), a[x].tobytes(), n[x].tobytes(), kind) for kind, x in parts.items() if x.any()]
        return pd.DataFrame(rows, columns=["block", "old", "h", "c", "a", "l", "kind"])

    return run


def _new_slots(slots: int, longest: int):
    """Packed phrases -> the slots that they take, as words of 64 bits; those of the longest ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, n in zip(batch.column(0), batch.column(1), strict=True):
                h, n = np.frombuffer(blob.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint8)
                for final in (False, True):
                    at = np.unique(np.concatenate(_slots(h[(n == longest) == final], slots)))
                    if len(at):
                        word, first = np.unique(at >> 6, return_index=True)
                        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits), pa.array([final] * len(word))], ["word", "bits", "final"])

    return run


def _set(table: np.ndarray, rows: pd.DataFrame, step: int) -> None:
    """Marks the slots in these words as taken since this step, where they were free."""
    bits = np.unpackbits(rows["bits"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    at = rows["word"].to_numpy(np.int64)[which] * 64 + bit
    table[at] = np.minimum(table[at], step)


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bytes([1]) * len(w)], pa.binary())], ["h", "l"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, c in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_buffer(), np.int64)), pa.array(np.frombuffer(c.as_buffer(), np.int64))], ["h", "f"])


def _hash_of(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases, a row of word hashes each."""
    h = words[:, 0]
    with np.errstate(over="ignore"):
        for i in range(1, words.shape[1]):
            h = mix(h * _K + words[:, i])
    return h


def _phrase(longest: int) -> np.dtype:
    return np.dtype([("h", "<u8"), ("n", "u1"), ("words", "<u8", (longest,))])


def _spell(longest: int, n_blocks: int, table):
    """Chunks -> the phrases that count as frequent, with their words' hashes, packed by language and block of the hash range."""
    kind, width = _phrase(longest), (1 << 64) // n_blocks + 1

    def flush(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            rows = np.concatenate(parts)
            rows = rows[np.unique(rows["h"], return_index=True)[1]]
            edge = np.searchsorted((rows["h"] // np.uint64(width)).astype(np.int64), np.arange(n_blocks + 1))
            full = np.flatnonzero(np.diff(edge)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([lang] * len(full), pa.string()), pa.array([rows[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary())], ["block", "lang", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held, size = table.value, {}, 0
        for batch in batches:
            for lang, words, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words, codes = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(codes.as_buffer(), "<u4")
                for length, at, h, _ in _extend(words, codes, frequent, _NEVER - 1, longest):
                    there = _since(frequent, h) < _NEVER
                    h, first = np.unique(h[there], return_index=True)
                    rows = np.zeros(len(h), kind)
                    rows["h"], rows["n"] = h, length
                    rows["words"][:, :length] = words[codes[at[there][first][:, None] + np.arange(length)].astype(np.int64) - 1]
                    held.setdefault(lang, []).append(rows)
                    size += len(rows)
            if size >= FLUSH // 4:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    return run


def _spelt(longest: int):
    """The phrases of a block, once each: their words, and the hashes of the parts of each cut."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, blobs in frame.groupby("lang")["rows"]:
            rows = np.frombuffer(b"".join(blobs), _phrase(longest))
            rows = rows[np.unique(rows["h"], return_index=True)[1]]
            for length in np.unique(rows["n"]).tolist():
                own = rows[rows["n"] == length]
                words = own["words"][:, :length]
                lists = [words, np.stack([_hash_of(words[:, :k]) for k in range(1, length)], 1), np.stack([_hash_of(words[:, k:]) for k in range(1, length)], 1)]
                lists = [list(np.ascontiguousarray(x).view(np.int64)) for x in lists]
                out.append(pd.DataFrame({"h": own["h"].view(np.int64), "lang": lang} | dict(zip(("words", "lefts", "rights"), lists, strict=True))))
        return pd.concat(out)

    return run


def _texts(table):
    """Chunks -> hashes and texts of the words whose slots are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = table.value, np.zeros(0, np.uint64)
        for batch in batches:
            for words, texts in zip(batch.column(0), batch.column(1), strict=True):
                h = np.frombuffer(words.as_buffer(), np.uint64)
                new = np.flatnonzero((_since(frequent, h) < _NEVER) & ~np.isin(h, seen))
                seen = np.union1d(seen, h[new]) if len(seen) < FLUSH else h[new]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), texts.values.take(pa.array(new)).cast(pa.string())], ["w", "word"])

    return run


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = 100, longest: int = 5, first: int | None = 2000, cover: int = 100, shards: int = 4, slots: int | None = None) -> DataFrame:
    """Phrases of 2 to `longest` words that occur `threshold` times or more in a language, scored by their weakest cut.

    Returns lang, rank (from 1), phrase, a, l, r, n, score (see the contract in README). A phrase goes if a longer one that
    holds its words has at least `cover` percent of its occurrences; `first` ranks of each language are returned (None: all).
    Defined cases: a null lang is `und`; null, empty and blank texts hold no words; texts of any length are read whole; equal
    scores are ordered by a, then by the phrase's bytes, equal scores of cuts by the shorter first part; repeated rows count as often as they occur; an empty table
    gives an empty result; other columns are ignored, whatever their names. Words and phrases are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not 2 <= longest or not 1 <= shards or longest * shards >= _NEVER - 1:
        raise ValueError("longest must be 2 or more, shards 1 or more, their product below 254")
    path = new_dir(spark, "chunks")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "shard int, lang string, n long, words binary, codes binary, texts array<binary>"
    rows.mapInArrow(_chunks(shards), schema).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    chunks = spark.read.schema(schema).parquet(path)
    sizes = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = sizes.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(4, int(n_words // BLOCK) + 1)
    slots = slots or min(SLOTS, 1 << max(16, int(n_words).bit_length()))

    # the steps: one shard each
    table, last, step, state, done = np.full(slots, _NEVER, np.uint8), 0, 0, None, []
    finals: list[pd.DataFrame] = []
    sent = spark.sparkContext.broadcast(table)
    while step < last + shards:
        shard = chunks.filter(F.col("shard") == step % shards).select("words", "codes")
        counted = shard.mapInArrow(_count(step, shards, longest, n_blocks, sent), _PACKED)
        both = counted if state is None else counted.unionByName(state)
        path = new_dir(spark, f"step{step}")
        both.groupBy("block").applyInPandas(_merge(step, shards, threshold), f"{_PACKED}, kind string").write.partitionBy("kind").parquet(path)
        merged = spark.read.schema(f"{_PACKED}, kind string").parquet(path)
        done.append(merged.filter("kind = 'done'").select("h", "c"))
        state = merged.filter("kind = 'state'").drop("kind")
        taken = merged.filter("kind = 'fresh'").select("h", "l").mapInArrow(_new_slots(slots, longest), "word long, bits long, final boolean")
        taken = taken.groupBy("word", "final").agg(F.bit_or("bits").alias("bits")).toPandas()  # slots / 32 rows at most
        step += 1
        longer = taken[~taken["final"].astype(bool)]
        finals.append(taken[taken["final"].astype(bool)])
        if len(longer):
            _set(table, longer, last := step)
            sent.destroy()  # the step's rows are written
            sent = spark.sparkContext.broadcast(table)
    for rows_ in finals:  # no phrase grows from the longest ones; they are only spelt
        _set(table, rows_, step)
    sent.destroy()  # the step's rows are written
    sent = spark.sparkContext.broadcast(table)
    counts = cut(reduce(DataFrame.unionByName, done).mapInArrow(_unpack, "h long, f long"), "counts")

    # words of the frequent phrases, cuts and scores
    spelt = chunks.select("lang", "words", "codes").mapInArrow(_spell(longest, n_blocks, sent), "block int, lang string, rows binary")
    spelt = spelt.groupBy("block").applyInPandas(_spelt(longest), "h long, lang string, words array<long>, lefts array<long>, rights array<long>")
    phrases = cut(spelt.join(counts.withColumnRenamed("f", "a"), "h"), "phrases")
    longer = phrases.filter("size(words) > 2").select(F.explode(F.array(F.element_at("lefts", -1), F.col("rights")[0])).alias("h"), "a")
    longer = longer.groupBy("h").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, "h", "left").filter(f"longer is null or 100 * cast(longer as decimal(19, 0)) < {int(cover)} * cast(a as decimal(19, 0))")
    cuts = kept.select("h", "lang", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "x"))
    of = lambda name: counts.select(F.col("h").alias(f"{name}_h"), F.col("f").alias(name))
    cuts = cuts.withColumns({"l_h": F.col("x.lefts"), "r_h": F.col("x.rights")}).join(of("l"), "l_h").join(of("r"), "r_h").join(sizes, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 * cast(a as decimal(19, 0)) as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    weakest = cuts.groupBy("h").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("x")).select("h", "x.score", "x.l", "x.r", "x.n")
    found = kept.select("h", "lang", "words", "a").join(weakest, "h")
    if first is not None:  # all that can be among the first; each part of a language ranks alone before
        order = [F.col("score").desc(), F.col("a").desc()]
        found = found.withColumn("salt", F.pmod("h", F.lit(SALTS)))
        found = found.withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= first)
        found = found.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= first).drop("salt", "place")
    found = cut(found, "found")
    wanted = found.select("h", F.posexplode("words").alias("no", "w"))
    packed = wanted.select("w").distinct().mapInArrow(_pack_words, "h binary, l binary").mapInArrow(_new_slots(slots, longest), "word long, bits long, final boolean")
    only = np.full(slots, _NEVER, np.uint8)
    _set(only, packed.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas(), 0)
    texts = chunks.select("words", "texts").mapInArrow(_texts(spark.sparkContext.broadcast(only)), "w long, word string")
    texts = texts.join(wanted.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.min("word").alias("word"))
    spelled = wanted.join(texts, "w").groupBy("h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = found.join(spelled, "h").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))).cast("long"))
    if first is not None:
        ranked = ranked.filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, unnest([1, 2, 3, 4, 5]) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
up AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) AS p FROM c WHERE k > 2) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN up ON up.lang = c.lang AND up.p = c.phrase WHERE up.f IS NULL OR 100 * up.f < 100 * c.f),
cuts AS (SELECT kept.lang, kept.phrase, kept.f AS a, cut, x.f AS l, y.f AS r, n.n, (1000 * kept.f::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
 FROM kept, unnest(range(1, kept.k)) t(cut), f x, f y, n WHERE x.lang = kept.lang AND y.lang = kept.lang AND n.lang = kept.lang AND x.phrase = array_to_string(kept.ws[1:cut], ' ') AND y.phrase = array_to_string(kept.ws[cut + 1:kept.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
