"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary (a path, never copied or trained) span a lattice over each
word: all ways to write it as pieces. Pieces don't cross words, so the marginal probability of
a text is the product of its words' marginals and that of an end mark. A word's marginal is
the sum over all segmentations, by a forward recursion in log space. Weights start at the
vocabulary's own scores (which rank the pieces) and take expected piece counts from the training
documents (one step of expectation maximisation over the lattice: forward and backward).

The recursion runs once for each distinct word of the corpus, not once for each occurrence:
word counts are combined in the tasks before the shuffle. HEAD words of the highest counts are
broadcast (a fixed bound); occurrences of the others, few by Zipf's law, meet the word
table in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import SPACED, cut, fold, slices, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that are broadcast: at most 2**19 x 24 bytes, 13 MB.
HEAD = 1 << 19
#: Distinct words that a task combines before it hands them on, about.
FLUSH = 400_000
#: The vocabulary's own weights count as this many pieces.
PRIOR = 10_000.0
#: Words of a batch of the recursion: cells of its tables.
CELLS = 1 << 20
#: Places of a word, taken alone, whose pieces are held at once.
PLACES = 1 << 16
_MARK = "▁".encode()
_BASE = 0x100000001B3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


# --- words ------------------------------------------------------------------------------


def _take(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings data[start:end]."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(at[-1]) - np.repeat(at[:-1] - start, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[places]))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train) -> (hash, word, train count); the counts of several slices are combined."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def flush() -> pa.RecordBatch:
        h, first, back = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
        c = np.bincount(back, weights=np.concatenate([x[1] for x in held]), minlength=len(h)).astype(np.int64)
        words = pa.concat_arrays([x[2] for x in held]).take(pa.array(first))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), words, pa.array(c)], ["h", "word", "c"])

    size = 0
    for batch in batches:
        train = np.asarray(batch.column(1).to_pylist(), np.float64)
        for part in slices(batch.column(0), SPACED):
            if not len(part.start):
                continue
            h, first, back = np.unique(part.hashes(), return_index=True, return_inverse=True)
            c = np.bincount(back, weights=train[part.lo : part.lo + part.n_docs][part.doc], minlength=len(h))
            held.append((h, c, _take(part.data, part.start[first], part.end[first])))
            size += len(h)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


# --- lattice ----------------------------------------------------------------------------


class Lattice:
    """Pieces with log probabilities, and the recursion over batches of words."""

    def __init__(self, pieces: list[bytes], spare: np.ndarray, log_p: np.ndarray):
        """spare[b]: index of the single-byte piece of byte b, by which every text can be written."""
        self.log_p, self.spare = log_p, spare
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                by_size.setdefault(len(p), []).append(i)
        for size, ids in by_size.items():
            part = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, size)
            key = self._key(part)
            order = np.argsort(key)
            self.tables[size] = (key[order], np.array(ids)[order])

    @staticmethod
    def _key(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = h * np.uint64(_BASE) + rows[:, j] + np.uint64(1)
        return h

    @staticmethod
    def few(words: np.ndarray) -> bool:
        """Whether words of one length are better taken one by one, from place to place, than all at once."""
        return 2 * len(words) < words.shape[1]

    def edges(self, words: np.ndarray):
        """words: a matrix of bytes, all of one length -> for each end: (size, rows that have a piece there, the pieces)."""
        n, length = words.shape
        base = np.uint64(_BASE)
        power = np.ones(length + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(length, base, np.uint64))
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * base + words[:, j] + np.uint64(1)
        for end in range(1, length + 1):
            yield end, 1, None, self.spare[words[:, end - 1]]
            for size, (keys, ids) in self.tables.items():
                if size <= end:
                    key = prefix[end] - prefix[end - size] * power[size]
                    at = np.searchsorted(keys, key)
                    at[at == len(keys)] = 0
                    rows = np.flatnonzero(keys[at] == key)
                    if len(rows):
                        yield end, size, rows, ids[at[rows]]

    def word_edges(self, word: np.ndarray, backward: bool = False):
        """The pieces in one word of any length, PLACES ends at a time: (ends, starts, pieces) in order of the ends."""
        n = len(word)
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)))
        inverse = np.multiply.accumulate(np.full(n, _BASE_INVERSE, np.uint64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((word + np.uint64(1)) * inverse, out=total[1:])
        blocks = range(1, n + 1, PLACES)
        for lo in reversed(blocks) if backward else blocks:
            ends = np.arange(lo, min(lo + PLACES, n + 1))
            found = [(ends, ends - 1, self.spare[word[ends - 1]])]
            for size, (keys, ids) in self.tables.items():
                mine = ends[ends >= size]
                key = (total[mine] - total[mine - size]) * power[mine]
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = np.flatnonzero(keys[at] == key)
                found.append((mine[hit], mine[hit] - size, ids[at[hit]]))
            end, start, piece = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(end, kind="stable")
            yield end[order], start[order], piece[order]

    def word_alpha(self, word: np.ndarray) -> list[float]:
        """Log of the summed probability of all segmentations of word[:i], for each i."""
        alpha = [0.0] + [-math.inf] * len(word)
        for ends, starts, pieces in self.word_edges(word):
            for end, start, p in zip(ends.tolist(), starts.tolist(), self.log_p[pieces].tolist(), strict=True):
                alpha[end] = _log_add(alpha[end], alpha[start] + p)
        return alpha

    def word_expected(self, word: np.ndarray, count: float, total: np.ndarray) -> None:
        """Adds the expected uses of each piece in one word to the totals."""
        alpha = self.word_alpha(word)
        whole = alpha[-1]
        beta = [-math.inf] * len(word) + [0.0]
        for ends, starts, pieces in self.word_edges(word, backward=True):
            uses = []
            for end, start, p in zip(ends[::-1].tolist(), starts[::-1].tolist(), self.log_p[pieces][::-1].tolist(), strict=True):
                through = p + beta[end]
                beta[start] = _log_add(beta[start], through)
                uses.append(math.exp(alpha[start] + through - whole))
            total += np.bincount(pieces[::-1], np.array(uses) * count, len(total))

    def forward(self, words: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word."""
        if self.few(words):
            return np.array([self.word_alpha(w)[-1] for w in words])
        return self._alpha(words, list(self.edges(words)))[-1]

    def _alpha(self, words: np.ndarray, edges: list) -> np.ndarray:
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for end, size, rows, ids in edges:
            if rows is None:
                alpha[end] = np.logaddexp(alpha[end], alpha[end - size] + self.log_p[ids])
            else:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - size, rows] + self.log_p[ids])
        return alpha

    def expected(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in these words, each counted so many times."""
        if self.few(words):
            total = np.zeros(len(self.log_p))
            for word, count in zip(words, counts.tolist(), strict=True):
                self.word_expected(word, count, total)
            return total
        edges = list(self.edges(words))
        alpha = self._alpha(words, edges)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        total = np.zeros(len(self.log_p))
        for end, size, rows, ids in reversed(edges):
            rows = slice(None) if rows is None else rows
            through = self.log_p[ids] + beta[end, rows]
            beta[end - size, rows] = np.logaddexp(beta[end - size, rows], through)
            total += np.bincount(ids, np.exp(alpha[end - size, rows] + through - alpha[-1, rows]) * counts[rows], len(total))
        return total


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def _by_length(words: pa.Array):
    """Batches of words of one length: (indices, matrix of bytes with the word mark in front)."""
    data, at = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    size = np.diff(at)
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        length = size[order[lo]]
        hi = min(int(np.searchsorted(size[order], length, side="right")), lo + max(1, CELLS // int(length + 4)))
        rows = order[lo:hi]
        body = data[at[rows][:, None] + np.arange(length)]
        yield rows, np.concatenate([np.tile(np.frombuffer(_MARK, np.uint8), (len(rows), 1)), body], 1)
        lo = hi


def load_vocabulary(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces, place of each single byte's piece, and starting weights from the vocabulary's scores (they rank the pieces: 1 / (rank + 1), as in Zipf's law)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[bytes] = []
    spare = np.full(256, -1)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            spare[int(model.id_to_piece(i)[3:-1], 16)] = len(pieces)
            pieces.append(b"")
        else:
            pieces.append(model.id_to_piece(i).encode())
    for b in np.flatnonzero(spare < 0):
        spare[b] = len(pieces)
        pieces.append(b"")
    known = {model.id_to_piece(i).encode(): model.get_score(i) for i in range(model.get_piece_size())}
    scores = np.array([known.get(p, -1e6) if p else -1e6 for p in pieces])
    rank = np.empty(len(pieces))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
    weight = 1 / (rank + 1)
    return pieces, spare, weight / weight.sum()


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        total = np.zeros(len(lattice.log_p))
        for batch in batches:
            counts = batch.column(1).to_numpy().astype(np.float64)
            for rows, words in _by_length(batch.column(0)):
                total += lattice.expected(words, counts[rows])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])

    return run


def _weigh(shared):
    """(hash, word, count) -> hash, count, log10 of the word's marginal probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, words in _by_length(batch.column(1)):
                out[rows] = lattice.forward(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out / math.log(10))], ["h", "c", "lp"])

    return run


# --- documents --------------------------------------------------------------------------


def _score(head, end_c: int, n_train: int, n_types: int, end_lp: float):
    floor = math.log10(n_train + 0.1 * (n_types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, lp = head.value
        base_of = np.log10(c + 0.1) - floor
        for batch in batches:
            for part in slices(batch.column(1), SPACED):
                n = part.n_docs
                words = part.hashes()
                at = np.searchsorted(h, words) if len(h) else np.zeros(len(words), np.int64)
                at[at == len(h)] = 0
                there = h[at] == words if len(h) else np.zeros(len(words), bool)
                doc, at = part.doc[there], at[there]
                known = np.bincount(doc, c[at] > 0, n).astype(np.int64) + (end_c > 0)
                base = np.bincount(doc, base_of[at], n) + math.log10(end_c + 0.1) - floor
                score = np.bincount(doc, lp[at], n) + end_lp
                rest, doc = words[~there].view(np.int64), part.doc[~there]
                cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                mine = slice(part.lo, part.lo + n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[mine], batch.column(2)[mine], pa.array(part.counts() + 1), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(cuts, pa.array(rest))],
                    ["id", "held_out", "n_tokens", "n_known", "base", "score", "rest"],
                )

    return run


def lm_scores(docs: DataFrame, held_out: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Log10 probability of every text under the subword lattice, and under smoothed word counts.

    `held_out`: name of a boolean column; such rows are scored but not learnt from. Returns one
    row per row of `docs`: the id, held_out, n_tokens (words and one end), n_known (seen in
    training), train_tokens, base_score, score. Defined cases: null, empty and blank texts have only
    the end token; a word of any length is segmented whole, in time that grows as its length; bytes without a piece have single-byte
    pieces, so every score is finite; repeated rows are scored each (their words count each); null
    ids are kept; without training rows all counts are 0 and the vocabulary's own weights hold; an
    empty table gives an empty result; other columns are ignored. Words are told apart by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    flag = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), flag.alias("held_out"))
    words = rows.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count, "h long, word binary, c long")
    words = cut(words.groupBy("h").agg(F.first("word").alias("word"), F.sum("c").alias("c")), "words")
    n_docs = rows.filter("not held_out").count()
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_train, n_types = seen[0] + n_docs, seen[1] + (n_docs > 0)

    pieces, spare, weight = load_vocabulary(vocabulary)
    start = spark.sparkContext.broadcast((pieces, spare, np.log(weight)))
    uses = words.filter("c > 0").select("word", "c").mapInArrow(_expect(start), "piece long, uses double")
    learnt = weight * PRIOR
    for piece, total in uses.groupBy("piece").agg(F.sum("uses")).collect():  # a row for each piece of the vocabulary at most
        learnt[piece] += total
    fitted = spark.sparkContext.broadcast((pieces, spare, np.log(learnt / learnt.sum())))
    weighed = words.select("h", "word", "c").mapInArrow(_weigh(fitted), "h long, c long, lp double")
    end_p = (n_docs + 1) / (n_train + 2)  # after each word, the text ends or goes on
    weighed = cut(weighed.withColumn("lp", F.col("lp") + math.log10(1 - end_p)), "weighed")

    # words above the least count of which there are no more than HEAD words: found from the counts' histogram, so no task gathers the words themselves
    histogram = weighed.filter("c > 0").groupBy("c").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = histogram.withColumn("upto", upto).filter(F.col("upto") <= HEAD).agg(F.min("c")).first()[0]
    top = weighed.filter(F.col("c") >= (least or 1 << 62)).toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)  # as unsigned numbers
    head = spark.sparkContext.broadcast((h[order], top.column("c").to_numpy()[order], top.column("lp").to_numpy()[order]))
    schema = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>"
    end_lp = math.log10(end_p)
    scored = rows.select("id", "text", "held_out").mapInArrow(_score(head, n_docs, n_train, n_types, end_lp), schema)
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    floor = math.log10(n_train + 0.1 * (n_types + 1))
    rest = scored.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("tf")).join(weighed, "h")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) - floor)).alias("more_base"), F.sum(F.expr("tf * lp")).alias("more_score")
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score")
    )


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs.withColumn("held_out", fold(F.col("doc_id"), 10) == 0), "held_out")
