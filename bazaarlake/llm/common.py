"""What the operators of this subpackage share: tables, checkpoints and a vectorised tokenizer.

Words and shingles are identified by 64-bit hashes. Every function handles null and
empty texts (no words) and texts of any length: batches are cut into slices of a few
megabytes along document borders, so memory follows the longest document.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are tokenized at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a new local one in local mode (as in tests), and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bazaarlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Cuts the lineage: the rows go to a table in the shared folder and are read from there."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Texts travel to Python in batches of at most so many rows and bytes (Spark's own defaults are 10,000 rows and 64 MB), which bounds the memory of a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# --- tokenizing -------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (in UTF-8).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Documents rows[lo:hi] of a batch: lower-cased bytes and the words in them."""

    def __init__(self, lo: int, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.lo, self.n_docs, self.data, self.offsets = lo, len(offsets) - 1, data, offsets
        n = len(data)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            return
        inside = word_bytes[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edge[:n]] = False
        after[edge[1:]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def counts(self) -> np.ndarray:
        """Words of each document."""
        return np.bincount(self.doc, minlength=self.n_docs)


def word_hash(word: bytes) -> int:
    """The hash that Slice.hashes gives this (lower-cased) word."""
    x = Slice(0, np.frombuffer(word, np.uint8), np.array([0, len(word)]), np.ones(256, bool))
    return int(x.hashes()[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, word_bytes: np.ndarray, limit: int = SLICE_BYTES):
    """The documents of a column in slices of about `limit` bytes, tokenized."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Slice(lo, LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], word_bytes)
        lo = hi


def _weights(width: int) -> np.ndarray:
    """An odd 64-bit number for each place of a shingle."""
    return mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(part: Slice, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than `width` make one shingle, none make none."""
    words, n, weights = part.hashes(), part.counts(), _weights(width)
    first = np.concatenate([[0], np.cumsum(n)])
    if len(words) >= width:
        whole = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            whole += words[i : len(whole) + i] * weights[i]
        whole = mix(whole)
    out = []
    for d in range(part.n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            x = int(b - a)
            for i in range(a, b):
                x = (x * _BASE + int(words[i]) * int(weights[i - a])) % (1 << 64)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
