"""WARC archives: writing, and a splittable reader.

Every record is a gzip member of its own. A reader task gets a byte range of an archive, scans it
for the gzip magic, accepts a place only if what decodes there starts with a WARC header, and
owns the records that start inside of its range, also when they end behind it.

Archives are files of the shared folder. The rows that a writing task returns (path and size)
are written to a table by Spark; only archives named there are read, so what a lost or repeated
task left behind is ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import cut, new_dir, small_batches

#: Bytes of a reader's range, and of one read.
SPLIT, CHUNK = 8 << 20, 1 << 18
#: Payloads from this size on are stored once; equal ones refer to that record.
LEAST = 1000
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def record_id(page: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest.hex()}')}>"


def encode(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = _DATE) -> bytes:
    """One record, as a gzip member."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-Id: {'' if page is None else page}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode(record: bytes) -> dict:
    """A record's headers (lower-case names), HTTP headers and payload. Raises ValueError if it isn't whole."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/\d\.\d", lines[0]):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut off")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(re.findall(r"(?m)^([\w-]+): *(.*?)\r?$", http.decode("latin-1"))), "payload": payload}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, url, html, refers_to = (x.as_py() for x in row)
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                member = encode(page, url, (html or "").encode(), refers_to)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], ["path", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each page; returns the table of archives (path, bytes, records).

    Of pages with equal payloads of at least LEAST bytes, that with the largest id is stored as
    response, others are revisits of it. Rows repeated with that id and payload are all responses; a null
    id is never the largest, and its page is stored itself.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    large = rows.filter((F.col("size") >= LEAST) & F.col("page").isNotNull()).select("page", "digest")
    stored = large.groupBy("digest").agg(F.max("page").alias("stored"), F.count("*").alias("n")).filter("n > 1")
    # (page, digest) of the repeated pages is joined to the texts: one id may stand for several payloads
    revisits = large.join(stored, "digest").filter("page <> stored").select("page", "digest", F.col("stored").alias("refers_to")).distinct()
    linked = rows.join(revisits, ["page", "digest"], "left").select("page", "url", "html", "refers_to")
    return cut(linked.mapInArrow(_write(folder), "path string, bytes long, records long"), "archives")


class _Source:
    """A file, read forward from some place in chunks."""

    def __init__(self, handle, at: int):
        self.handle, self.at, self.buffer = handle, at, bytearray()
        handle.seek(at)

    def fill(self, n: int) -> bool:
        """Tries to have n bytes at self.at; False if the file ends before."""
        while len(self.buffer) < n:
            chunk = self.handle.read(max(CHUNK, n - len(self.buffer)))
            if not chunk:
                return False
            self.buffer += chunk
        return True

    def skip(self, n: int) -> None:
        del self.buffer[:n]
        self.at += n


def _member(source: _Source) -> tuple[bytes, int] | None:
    """The record of the gzip member at the source's place and the member's size; None if there is none.

    It is given up as soon as what it decodes to can't be a WARC header. A member that begins as a
    record and then breaks off or doesn't decode is an error: nothing that was written is skipped.
    """
    packer, out, used, checked = zlib.decompressobj(31), [], 0, False
    try:
        while not packer.eof:
            if not source.fill(used + 1):
                if checked:
                    raise ValueError(f"the record at byte {source.at} is cut off")
                return None
            piece = bytes(source.buffer[used : used + CHUNK])
            used += len(piece)
            out.append(packer.decompress(piece))
            if not checked:
                head = b"".join(out)
                if not b"WARC/1."[: len(head)] == head[:7]:
                    return None
                checked = len(head) >= 7
    except zlib.error as e:
        if checked:
            raise ValueError(f"the record at byte {source.at} is broken") from e
        return None
    return b"".join(out), used - len(packer.unused_data)


def records_of_range(handle, start: int, end: int) -> Iterator[bytes]:
    """The records whose gzip members start in [start, end) of an open file. What isn't a member is passed over at the range's start alone, where it is the rest of an earlier one; behind a record it is an error."""
    source, aligned = _Source(handle, start), start == 0
    while source.at < end:
        if not source.fill(3):
            if aligned and source.buffer:
                raise ValueError(f"the record at byte {source.at} is cut off")
            return
        if source.buffer[:3] == _MAGIC and (found := _member(source)):
            aligned = True
            yield found[0]
            source.skip(found[1])
            continue
        if aligned:
            raise ValueError(f"no record at byte {source.at}")
        # no record here: on to the next magic
        source.fill(CHUNK)
        at = source.buffer.find(_MAGIC, 1)
        source.skip(at if at > 0 else max(1, len(source.buffer) - 2))


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, path string"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, end, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows: list[tuple] = []
                if (there := store.get_file_info(path).size) != size:
                    raise ValueError(f"{path} has {there} bytes, {size} were written")
                with store.open_input_file(path) as handle:
                    for raw in records_of_range(handle, start, end):
                        record = decode(raw)
                        head = record["headers"]
                        digest = base64.b32decode(head["warc-payload-digest"].split(":")[1]).hex()
                        whole = head["warc-type"] == "response"
                        if whole and hashlib.sha1(record["payload"]).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of {head['warc-record-id']} doesn't match its digest")
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                        rows.append((int(page) if page else None, head["warc-target-uri"], len(record["payload"]) if whole else int(record["http"]["Content-Length"]), digest, head["warc-type"], int(refers) if refers else None, record["payload"] if whole else None, path))
                        if len(rows) >= 200:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _RECORD.split(", ")])


def read_warc(archives: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of the archives (path, bytes, records) of a folder, read in byte ranges of `split`, each with its path. A revisit has no payload. An archive of another length than was written is an error; so is another number of records: see all_records()."""
    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("start"))
    ranges = ranges.select("path", F.col("start").cast("long"), (F.col("start") + split).cast("long").alias("end"), "bytes").repartition(n)
    return ranges.mapInArrow(_read(folder), _RECORD)


def all_records(records: DataFrame, archives: DataFrame) -> DataFrame:
    """The records, written to a table, if each archive has as many as were written to it; else an error."""
    records = cut(records, "records")
    found = records.groupBy("path").agg(F.count("*").alias("found"))
    short = archives.join(found, "path", "left").filter("coalesce(found, 0) <> records").select("path", "records", "found").take(5)
    if short:
        raise ValueError("; ".join(f"{r['path']} has {r['found'] or 0} records, {r['records']} were written" for r in short))
    return records


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Writes all pages to archives and reads them back, one row per record.

    Columns: page_id, url (percent-encoded), payload_bytes and payload_digest (SHA-1 in lower-case
    hex; both of the full payload), record_type, refers_to, payload (null for revisits; left out without `payloads`). Defined
    cases: null html is an empty payload, a null url an empty one; payloads of any length are
    stored whole, those under LEAST bytes always; repeated rows have a record each, and so have
    several payloads under one id; a null id is kept; an archive that is cut off, wherever, or that lacks a record is an error; an empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    folder = new_dir(pages.sparkSession, "warc")
    archives = write_warc(pages, folder, id_col, url_col, html_col)
    records = read_warc(archives, folder, split)
    return all_records(records if payloads else records.drop("payload"), archives).drop("path")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS stored FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> stored THEN stored END AS refers_to
FROM q
"""
