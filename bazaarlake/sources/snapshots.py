"""Tables whose state changes in one step: data folders that are never rewritten, and numbered pointers to them.

A table is a folder with `data-…` folders and `pointers/00000001`, `00000002`, ... A writer writes a new data folder whole and then creates
the next pointer, which fails if another writer was faster; a pointer holds the folder's name and a line end, so one that was not
finished counts as none. A reader resolves a version once and reads its folder, whatever is written meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made a version since the one that was read."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _text(spark: SparkSession, path: str) -> str:
    fs, where = _files(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Finished versions and their data folders."""
    fs, where = _files(spark, f"{path}/pointers")
    if not fs.exists(where):
        return {}
    numbers = sorted(int(x.getPath().getName()) for x in fs.listStatus(where) if x.getPath().getName().isdigit())
    found = {n: _text(spark, f"{path}/pointers/{n:08d}") for n in numbers}
    return {n: f"{path}/{text.strip()}" for n, text in found.items() if text.endswith("\n")}


def _taken(spark: SparkSession, path: str) -> int:
    fs, where = _files(spark, f"{path}/pointers")
    return max((int(x.getPath().getName()) for x in fs.listStatus(where) if x.getPath().getName().isdigit()), default=0) if fs.exists(where) else 0


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one by default)."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"{path} has no version {version or ''}".rstrip())
    return spark.read.parquet(known[version or max(known)])


def stage(rows: DataFrame, path: str) -> str:
    """Writes rows to a new data folder, which no reader sees yet; returns its name."""
    name = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    return name


def publish(spark: SparkSession, path: str, name: str, after: int) -> int:
    """Makes a staged folder the version behind `after` (a number from latest()), in one step; Conflict if there is one already."""
    fs, where = _files(spark, f"{path}/pointers/{after + 1:08d}")
    if fs.exists(where):
        raise Conflict(f"{path} has a version {after + 1}")
    try:
        stream = fs.create(where, False)
    except Exception as e:
        raise Conflict(f"{path} has a version {after + 1}") from e
    try:
        stream.write(bytearray(f"{name}\n".encode()))
    finally:
        stream.close()
    return after + 1


def latest(spark: SparkSession, path: str) -> int:
    """The number that the next version follows; 0 for a table without any."""
    return _taken(spark, path)


def write(rows: DataFrame, path: str) -> int:
    """Replaces the table's rows; returns the version."""
    spark = rows.sparkSession
    after = latest(spark, path)
    return publish(spark, path, stage(rows, path), after)


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes the pointers and data of all but the last `keep` versions, and data that no pointer names. Readers of removed versions fail; a writer must not be at work."""
    known = versions(spark, path)
    kept = sorted(known)[-keep:]
    for n in sorted(known)[:-keep]:
        fs, where = _files(spark, f"{path}/pointers/{n:08d}")
        fs.delete(where, False)
    fs, where = _files(spark, path)
    for x in fs.listStatus(where):
        if x.getPath().getName().startswith("data-") and f"{path}/{x.getPath().getName()}" not in {known[n] for n in kept}:
            fs.delete(x.getPath(), True)
