"""Snapshot tables, ordered exports, and state that expires."""

import json
import os

import pytest
from pyspark.sql import functions as F


def test_versions_and_readers(spark, tmp_path):
    """A reader keeps its version; a failed write and a writer that comes late change nothing; a pointer without its line end is none."""
    from bazaarlake.operators.ingest import write_upsert
    from bazaarlake.sources import snapshots

    path = "file://" + str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, name string")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.write(rows((1, "a"), (2, "b")), path) == 1
    reader = snapshots.read(spark, path)
    broken = rows((3, "c")).withColumn("name", F.raise_error(F.lit("no disk")).cast("string"))
    with pytest.raises(Exception, match="no disk"):
        write_upsert(path, broken, "id")
    assert snapshots.latest(spark, path) == 1 and snapshots.read(spark, path).count() == 2
    slow, fast = snapshots.stage(rows((8, "slow")), path), snapshots.stage(rows((9, "fast")), path)
    assert snapshots.publish(spark, path, fast, 1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, path, slow, 1)
    assert sorted(map(tuple, reader.collect())) == [(1, "a"), (2, "b")] and [r["name"] for r in snapshots.read(spark, path).collect()] == ["fast"]
    write_upsert(path, rows((9, "again"), (10, "new")), "id")
    assert sorted(map(tuple, snapshots.read(spark, path).collect())) == [(9, "again"), (10, "new")]
    assert [r["name"] for r in snapshots.read(spark, path, 2).collect()] == ["fast"]
    (tmp_path / "t/pointers/00000004").write_text("data-unfinished")
    assert snapshots.read(spark, path).count() == 2 and sorted(snapshots.versions(spark, path)) == [1, 2, 3]
    assert snapshots.write(rows((7, "x")), path) == 5
    snapshots.forget(spark, path, keep=2)
    assert sorted(snapshots.versions(spark, path)) == [3, 5] and snapshots.read(spark, path, 3).count() == 2
    assert sum(x.startswith("data-") for x in os.listdir(tmp_path / "t")) == 2


@pytest.mark.parametrize("kind", ["json", "text"])
def test_exports_are_in_order(spark, tmp_path, kind):
    from bazaarlake.sources.exports import read_ordered, write_ordered

    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"k{i % 50:02d}", None if i % 7 == 0 else i) for i in range(500)], "name string, n int").repartition(9)
    rows = rows if kind == "json" else rows.select(F.concat_ws("\t", "name", F.coalesce(F.col("n"), F.lit(-1)).cast("string")).alias("name"))
    write_ordered(rows, path, ["name"], kind, parts=6)
    files = sorted(x for x in os.listdir(path) if x.startswith("part-"))
    lines = [line for x in files for line in open(os.path.join(path, x)).read().splitlines()]
    names = [json.loads(x)["name"] if kind == "json" else x for x in lines]
    assert len(files) > 3 and len(lines) == 500 and names == sorted(names) and os.path.exists(path + "/_SUCCESS")
    assert kind == "text" or all("n" in json.loads(x) for x in lines)
    back = read_ordered(spark, path, rows.schema if kind == "json" else None).orderBy("file", "at").collect()
    assert [r[0] for r in back] == names if kind == "json" else [r["value"] for r in back] == names


def test_verified_state_expires(spark, tmp_path):
    """Once the watermark has passed a user's codes and hit, the user's state is gone, and the hit is final, also if a later code is met again."""
    from bazaarlake.streaming.jobs import stream_verified

    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    steps = [
        ([(1, "c1", 0), (2, "c2", 1), (3, "zz", 2)], [(1, "my c1", 5), (2, "no", 6)]),
        ([(9, "q", 100)], [(9, "x", 100)]),
        ([(9, "q", 200)], [(9, "x", 201)]),
        ([(1, "c1", 210)], [(1, "c1", 212)]),
        ([(9, "q", 400)], [(9, "x", 401)]),
        ([(9, "q", 500)], [(9, "x", 501)]),
    ]
    for kind, columns in (("codes", "user_id long, code string, m int"), ("said", "user_id long, message string, m int")):
        for i, step in enumerate(steps):
            rows = step[kind == "said"]
            times = spark.createDataFrame([(u, x, at(m)) for u, x, m in rows], "user_id long, x string, t string")
            name = ("code", "issued_at") if kind == "codes" else ("message", "sent_at")
            times.select("user_id", F.col("x").alias(name[0]), F.col("t").cast("timestamp_ntz").alias(name[1])).coalesce(1).write.parquet(f"{tmp_path}/{kind}/{i}")
            part = next(x for x in os.listdir(f"{tmp_path}/{kind}/{i}") if x.endswith(".parquet"))
            os.makedirs(f"{tmp_path}/in-{kind}", exist_ok=True)
            os.rename(f"{tmp_path}/{kind}/{i}/{part}", f"{tmp_path}/in-{kind}/{i}.parquet")
            os.utime(f"{tmp_path}/in-{kind}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    read = lambda kind, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in-{kind}")
    updates = stream_verified(read("said", "user_id long, message string, sent_at timestamp_ntz"), read("codes", "user_id long, code string, issued_at timestamp_ntz"), "30 minutes", "10 minutes")
    seen, states = [], []

    def keep(batch, _):
        seen.extend(tuple(r) for r in batch.select("user_id", F.date_format("verified_at", "HH:mm"), "final").collect())

    query = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] <= 1 and max(states) >= 3, states
    assert (1, "00:05", False) in seen and (1, "00:05", True) in seen and (1, "03:32", True) in seen
    assert min(t for u, t, final in seen if u == 1 and final) == "00:05" and not any(u in (2, 3) for u, _, _ in seen)


def test_medians_by_ranks(spark):
    """Against percentile, with a group of half the rows, repeated values, null values and null groups; no task has a group's rows."""
    import random

    from bazaarlake.operators.lines import medians

    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "c"]), rng.choice([None, 1, 1, 1, rng.randrange(50), rng.randrange(-9, 9)])) for _ in range(3000)] + [("one", 7), ("two", 1), ("two", 2), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("m")).collect() if r["m"] is not None}
    found = medians(df, ["g"], "v").collect()
    assert {r["g"]: r["median"] for r in found} == want and len(found) == len(want)


def test_changes_of_files(spark, tmp_path):
    """Files that change, come and go; a state only gets a version if something did; the tree's root against plain hashing."""
    import hashlib
    from collections import defaultdict

    from bazaarlake.operators.ingest import file_digests, refresh_files, tree_digest
    from bazaarlake.sources import snapshots

    folder, state = tmp_path / "in", str(tmp_path / "state")
    (folder / "a").mkdir(parents=True)
    for i in range(40):
        (folder / "a" / f"{i}.txt").write_bytes(b"" if i == 7 else f"text {i}".encode())

    def files():
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
        return rows.select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "content")

    def run():
        got = sorted((r["change"], r["path"]) for r in refresh_files(files(), state).filter("change <> 'unchanged'").collect())
        return got, snapshots.latest(spark, state)

    assert run() == (sorted(("added", f"{i}.txt") for i in range(40) if i != 7), 1)  # the source lists no empty file
    assert run() == ([], 1)
    (folder / "a" / "3.txt").write_bytes(b"other")
    (folder / "a" / "4.txt").unlink()
    (folder / "a" / "new.txt").write_bytes(b"new")
    assert run() == ([("added", "new.txt"), ("changed", "3.txt"), ("removed", "4.txt")], 2)

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    each = {sha(p.name): hashlib.sha256(p.read_bytes()).hexdigest() for p in (folder / "a").iterdir() if p.stat().st_size}
    digests = file_digests(files())
    for bucket, levels in ((256, 0), (4, 1), (1, 2)):  # 39 files
        nodes = each
        for level in range(levels, -1, -1):
            groups = defaultdict(list)
            for at, digest in sorted(nodes.items()):
                groups[at[:level]].append(f"{at}:{digest}")
            nodes = {at: sha("\n".join(lines)) for at, lines in groups.items()}
        assert tree_digest(digests.repartition(3), bucket).collect()[0]["root"] == nodes[""]
    assert tree_digest(digests.limit(0)).collect()[0]["root"] == sha("")
