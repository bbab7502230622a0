"""The corpus pipeline: each stage on odd rows, and all of them against brute force."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def made_up(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents (with clashing columns), labels and benchmark as Parquet; and the rows of documents."""
    rng = random.Random(1)
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = made_up(rng, 30)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, made_up(rng, 60) + (" idiot moron trash" * 2 if toxic else ""), "ab"[i % 2]))
        if i < 350:
            labels.append((i, int(toxic)))
    base = rows[9][1]
    rows += [(400, base, "a"), (401, base.upper(), "b"), (402, base, None), (403, base.replace("w1", "changed", 1) if "w1" in base else base + " x", "a")]
    rows += [(404, f"{made_up(rng, 20)} {passage[: len(passage) // 2]} {made_up(rng, 20)}", "b"), (405, None, "a"), (406, "", "a"), (407, made_up(rng, 9000), "a")]
    rows += [(None, made_up(rng, 30), "a"), (None, base, "a"), (10, rows[10][1], "a"), (11, made_up(rng, 40), "b")]
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, source string, copies string, _score int, copy_no double").repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_pipeline(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"]

    def kept(name, before):
        after = stages[name](spark, before, folder)
        assert after.columns == columns
        path = f"{folder}/{name.replace(' ', '-')}"
        after.write.parquet(path)
        return spark.read.parquet(path)

    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    clean = kept("toxicity", docs)
    assert ids(clean) == sorted(str(i) for i, text, _ in rows if "idiot" not in (text or ""))
    once = kept("exact dedup", clean)
    gone = ["400", "401", "402", "406", "10"]  # copies of 9, the second empty text, the repeated row
    assert ids(once) == sorted([x for x in ids(clean) if x not in gone] + ["10"])
    apart = kept("n-gram Jaccard join", once)
    assert sorted(set(ids(once)) - set(ids(apart))) == ["403"]
    free = kept("benchmark decontamination", apart)
    assert sorted(set(ids(apart)) - set(ids(free))) == ["404"]
    mixed = stages["mixing"](spark, free, folder)
    assert mixed.columns == columns and dict(mixed.dtypes)["copy_no"] == "int"
    got = mixed.collect()
    assert all(1 <= r["copy_no"] <= 2 and r["doc_id"] is not None for r in got)
    assert len({(r["doc_id"], r["text"], r["copy_no"]) for r in got}) == len(got)
    # all stages in a row, twice
    once = sorted((r["doc_id"], r["copy_no"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert once == sorted((r["doc_id"], r["copy_no"]) for r in got)


def test_stages_on_empty_tables(spark, tables):
    folder, _ = tables
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
