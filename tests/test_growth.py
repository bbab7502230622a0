"""Steps whose work must not outgrow the tables."""

import random

import pytest

from bazaarlake.operators import fuzzy as Z

GROUP = ["session", "slot", "entry"]
LINES = "session long, slot long, entry long, line_no long, text string"


def test_hopeless_entries_are_not_compared(spark, monkeypatch):
    """Two lines have 200 at most, so an entry with five effects has no 50 each; before, all its effects were compared."""
    seen = []
    scores = Z.text_scores
    monkeypatch.setattr(Z, "text_scores", lambda lines, *rest: seen.extend(r["entry"] for r in lines.collect()) or scores(lines, *rest))
    lines = spark.createDataFrame([(1, 0, 1, "luck up"), (1, 0, 2, "attack")], "session long, slot long, line_no long, text string")
    entries = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "entry long, slot long, name string")
    effects = spark.createDataFrame([(1, i, t, None) for i, t in enumerate(["luck up", "attack", "x", "y", "z"])] + [(2, 1, "luck up", None), (2, 2, "attack", None)], "entry long, effect_no long, effect string, condition string")
    assert [(r["entry"], r["per_effect"]) for r in Z.resolve_by_effects(lines, entries, effects).collect()] == [(2, 100.0)]
    assert set(seen) == {2}


@pytest.fixture(scope="module")
def drawn(spark):
    """Groups of lines with few different texts, and scores with many ties."""
    rng = random.Random(5)
    lines = [(s, s % 2, e, n, rng.choice("abcdef")) for s in range(6) for e in range(3) for n in range(rng.randint(1, 5))]
    scores = [(e, t, f, float(rng.choice((40, 55, 70, 70, 90, 100)))) for e in range(3) for t in "abcdef" for f in range(9)]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(scores, "entry long, text string, effect_no long, score double")


def test_contenders_are_enough(spark, drawn):
    """A line of a group of n takes one of its n best effects: all pairs, the contenders and the rounds give the same assignments, and bounds hold."""
    lines, scores = drawn
    every = lines.join(scores, ["entry", "text"]).select(*GROUP, "line_no", "effect_no", "score")
    rows = lambda df: sorted(map(tuple, df.collect()))
    few = Z.contenders(lines, scores, GROUP, ["entry"])
    assert few.count() < every.count() / 2
    greedy = rows(Z.assign_greedy(every, GROUP))
    assert greedy == rows(Z.assign_greedy(few, GROUP)) == rows(Z.assign_greedy(every, GROUP, large=0)) == rows(Z.assign_greedy(every, GROUP, large=20))
    assert rows(Z.assign_in_turn(every, GROUP)) == rows(Z.assign_in_turn(Z.contenders(lines, scores, GROUP, ["entry"], low_first=True), GROUP))
    bounds = {tuple(r)[:3]: r["bound"] for r in Z._bounds(lines, scores, GROUP, ["entry"]).collect()}
    for key in bounds:
        assert sum(r[5] for r in greedy if r[:3] == key) <= bounds[key]


def test_evidence_assigns_few_entries(spark, monkeypatch):
    """Entries whose bound is below what another entry of the slot has are not assigned; before, each entry of a slot without a name was."""
    assigned = []
    greedy = Z.assign_greedy
    monkeypatch.setattr(Z, "assign_greedy", lambda scores, by, *rest: assigned.extend({r["entry"] for r in scores.collect()}) or greedy(scores, by, *rest))
    entries = spark.createDataFrame([(i, 0, f"n{i}") for i in range(8)], "entry long, slot long, name string")
    effects = spark.createDataFrame([(i, j, t + "q" * (i if i else 0), None) for i in range(8) for j, t in enumerate(["luck up", "attack"])], "entry long, effect_no long, effect string, condition string")
    slots = spark.createDataFrame([(1, 0, "??")], "session long, slot long, header string")
    lines = spark.createDataFrame([(1, 0, 1, "luck up"), (1, 0, 2, "attack")], "session long, slot long, line_no long, text string")
    assert [(r["entry"], r["how"], r["effect_score"]) for r in Z.resolve_by_evidence(slots, lines, entries, effects).collect()] == [(0, "effects", 200.0)]
    assert assigned == [0]


def test_names_of_seven_digits(spark, tmp_path):
    """The SQL's names have six digits; numbers beyond are cut in them, but files are paired by their whole names."""
    from bazaarlake.plans import QUERIES
    from bazaarlake.sources.tables import SCHEMAS

    keys = (1, 100001, 1000012, 1000014, 1000011)
    spark.createDataFrame([(k, f"name {k}", "Brand#1", "SMALL", 1, 1.0) for k in keys], SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((tuple(r) for r in QUERIES["src_image_label_pairs"](spark, str(tmp_path)).collect()), key=lambda r: r[2])
    assert got == [("d/000001.png", "name 1", 1), ("d/100001.png", "name 100001", 2), ("d/100001.png", "name 1000011", 3), ("d/100001.png", "name 1000012", 4), ("d/100001.png", "name 1000014", 5)]


def test_messages_before_any_code(spark, tmp_path):
    """A user whose messages arrive in a batch without a code of theirs; before, that failed."""
    from pyspark.sql import functions as F

    from bazaarlake.streaming.jobs import stream_verified

    for kind, column, user, text in (("said", "message", 1, "v-7"), ("codes", "code", 2, "7")):
        times = spark.createDataFrame([(user, text)], f"user_id long, {column} string").withColumn("sent_at" if kind == "said" else "issued_at", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
        times.write.parquet(f"{tmp_path}/{kind}")
    said = spark.readStream.schema("user_id long, message string, sent_at timestamp_ntz").parquet(f"{tmp_path}/said")
    codes = spark.readStream.schema("user_id long, code string, issued_at timestamp_ntz").parquet(f"{tmp_path}/codes")
    updates = stream_verified(said, codes).writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
    updates.option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("user_id long, verified_at timestamp_ntz, final boolean").parquet(f"{tmp_path}/out").filter("verified_at is not null").count() == 0


def test_batches_are_few(spark, tmp_path):
    """However many files a view is written to, they arrive in four batches at most."""
    from bazaarlake.plans.training import _arriving
    from bazaarlake.sources.tables import SCHEMAS, Tables

    rows = [(i, None, i, "signup", 1.0, "{}") for i in range(24)]
    spark.createDataFrame(rows, SCHEMAS["events"]).repartition(24).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        stream = _arriving(Tables(spark, str(tmp_path)), "code_requests", "user_id, code, issued_at")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) <= 4 and sum(p["numInputRows"] for p in query.recentProgress) == 24


def test_partitions_follow_the_tables(spark, tmp_path, monkeypatch):
    """A larger folder's shuffles begin with more partitions; before, a task's share grew with the tables."""
    from bazaarlake.sources import tables as T

    spark.range(200_000).selectExpr("id as l_orderkey", "uuid() as x").write.parquet(f"{tmp_path}/lineitem.parquet")
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(T, "PARTITION_BYTES", 100_000, raising=False)
    T.Tables(spark, str(tmp_path))
    many = int(spark.conf.get(key, "0"))
    monkeypatch.setattr(T, "PARTITION_BYTES", 1 << 40, raising=False)
    T.Tables(spark, str(tmp_path))
    assert many > 30 and int(spark.conf.get(key)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_assignments_pass_a_row_for_each_line(spark, drawn, monkeypatch):
    """Tasks get a line's pairs as one row (before, a row for each pair), from contenders and from pairs; lists that are too large go in rounds."""
    lines, scores = drawn
    seen, take = [], Z._take_free
    monkeypatch.setattr(Z, "_take_free", lambda lists, *rest: seen.append(lists.count()) or take(lists, *rest))
    rows = lambda df: sorted(map(tuple, df.collect()))
    every = lines.join(scores, ["entry", "text"]).select(*GROUP, "line_no", "effect_no", "score")
    lists = Z.contender_lists(lines, scores, GROUP, ["entry"])
    want = {}
    for r in sorted(every.collect(), key=lambda r: (-r["score"], -r["line_no"], -r["effect_no"])):
        taken = want.setdefault(tuple(r)[:3], {})
        if r["line_no"] not in taken and r["effect_no"] not in {e for e, _ in taken.values()}:
            taken[r["line_no"]] = r["effect_no"], r["score"]
    want = sorted((*group, line, *pair) for group, taken in want.items() for line, pair in taken.items())
    assert want == rows(Z.assign_greedy(lists, GROUP)) == rows(Z.assign_greedy(every, GROUP))
    assert rows(Z.assign_in_turn(every, GROUP)) == rows(Z.assign_in_turn(Z.contender_lists(lines, scores, GROUP, ["entry"], low_first=True), GROUP))
    assert seen == [lines.count()] * 4
    assert want == rows(Z.assign_greedy(lists, GROUP, large=5)) == rows(Z.assign_greedy(lists, GROUP, large=0))


def test_rows_of_one_line_are_one(spark):
    """A line that comes twice takes one effect, the best of both rows; nothing is taken at a score of 0."""
    rows = [(1, 1, [3, 2], [90.0, 80.0]), (1, 1, [2, 3], [95.0, 0.0]), (1, 2, [2, 3], [94.0, 10.0]), (1, 3, [], []), (2, 4, [1], [0.0])]
    lists = spark.createDataFrame(rows, "g int, line_no int, effects array<int>, scores array<double>")
    assert sorted(map(tuple, Z.assign_greedy(lists, ["g"]).collect())) == [(1, 1, 2, 95.0), (1, 2, 3, 10.0)]
    assert sorted(map(tuple, Z.assign_in_turn(lists, ["g"]).collect())) == [(1, 1, 2, 95.0), (1, 2, 3, 10.0), (2, 4, 1, 0.0)]


def test_unmatched_lines_do_not_assign_again(spark, tmp_path):
    """The assigned pairs are read twice, for themselves and for the lines without one, but found once."""
    path = str(tmp_path / "runs")

    def run(batches):
        with open(path, "a") as f:
            f.write("x")
        yield from batches

    pairs = spark.createDataFrame([(1, 1, 1, 30.0)], "session int, line_no int, effect_no int, score double").coalesce(1).mapInArrow(run, "session int, line_no int, effect_no int, score double")
    lines = spark.createDataFrame([(1, 1), (1, 2)], "session int, line_no int")
    assert sorted(map(tuple, Z.with_unmatched(pairs, lines, ["session"]).collect())) == [(1, 1, 1, 30.0), (1, 2, -1, 0.0)]
    assert open(path).read() == "x"


def test_corrections_pass_a_row_for_each_line(spark, tmp_path, monkeypatch):
    """fz_effect_correct assigns a row for each line; before, one for each of a line's 20 best pairs."""
    from bazaarlake.plans import QUERIES
    from bazaarlake.sources.tables import SCHEMAS

    rows = [(i, f"name {i % 7}", f"Brand#{i // 40 + 1}", ("LARGE", "SMALL")[i % 3 == 0], 1, 1.0) for i in range(80)]
    spark.createDataFrame(rows, SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    seen, take = [], Z._take_free
    monkeypatch.setattr(Z, "_take_free", lambda lists, *rest: seen.append(lists.count()) or take(lists, *rest))
    got = QUERIES["fz_effect_correct"](spark, str(tmp_path)).collect()
    assert 0 < len(got) <= len({r["line_no"] for r in got}) and len(got) <= seen[0] <= 80


def test_attributes_read_the_listings_once(spark):
    """ext_item_attrs makes a listing's lines from one row of it and compares each line in one call; before, the view of listings was computed for each of the seven lines, and each label was a call."""
    import re

    from bazaarlake.plans import QUERIES

    plan = QUERIES["ext_item_attrs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet", plan)) == 3 and len(re.findall(r"\bArrowEvalPython\b", plan)) == 1 and "run(" in plan


def test_labels_of_odd_lines(spark):
    """Blanks alone behind a label are nothing, other white space is something; of equally near labels the first counts; groups without a label are left out, those without a value are not."""
    from bazaarlake.operators.extract import item_attributes

    rows = [
        (1, "ab 5"), (2, "ac 6"), (2, None), (3, "ab   "), (4, "ab\t"), (5, "zz 7"), (6, ""), (7, "abcdefgh 3 +4"), (8, "abcdefgh 12"), (9, "ab"), (10, "abcdefgh 5\t+\t6 + 7"), (None, "ad 8.5"),
    ]
    labels = {"ab": "first", "ad": "first", "abcdefgh": "sum"}
    got = {r["k"]: tuple(r)[1:] for r in item_attributes(spark.createDataFrame(rows, "k int, text string"), "k", labels, 50).collect()}
    none = (None,) * 4
    assert got == {1: (5.0, None, None, None), 2: (6.0, None, None, None), 4: none, 7: (3.0, None, None, None), 8: (12.0, None, None, None), 10: (5.0, None, None, None), None: (None, 8.5, None, None)}
    sums = {r["k"]: tuple(r)[1:] for r in item_attributes(spark.createDataFrame(rows, "k int, text string"), "k", {"abcdefgh": "sum"}).collect()}
    assert sums == {7: (3.0, 4.0), 8: (12.0, None), 10: (5.0, 6.0)}
    assert item_attributes(spark.createDataFrame(rows, "k int, text string"), "k", {"abcdefgh": "sum"}).columns == ["k", "abcdefgh", "additional_abcdefgh"]


def test_texts_are_compared_in_one_step(spark):
    """Each text meets its key's effects in one Python step that has several tasks; before, a filter on the score was moved below the step that finds different pairs, so all pairs were scored there and again behind it, and tables of few bytes were scored in one task."""
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(1, f"name {i}") for i in range(300)], "entry long, text string")
    effects = spark.createDataFrame([(1, i, f"name {i}", None) for i in range(20)], "entry long, effect_no long, effect string, condition string")
    scores = Z.text_scores(lines, effects, ["entry"], 50.0)
    plan = scores._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
    assert scores.select(F.spark_partition_id()).distinct().count() > 1


def test_scores_of_odd_texts(spark):
    """Texts that are empty, null or longer than a row's bits, effects that are null, come twice, have a condition or fill several blocks: as each pair by itself. Contenders from lists are those from rows."""
    from bazaarlake.functions.similarity import ratio

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ab é가😀") for _ in range(rng.choice((0, 1, 3, 8, 20, 64, 65, 130, 256, 257, 300))))
    texts = [(e, word()) for e in range(3) for _ in range(90)] + [(1, None), (7, "a")]
    given = [(e, n, rng.choice((word(), word(), None)), rng.choice((None, None, "if", ""))) for e in range(4) for n in (*range(1, 260, 2), 5, 7, -3)]
    want = {}
    for e, t in texts:
        for _, n, effect, condition in (x for x in given if x[0] == e and t is not None):
            forms = {" ".join(x for x in (condition, effect) if x is not None), effect} - {None}
            want[e, t, n] = max(want.get((e, t, n), 0.0), *(ratio(t, x) for x in forms), 0.0)
    lines = spark.createDataFrame([(i % 50, e, i, t) for i, (e, t) in enumerate(texts)], "session long, entry long, line_no long, text string")
    effects = spark.createDataFrame(given, "entry long, effect_no long, effect string, condition string")
    for floor in (0.0, 50.0):
        got = {tuple(r)[:3]: r[3] for r in Z.text_scores(lines, effects, ["entry"], floor).collect()}
        assert got == {k: v for k, v in want.items() if v >= floor}
    by = ["session", "entry"]
    for low_first in (False, True):
        few = [{tuple(r)[:3]: (r["effects"], r["scores"]) for r in Z.contender_lists(lines, f(lines, effects, ["entry"]), by, ["entry"], low_first).collect()} for f in (Z.text_score_lists, Z.text_scores)]
        assert few[0] == few[1] and len(few[0]) == 270
