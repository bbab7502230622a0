"""Line forms of extraction and correction, the fuzzy candidate index, pages beyond the end."""

import random

import pytest
from pyspark.sql import functions as F


def test_attribute_forms(spark):
    from bazaarlake.operators.extract import item_attributes

    rows = [
        (1, "공격 45~123 +5"), (2, "공격 45 / 7"), (3, "공격 45"), (1, "내구력 11/12 (5)"), (2, "내구력 12"), (1, "밸런스 26.5 %"), (2, "밸런스 30"), (1, "피어싱 레벨 6+ 3"), (2, "피어싱 레벨 6"),
        (3, "피어싱 레벨 6 +3"), (1, "방어력 5.5 (9)"), (2, "방어럭 7"), (3, "방어력"), (3, "보호"), (4, "마법 방어 50, 마법 보호 90"), (5, None), (6, ""),
    ]
    kinds = {"공격": "range", "내구력": "fraction", "밸런스": "percent", "피어싱 레벨": "sum", "방어력": "first"}
    found = {r[0]: tuple(r)[1:] for r in item_attributes(spark.createDataFrame(rows, "id int, text string"), "id", kinds, 60).collect()}
    assert found == {1: (123, 12, 26.5, 6, 3, 5.5), 2: (7, None, None, 6, None, 7), 3: (None, None, None, 6, 3, None)}


def test_upgrade_grade_and_colour_forms(spark):
    from bazaarlake.operators.extract import color_part, erg, special_upgrade

    upgrades = {
        "특별 개조 R (7단계)": ("R", 7), "특별 개조 S7단계": ("S", 7), "특별개조R[8 단계]": ("R", 8), "특별 개조 S 9단계": ("S", None), "특별 개조 R7": (None, None), "뭔가 다른 줄 R (7단계)": (None, None), "R (7단계)": (None, None),
        "": (None, None), None: (None, None), "특별 개조 S ( 99999999999단계": ("S", None),
    }
    rows = spark.createDataFrame([(t,) for t in upgrades], "text string").select("text", special_upgrade(F.col("text"), "특별 개조").alias("u"))
    assert {r["text"]: tuple(r["u"]) for r in rows.collect()} == upgrades
    grades = [
        (1, 1, "A (3/4 레벨)"), (1, 2, "등급 S 25/50 레벨"), (1, 3, "등급 A (1/50 레벨)"), (2, 1, "등급 B [60/ 50 레벨]"), (3, 1, "등급 C (1/2 레벨)"), (3, 2, "등급 A 1/2"), (4, 1, None), (5, 5, "x 등급  A(7 /0레벨"),
    ]
    found = erg(spark.createDataFrame(grades, "session int, pos int, text string"), "session", "pos")
    assert sorted(map(tuple, found.collect())) == [(1, "S", 25, 50), (2, "B", None, 50), (5, "A", 7, None)]
    colours = {"파트 A R:0 G:0 B:12": ("A", 0, 0, 12), "- 파트B R 1 G : 2": ("B", 1, 2, None), "R:1 G:2 B:3": None, "파트 G R:1": None, None: None}
    rows = spark.createDataFrame([(t,) for t in colours], "text string").select("text", color_part(F.col("text")).alias("c"))
    assert {r["text"]: r["c"] and tuple(r["c"]) for r in rows.collect()} == colours


def test_correction_forms(spark):
    from bazaarlake.operators.fuzzy import correct_normalized

    dictionary = spark.createDataFrame([("reforge", "smash damage"), ("enchant", "shock"), ("x", "dmg n up"), ("x", "N n rank")], "section string, entry string")
    want = {
        ("x", "· dmg 5 up (전용 해제)"): ("· dmg 5 up", 100, "(전용 해제)"), ("x", ", dmg 5 up"): (", dmg 5 up", 100, None), ("x", "L dmg 5 up (1%~2%) (x)"): ("L dmg 5 up", 100, "(1%~2%)"), ("x", ".dmg 7.5 up"): (".dmg 7.5 up", 100, None),
        ("x", "N rank"): None, ("reforge", "- smash damage(15/20 레벨)"): ("- smash damage(15/20 레벨)", 100, None), ("x", "dmg 5 up 3/4 레벨"): None, ("enchant", "[접두] shock (랭크 F)"): ("shock", 100, None),
        ("enchant", "[접두] shack (랭크 6)"): ("shock", 80, None), ("none", "· a (b)"): ("· a (b)", -2, None), ("x", "- "): ("- ", 0, None), ("x", "(all)"): ("(all)", 0, None), ("x", None): (None, 0, None), (None, "ㄴ dmg 9 ap"): ("ㄴ dmg 9 up", None, None),
    }
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(want)], "id int, section string, text string")
    found = {r["id"]: (r["corrected"], r["score"], r["paren_range"]) for r in correct_normalized(rows, dictionary).collect()}
    for i, (key, expected) in enumerate(want.items()):
        if expected is None:
            assert found[i][1] != 0, (key, found[i])
        else:
            assert found[i][0] == expected[0] and found[i][2] == expected[2] and (expected[1] is None or found[i][1] == expected[1]), (key, found[i])
    assert found[list(want).index(("x", "dmg 5 up 3/4 레벨"))][1] < 80  # a level is cut in its own sections only


def test_level_cut_only_where_asked(spark):
    from bazaarlake.operators.fuzzy import correct_normalized

    dictionary = spark.createDataFrame([("a", "luck")], "section string, entry string")
    rows = spark.createDataFrame([("a", "luck (1/20 레벨)x"), ("a", "luck 1/20 레벨")], "section string, text string")
    cut = {r["text"]: r["score"] for r in correct_normalized(rows, dictionary, leveled=("a",)).collect()}
    assert cut["luck 1/20 레벨"] == 100 and abs(cut["luck (1/20 레벨)x"]) < 100
    assert all(abs(r["score"]) < 100 for r in correct_normalized(rows, dictionary).collect())


@pytest.fixture(scope="module")
def names():
    rng = random.Random(2)
    letters = "abcdefgh"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(40)]
    entries = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(220)} | {"a", "é", "aaaaaaaa", "접두사 이름"})

    def noisy(text):
        out = list(text)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(out) + 1)
            out[i : i + rng.randrange(2)] = rng.choice(["", "x", rng.choice(letters)])
        return "".join(out)

    return entries, [noisy(rng.choice(entries)) for _ in range(250)] + ["", "a", "zzzz", "aaaa", "접두사 이롬"]


@pytest.mark.parametrize("cutoff", [50, 80, 92.5, 100])
def test_candidates_lose_nothing(spark, names, cutoff):
    """All pairs that reach the cutoff, and (at 80) fewer than a tenth of all pairs."""
    from bazaarlake.functions.similarity import ratio
    from bazaarlake.operators.fuzzy import candidates

    entries, texts = names
    rows = spark.createDataFrame(sorted({(i % 2, t) for i, t in enumerate(texts)}), "key int, _t string")
    listed = spark.createDataFrame([(k, e, "extra") for k in (0, 1) for e in entries if k or len(e) % 2], "key int, _e string, other string")
    found = {(r["key"], r["_t"], r["_e"]) for r in candidates(rows, listed, cutoff, ["key"]).collect()}
    every = [(r["key"], r["_t"], x["_e"]) for r in rows.collect() for x in listed.filter(f"key = {r['key']}").collect()] if len(texts) < 20 else [(k, t, e) for k, t in {(i % 2, t) for i, t in enumerate(texts)} for e in entries if k or len(e) % 2]
    assert {p for p in every if p[1] and ratio(p[1], p[2]) >= cutoff} <= found
    assert cutoff < 80 or len(found) < len(every) / 10


def test_nearest_is_the_best_of_all(spark, names):
    from bazaarlake.functions.similarity import ratio
    from bazaarlake.operators.fuzzy import nearest

    entries, texts = names
    rows = spark.createDataFrame([(t, 1) for t in texts], "text string, key int")
    found = {r["text"]: (r["name"], r["score"]) for r in nearest(rows, spark.createDataFrame([(e, 1) for e in entries], "name string, key int"), "text", "name", 80, ["key"]).collect()}
    for t in set(texts):
        score, best = min((-ratio(t, e), e) for e in entries)
        assert found.get(t) == ((best, -score) if score < 0 else None), t


def test_page_beyond_the_end(spark):
    from bazaarlake.operators.logs import log_page

    logs = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(9)], "id int, action string")
    page = lambda limit, offset, action="a": [tuple(r) for r in log_page(logs, F.col("action") == action, limit, offset).collect()]
    assert page(2, 1) == [(5, "a", 4), (3, "a", 4)] and page(5, 9) == [(None, None, 4)] and page(5, 0, "z") == [(None, None, 0)]


def test_effects_parsed(spark):
    from bazaarlake.operators.ingest import parse_effects

    texts = {
        "max dmg 5~7 증가": ("max dmg", 5, 7), "max dmg 5 ~ 7 % 감소": ("max dmg", -5, -7), "luck 2.5%증가": ("luck (%)", 2.5, 2.5), "luck 3 감소": ("luck (%)", -3, -3), "luck 3": None, "luck 증가": None, "3 증가": None, "luck 1~2~3 증가": None,
        "level 2 luck 3 증가": ("level 2 luck", 3, 3), " luck  4 증가 ": ("luck (%)", 4, 4), "luck 1.2.3 증가": None, None: None, "": None, "unknown 3 증가": None,
    }
    effects = spark.createDataFrame([("max dmg",), ("luck (%)",), ("level 2 luck",)], "name string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r["id"]: tuple(r)[1:] for r in parse_effects(rows, effects).collect()}
    assert [found[i] for i in range(len(texts))] == [x or (None, None, None) for x in texts.values()]
