"""Hand-made cases: rules, lines, fuzzy matching, resolution, streams, ingestion."""

import pytest
from pyspark.sql import functions as F


def cond(table, column, op, value, **more):
    return {"table": table, "column": column, "op": op, "value": value, **more}


@pytest.fixture(scope="module")
def listing(spark):
    row = [(1, ("sword", 90, None), ("Fire", 5), [("reforge", "Smash", 20.0, 20.0), ("reforge", "Dash", 3.0, 20.0), ("murias", "Luck", 1.0, 9.0)])]
    return spark.createDataFrame(row, "id int, listing struct<name: string, damage: int, price: int>, prefix struct<name: string, rank: int>, options array<struct<option_type: string, option_name: string, rolled_value: double, max_level: double>>").withColumn("suffix", F.expr("cast(null as struct<name: string, rank: int>)"))


RULES = [
    ([cond("listing", "damage", ">=", 90)], "t", ["t"]),
    ([cond("listing", "damage", ">=", "90")], "t", ["t"]),
    ([cond("listing", "damage", "==", "90")], "t", ["t"]),
    ([cond("listing", "name", ">", 3)], "t", []),
    ([cond("listing", "price", "==", None)], "t", ["t"]),
    ([cond("listing", "price", "!=", 5)], "t", []),
    ([cond("suffix", "name", "==", None)], "t", []),
    ([cond("listing", "name", "contains", "wor")], "t", ["t"]),
    ([cond("listing", "name", "in", ["bow", "sword"])], "t", ["t"]),
    ([cond("listing", "damage", "in", ["90"])], "t", []),
    # left to right: (false AND true) OR true; (true OR true) AND false
    ([cond("listing", "damage", "<", 1), cond("prefix", "rank", "==", 5), cond("listing", "name", "==", "sword", logic="OR")], "t", ["t"]),
    ([cond("listing", "damage", ">", 1), cond("prefix", "rank", "==", 5, logic="OR"), cond("listing", "name", "==", "bow")], "t", []),
    ([cond("prefix", "name", "!=", None, refer="p"), cond("listing", "damage", ">", 1, refer="d")], "{p} {d}{x}", ["Fire 90"]),
    ([cond("option", "option_type", "==", "reforge"), cond("option", "option_name", "!=", None, refer="o")], "{o}!", ["Smash!", "Dash!"]),
    ([cond("option", "rolled_value", "==", {"table": "option", "column": "max_level"}), cond("option", "option_name", "!=", None, refer="o")], "max {o}", ["max Smash"]),
    ([cond("option", "option_name", "==", "Smash", group=1), cond("option", "option_name", "==", "Luck", group=2)], "both", ["both"]),
    ([cond("option", "option_name", "==", "Smash", group=1), cond("option", "option_name", "==", "Nil", group=2)], "both", []),
    ([cond("option", "option_name", "==", "Smash"), cond("option", "option_type", "==", "murias")], "same row", []),
    ([cond("listing", "price", "==", None, refer="p")], "{p}", []),
    ([], "t", []),
]


@pytest.mark.parametrize("case", range(len(RULES)))
def test_rules(listing, case):
    from bazaarlake.operators.rules import compile_rule

    conditions, template, tags = RULES[case]
    objects = {n: F.col(n) for n in ("listing", "prefix", "suffix")}
    rule = compile_rule({"conditions": conditions, "tag_template": template}, objects, {"option": F.col("options")}, ("name", "option_name", "option_type"))
    assert listing.select(rule).first()[0] == tags


def test_broken_rules_are_skipped(listing):
    from bazaarlake.operators.rules import run_rules

    good = {"conditions": [cond("listing", "damage", ">", 1)], "tag_template": "g"}
    rules = [{"id": 1, "config": "{"}, {"id": 2, "config": {"conditions": [{"table": "listing"}], "tag_template": "x"}}, {"id": 3, "priority": -1, "config": good}, {"id": 4, "enabled": False, "config": good}]
    assert run_rules(listing, rules, {"listing": F.col("listing")}, {}).first()["tags"] == ["g"]


def lines(spark, kinds, **columns):
    rows = [("s", i, k, f"{k}{i}") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "session string, pos int, kind string, text string")


def test_continuations(spark):
    from bazaarlake.operators.lines import merge_continuations

    df = lines(spark, ["plain", "bullet", "plain", "grey", "plain", "header", "plain", "bullet", "sub", "plain"])
    got = [r["text"] for r in merge_continuations(df, ["session"], "pos").orderBy("pos").collect()]
    assert got == ["plain0", "bullet1 plain2 plain4", "grey3", "header5", "plain6", "bullet7 plain9", "sub8"]


@pytest.mark.parametrize(("kinds", "labels"), [(["header", "bullet", "header"], ["prefix", "suffix"]), (["grey", "header"], ["suffix"]), (["header", "grey"], ["prefix"]), (["header"] * 3, [None] * 3)])
def test_slot_labels(spark, kinds, labels):
    from bazaarlake.operators.lines import slot_labels

    assert [r["label"] for r in slot_labels(lines(spark, kinds), ["session"], "pos").orderBy("pos").collect()] == labels


def test_gap_outlier(spark):
    from bazaarlake.operators.lines import distance_groups, gap_outlier

    def of(tops):
        return spark.createDataFrame([("s", i, y, 10) for i, y in enumerate(tops)], "session string, pos int, y int, height int")

    assert gap_outlier(of([0, 12, 24, 60]), ["session"], "pos").first()["outlier"] == 3
    assert gap_outlier(of([0]), ["session"], "pos").first()["outlier"] is None
    assert [r["group_no"] for r in distance_groups(of([0, 12, 24, 60]), ["session"], "pos").orderBy("pos").collect()] == [0, 0, 0, 1]


def test_running_mean(spark):
    from bazaarlake.operators.lines import merge_next_lines

    df = spark.createDataFrame([("s", i, i * 10, 10, c, str(i)) for i, c in enumerate((1.0, 0.0, 0.5))], "session string, pos int, y int, height int, confidence double, text string")
    assert tuple(merge_next_lines(df, ["session"], "pos").first())[2:] == ("0 1 2", 0.5)


@pytest.mark.parametrize(("a", "b", "score"), [("abc", "abc", 100), ("abc", "", 0), ("", "", 100), ("abcd", "abd", 200 * 3 / 7), ("각나", "나각", 50)])
def test_ratio(spark, a, b, score):
    from bazaarlake.functions.similarity import _lcs, can_reach, ratio, register_fz_ratio

    register_fz_ratio(spark)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.selectExpr("fz_ratio(a, b)").first()[0] == pytest.approx(score) == pytest.approx(ratio(a, b))
    assert _lcs(a, b) == _lcs(b, a)
    if score >= 40:
        assert df.select(can_reach(F.col("a"), F.col("b"), score)).first()[0]


def test_partial_ratio():
    from bazaarlake.functions.similarity import _partial

    assert _partial("reforge", "xx reforge yy") == 100 and _partial("ab", "") == 0 and 0 < _partial("abc", "xbz") < 100


def test_normalized_correction(spark):
    from bazaarlake.operators.fuzzy import correct_normalized

    dictionary = spark.createDataFrame([("a", "max damage n up"), ("a", "luck n"), ("b", "speed n")], "section string, entry string")
    rows = [(1, "a", "- mux damage 12 up (3~6)"), (2, "c", "luck 3"), (3, None, "sped 7"), (4, "a", "zzzzzzzz"), (5, "a", None), (6, "a", "- ")]
    got = {r["id"]: r for r in correct_normalized(spark.createDataFrame(rows, "id int, section string, text string"), dictionary).collect()}
    assert (got[1]["corrected"], got[1]["paren_range"]) == ("- max damage 12 up", "(3~6)") and got[1]["score"] > 80
    assert (got[2]["corrected"], got[2]["score"]) == ("luck 3", -2) and got[3]["corrected"] == "speed 7"
    assert got[4]["score"] <= 0 and got[5]["corrected"] is None and got[5]["score"] == 0 and got[6]["corrected"] == "- "


def test_assignments(spark):
    from bazaarlake.operators.fuzzy import assign_greedy, assign_in_turn

    rows = [(1, 1, 1, 70.0), (1, 1, 2, 60.0), (1, 2, 1, 90.0), (1, 2, 2, 50.0), (1, 3, 3, 0.0), (2, 1, 1, 80.0), (2, 1, 2, 80.0)]
    scores = spark.createDataFrame(rows, "session int, line_no int, effect_no int, score double")
    pairs = lambda df: sorted((r[0], r[1], r[2]) for r in df.collect())
    assert pairs(assign_greedy(scores, ["session"])) == [(1, 1, 2), (1, 2, 1), (2, 1, 2)]
    assert pairs(assign_in_turn(scores, ["session"], 1.0)) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_resolution(spark):
    from bazaarlake.operators import fuzzy as Z

    entries = spark.createDataFrame([(1, 0, "flame"), (2, 0, "flume"), (3, 0, "stone")], "entry long, slot long, name string")
    effects = spark.createDataFrame([(1, 1, "attack 1 ~ 5", None), (1, 2, "luck up", None), (2, 1, "defense down", "if"), (3, 1, "critical hit rate", None)], "entry long, effect_no long, effect string, condition string")
    slots = spark.createDataFrame([(1, 0, "flxme"), (2, 0, "?"), (3, 0, "stone")], "session long, slot long, header string")
    lines = spark.createDataFrame([(1, 0, 1, "if defense down"), (2, 0, 1, "critical hit rate"), (1, 0, 2, "zz")], "session long, slot long, line_no long, text string")
    got = {r["session"]: (r["entry"], r["how"]) for r in Z.resolve_by_evidence(slots, lines, entries, effects).collect()}
    assert got == {1: (2, "evidence"), 2: (3, "effects"), 3: (3, "name")}
    lines = spark.createDataFrame([(1, 0, 1, "luck up"), (1, 0, 2, "attack 4")], "session long, slot long, line_no long, text string")
    resolved = spark.createDataFrame([(1, 0, 1)], "session long, slot long, entry long")
    assert {r["text"] for r in Z.fill_template(lines, resolved, effects).collect()} == {"luck up", "attack 4"}
    assert Z.resolve_by_effects(lines, entries, effects).first()["entry"] == 1


def test_item_names(spark):
    from bazaarlake.operators.fuzzy import resolve_item_names

    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    texts = spark.createDataFrame([(1, "blessed fiery lucky long sword"), (2, "sword"), (3, "qqq")], "id long, text string")
    got = {r["id"]: r for r in resolve_item_names(texts, names("blessed"), names("spirit"), names("long sword", "sword"), names("fiery"), names("lucky")).collect()}
    assert (got[1]["blessing"], got[1]["prefix"], got[1]["suffix"], got[1]["item"]) == ("blessed", "fiery", "lucky", "long sword")
    assert got[2]["item"] == "sword" and got[3]["item"] is None


def test_effect_numbers(spark):
    from bazaarlake.functions.text import effect_number

    texts = [("max damage 53 up", "max damage", 53.0), ("bonus 1% up", "bonus", 1.0), ("no number here", None, None), ("rate 1.5 up", "rate", 1.5)]
    name, value = effect_number(F.col("t"))
    got = spark.createDataFrame([(t,) for t, _, _ in texts], "t string").select("t", name, value).collect()
    assert [tuple(r) for r in got] == texts


def test_upsert_written(spark, tmp_path):
    from bazaarlake.operators.ingest import write_upsert
    from bazaarlake.sources import snapshots

    path = str(tmp_path / "t")
    snapshots.write(spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id int, name string, x int"), path)
    source = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", 2)], "id int, name string, x int")
    want = (1, 1, 1)
    dry = write_upsert(path, source, "id", dry_run=True).first()
    assert (dry["inserted"], dry["updated"], dry["unchanged"]) == want and snapshots.read(spark, path).count() == 2
    done = write_upsert(path, source, "id").first()
    assert (done["inserted"], done["updated"], done["unchanged"]) == want
    assert sorted(map(tuple, snapshots.read(spark, path).collect())) == [(1, "a", None), (2, "b", None), (3, "c", 2)]


def test_generated_listings_do_not_depend_on_partitions(spark):
    from bazaarlake.operators.ingest import generate_listings

    items = spark.createDataFrame([(i, 100 + i) for i in range(7)], "place long, id long")
    one = [sorted(map(tuple, df.collect())) for df in generate_listings(spark, 200, items)]
    two = [sorted(map(tuple, df.collect())) for df in generate_listings(spark, 200, items.repartition(5))]
    assert one == two and len(one[0]) == 200


def test_audit(spark):
    from bazaarlake.operators.changes import audit_diff

    schema = "id int, name string, x int, updated_at int"
    before = spark.createDataFrame([(1, "a", 1, 0), (2, "b", None, 0), (3, "c", 3, 0)], schema)
    after = spark.createDataFrame([(1, "a", 1, 9), (2, "b", 5, 9), (4, "d", None, 9)], schema)
    got = {r["id"]: (r["action"], r["before"], r["after"]) for r in audit_diff(before, after).collect()}
    assert got == {2: ("update", {"x": None}, {"x": "5"}), 3: ("delete", {"name": "c", "x": "3"}, None), 4: ("create", None, {"name": "d", "x": None})}


def test_similar_items(spark):
    from bazaarlake.operators.recommend import from_history, similar_topk, tfidf

    items = spark.createDataFrame([(1, "red bow"), (2, "red bow string"), (3, "blue axe"), (4, "the axe")], "id long, name string")
    top = similar_topk(tfidf(items, ["name"]), 2)
    assert {(r["id"], r["other"]) for r in top.collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    users = spark.createDataFrame([(7,), (8,)], "user_id long")
    history = spark.createDataFrame([(7, 1)], "user_id long, item long")
    got = {(r["user_id"], r["item"]) for r in from_history(history, top, items, users, 2).collect()}
    assert got == {(7, 2), (8, 1), (8, 2)}


def test_roll_quality_from_a_low_above_zero(spark):
    from bazaarlake.functions.text import roll_quality

    rows = spark.createDataFrame([(85, 80, 100, False), (86, 80, 100, False), (96, 80, 100, False), (100, 80, 100, True), (99, 80, 100, True), (5, 5, 5, False), (None, 1, 2, False)], "v int, a int, b int, x boolean")
    assert [r[0] for r in rows.select(roll_quality(*map(F.col, "vabx"))).collect()] == ["low", "mid", "high", "max", "other", None, None]


def test_texts(spark):
    from bazaarlake.functions.text import inject_numbers, strip_prefix

    fill = spark.createDataFrame([("dmg N ~ N up", ["5"]), ("dmg N ~ N up", ["5", "7"]), ("N ~ N", []), ("a N b N", ["1"]), ("N~N and N ~ N", ["1", "2", "3"]), ("no", ["1"])], "t string, v array<string>")
    assert [r[0] for r in fill.select(inject_numbers(F.col("t"), F.col("v"))).collect()] == ["dmg 5 up", "dmg 5 ~ 7 up", "", "a 1 b", "1~2 and 3", "no"]
    bullets = spark.createDataFrame([("- a",), (", a",), ("·a",), ("L a",), (" ㄴ a",), (". a",), ("* a",), ("--a",), ("a",), ("",)], "t string")
    assert [r[0] for r in bullets.select(strip_prefix(F.col("t"))).collect()] == ["a", "a", "a", "a", "a", "a", "* a", "-a", "a", ""]
    assert strip_prefix(F.col("t"), ("*",)) is not None and bullets.select(strip_prefix(F.col("t"), ("*",))).collect()[6][0] == "a"


def test_saved_searches_without_filters(spark):
    from bazaarlake.operators.search import run_saved_searches, saved_option_filters

    searches = spark.createDataFrame([(1, '[{"type":"a","id":1,"op":"lte","level":5}]'), (2, "not json"), (3, "[]"), (4, '[{"type":"a"}]'), (5, None), (6, '[{"type":"a","id":1},{"type":"a","id":2,"op":"?","level":9}]')], "search_id int, filters string")
    options = spark.createDataFrame([(10, "a", 1, 4.0), (11, "a", 1, 6.0), (11, "a", 2, 9.0)], "listing_id long, option_type string, option_id long, rolled_value double")
    got = sorted(tuple(r) for r in run_saved_searches(saved_option_filters(searches), options).collect() if not r["unfiltered"])
    assert got == [(1, 10, False), (6, 11, False)]
    assert sorted(r["search_id"] for r in run_saved_searches(saved_option_filters(searches), options).filter("unfiltered").collect()) == [2, 3, 4, 5]


def test_level_and_enchant_lines(spark):
    from bazaarlake.functions.text import enchant_header, name_and_levels

    levels = {"보호(13/20 레벨)": ("보호", 13, 20), "보호(14/20)": ("보호", 14, 20), "보호13/20 레벨)": ("보호", 13, 20), "- 보호 13 20 레벨": ("보호", 13, 20), "보호": (None, None, None), "13/20": (None, None, None), "보호 2 (1/9)": ("보호 2", 1, 9)}
    heads = {"[접두] 충격을 (랭크 F)": ("접두", "충격을", "F"), "접미 관리자 (랭크 6) x": ("접미", "관리자", "6"), "[접두] a": (None, None, None), "[중간] a (랭크 F)": (None, None, None), "[접미] a b(랭크A)": ("접미", "a b", "A"), "[접미] (랭크 A)": (None, None, None)}
    for f, cases in ((name_and_levels, levels), (enchant_header, heads)):
        rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", f(F.col("t")).alias("x")).select("t", "x.*").collect()
        assert {r[0]: tuple(r)[1:] for r in rows} == cases


def test_search_spec_filters(spark):
    from bazaarlake.operators.search import SearchSpec, search_listings

    listings = spark.createDataFrame([(i, 1, f"n{i}", 100 * i, i, 7 if i % 2 else None, None, "S" if i < 3 else "A") for i in range(6)], "id long, status int, name string, price long, game_item_id long, prefix_enchant_id long, suffix_enchant_id long, erg_grade string")
    options = spark.createDataFrame([(i, i, "a", 1, "o", float(i), 9) for i in range(6)], "id long, listing_id long, option_type string, option_id long, option_name string, rolled_value double, max_level int")
    rolls = spark.createDataFrame([(i, 7, 1, float(i)) for i in range(6)], "listing_id long, enchant_id long, effect_order int, rolled_value double")
    items = spark.createDataFrame([(i, f"item{i % 3}") for i in range(6)], "id long, name string")
    tags = spark.createDataFrame([(1, "fire", 5), (2, "ice", 5)], "id int, name string, weight int")
    targets = spark.createDataFrame([(1, "game_items", 3, 1), (1, "a", 1, 2), (2, "listings", 4, 0)], "tag_id int, target_type string, target_id long, weight int")
    find = lambda **spec: [r["id"] for r in search_listings(SearchSpec(**spec), listings, options, items, targets, tags, rolls).collect()]
    assert find() == [5, 4, 3, 2, 1, 0] and find(strings={"erg_grade": "S"}) == [2, 1, 0]
    assert find(enchant=7, effects=[(7, 1, "gte", 3.0)]) == [5, 3] and find(options=[("a", 1, "lte", 1.0)]) == [1, 0]
    assert find(tags=["fire", "ice"]) == [4] and find(text="ice") == [4] and find(text="item1") == [4, 1] and find(text="n5") == [5] and find(text="nothing") == []
    assert find(offset=1, limit=2) == [4, 3]


def test_replaced_codes_do_not_verify(spark, tmp_path):
    import datetime

    from bazaarlake.streaming import jobs as J

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    users = spark.createDataFrame([(1, "s", "a", False), (2, "s", "b", True), (3, None, "c", False), (4, "t", "a", False)], "id long, server string, game_id string, verified boolean")
    requests = spark.createDataFrame([(1, "11", at(0)), (1, "22", at(10)), (2, "33", at(0)), (3, "44", at(0)), (4, "55", at(0))], "user_id long, code string, issued_at timestamp_ntz")
    codes = J.eligible(requests, users)
    assert sorted(r["user_id"] for r in codes.collect()) == [1, 1, 4]
    said = [("s", "a", at(12), "code 11"), ("s", "a", at(15), "code 22"), ("s", "a", at(16), "22"), ("s", "a", at(3), "55"), ("t", "a", at(40), "55")]
    messages = spark.createDataFrame(said, "server string, game_id string, sent_at timestamp_ntz, message string")
    assert [tuple(r) for r in J.verified_users(messages, codes).collect()] == [(1, at(15))]
