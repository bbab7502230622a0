"""Cases of the review: queries over small hand-made tables."""

import pytest

from bazaarlake.plans import QUERIES
from bazaarlake.sources.tables import SCHEMAS

NAMES = ("amber axe", "blue bow", "cold club", "dark dart", "elder epee", "fine flail", "grim gauntlet", "holy halberd", "iron idol")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Folder with a table part of two brands: nine names each, those of brand 1 backwards."""
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(4 * i + 4, name[:: 1 if brand == 2 else -1], f"Brand#{brand}", "SMALL", i + 1, 1.0) for brand in (1, 2) for i, name in enumerate(NAMES, 9 * brand - 9)]
    spark.createDataFrame(rows, SCHEMAS["part"]).write.parquet(f"{folder}/part.parquet")
    return folder


def test_all_effects_of_an_entry(spark, parts):
    """Brand 2 has nine effects, and every line is one of its names: none is left out."""
    got = QUERIES["fz_assign_greedy"](spark, parts).collect()
    assert {r["effect_no"] for r in got if r["entry"] == 20775} >= set(range(1, 10))
    names = {r["corrected"] for r in QUERIES["fz_effect_correct"](spark, parts).collect()}
    assert {"blue bow", "grim gauntlet", "holy halberd"} <= names
    assert {r["effect_no"] for r in QUERIES["er_template_effects"](spark, parts).collect()} == set(range(1, 10))


def test_greedy_is_whole(spark, parts):
    """Every line has one row for its slot's entry: pairs of any score above 0 from the best down, and (-1, 0) without one."""
    from bazaarlake.functions.similarity import ratio
    from bazaarlake.plans.fuzzy import _EFFECTS, _ENTRIES, _lines
    from bazaarlake.sources.tables import Tables

    t = Tables(spark, parts)
    want = []
    lines = _lines(t).collect()
    own = lambda session, slot: (session % 25 + 1) * 10000 + (775, 655)[slot]
    for entry in t.sql(_ENTRIES).collect():
        effects = [e for e in t.sql(_EFFECTS).collect() if e["entry"] == entry["entry"]]
        for session, slot in {(x["session"], x["slot"]) for x in lines if own(x["session"], x["slot"]) == entry["entry"]}:
            mine = [x for x in lines if (x["session"], x["slot"]) == (session, slot)]
            pairs = [(max(ratio(x["text"], e["effect"]), ratio(x["text"], f"{e['condition'] or ''} {e['effect']}".strip())), x["line_no"], e["effect_no"]) for x in mine for e in effects]
            found = {}
            for score, line, effect in sorted(pairs, reverse=True):
                if score > 0 and line not in found and effect not in {f for f, _ in found.values()}:
                    found[line] = (effect, score)
            want += [(session, slot, entry["entry"], x["line_no"], *found.get(x["line_no"], (-1, 0.0))) for x in mine]
    got = [tuple(r) for r in QUERIES["fz_assign_greedy"](spark, parts).select("session", "slot", "entry", "line_no", "effect_no", "score").collect()]
    assert sorted(got) == sorted(want)
    every = []
    effects = t.sql(_EFFECTS).collect()
    for e in t.sql(_ENTRIES).collect():
        for x in lines:
            for f in effects:
                if f["entry"] == e["entry"] == own(x["session"], x["slot"]):
                    score = max(ratio(x["text"], f["effect"]), ratio(x["text"], f"{f['condition'] or ''} {f['effect']}".strip()))
                    every.append((x["session"], x["slot"], x["line_no"], e["entry"], f["effect_no"], round(score, 6)))
    assert sorted((*r[:5], round(r[5], 6)) for r in QUERIES["fz_effect_scores"](spark, parts).collect()) == sorted(every)


def test_unmatched_lines(spark):
    from bazaarlake.operators.fuzzy import assign_greedy, with_unmatched

    rows = [(1, 1, 1, 30.0), (1, 2, 1, 20.0), (1, 3, 1, 0.0)]
    scores = spark.createDataFrame(rows, "session int, line_no int, effect_no int, score double")
    lines = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "session int, line_no int")
    assert sorted(map(tuple, with_unmatched(assign_greedy(scores, ["session"]), lines, ["session"]).collect())) == [(1, 1, 1, 30.0), (1, 2, -1, 0.0), (1, 3, -1, 0.0), (2, 1, -1, 0.0)]


def test_sessions_are_bounded(spark, tmp_path):
    """However large part gets, a session has 40 lines at most."""
    rows = [(i, NAMES[i % 3], "Brand#2", "SMALL", 1, 1.0) for i in range(1, 2501)]
    spark.createDataFrame(rows, SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["fz_assign_greedy"](spark, str(tmp_path)).groupBy("session").count().collect()
    assert max(r["count"] for r in got) <= 40 and sum(r["count"] for r in got) == 2500
    assert QUERIES["er_evidence"](spark, str(tmp_path)).count() == 2 * 63


def test_gap_clusters(spark):
    """Clusters are counted over the partitions' edges; nulls are values of cluster 0, and a null group is a group."""
    import random

    from bazaarlake.operators.lines import gap_clusters

    draw = random.Random(7)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *(draw.randrange(3000) for _ in range(9))])) for _ in range(600)]
    want = []
    for group in {g for g, _ in rows}:
        last, cluster = None, 0
        for v in sorted((v for g, v in rows if g == group), key=lambda v: -1 if v is None else v):
            cluster += v is not None and last is not None and v - last > 12
            last = v
            want.append((str(group), str(v), cluster))
    for n in ("1", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = gap_clusters(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", 12).collect()
        spark.conf.set("spark.sql.shuffle.partitions", old)
        assert sorted((str(r["g"]), str(r["v"]), r["cluster"]) for r in got) == sorted(want)


def test_deep_tree(spark):
    """No limit of levels, and a cycle ends."""
    from bazaarlake.operators.hierarchy import ancestors

    edges = spark.createDataFrame([("root", "a"), ("a", "b"), ("b", "c"), ("other", "b"), ("y", "x"), ("x", "y")], "parent string, child string")
    got = {(r["item"], r["ancestor"]) for r in ancestors(edges).collect()}
    up = {"a": "a root", "b": "b a root other", "c": "c b a root other", "x": "x y", "y": "x y"}
    assert got == {(k, v) for k, names in up.items() for v in names.split()}
    assert ancestors(edges.limit(0)).count() == 0


def test_similar_items_are_filled_up(spark):
    from bazaarlake.operators.recommend import similar_topk, tfidf

    items = spark.createDataFrame([(1, "red bow"), (2, "red bow"), (3, "blue axe"), (4, "the")], "id long, name string")
    got = [tuple(r) for r in similar_topk(tfidf(items, ["name"]), 3, items.filter("id in (1, 4)"), items=items).select("id", "place", "other").collect()]
    assert sorted(got) == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (4, 1, 1), (4, 2, 2), (4, 3, 3)]


def test_saved_enchant_filters(spark):
    from bazaarlake.operators.search import run_saved_enchants, saved_enchant_filters

    effect = '{"enchant_id":7,"effect_order":1,"op":"lte","value":5}'
    texts = [f'[{{"id":7,"effects":[{effect}]}}]', '[{"id":7},{"id":8}]', "[]", "{", None, '[{"id":9,"effects":[{"enchant_id":7,"effect_order":1,"value":1}]}]']
    searches = spark.createDataFrame(list(enumerate(texts)), "search_id int, filters string")
    listings = spark.createDataFrame([(1, 7, 8), (2, None, 7), (3, 9, 9)], "id long, prefix_enchant_id long, suffix_enchant_id long")
    rolls = spark.createDataFrame([(1, 7, 1, 9.0), (1, 7, 1, 6.0), (2, 7, 1, 5.0), (3, 8, 1, 2.0)], "listing_id long, enchant_id long, effect_order int, rolled_value double")
    got = {tuple(r) for r in run_saved_enchants(saved_enchant_filters(searches), listings, rolls).collect()}
    assert got == {(0, 2, False), (1, 1, False), (2, None, True), (3, None, True), (4, None, True)}
