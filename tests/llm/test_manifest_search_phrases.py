"""Manifest, top-k search and collocations against plain loops on small fixtures, with odd rows in each."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, path string, n int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest -------------------------------------------------------------------------------


def leaf(row, text):
    put = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return sha(*(put(x) for x in (*row[:4], text)))


def climb(nodes, fanout):
    """The root, and for each node its path as (before, after) pairs."""
    place, paths, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for i, at in enumerate(place):
            run = at // fanout * fanout
            paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        place = [at // fanout for at in place]
    return level[0], paths


def manifest(rows, fanout):
    trees = collections.defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {}
    for tree in order:
        own = sorted(trees[tree], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        made[tree] = (own, *climb([leaf(r, r[4]) for r in own], fanout))
    root, above = climb([made[t][1] for t in order], fanout)
    out = []
    for tree, top in zip(order, above, strict=True):
        own, subroot, paths = made[tree]
        out += [(r, subroot, root, path + top) for r, path in zip(own, paths, strict=True)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, rng.choice(["a", "a", "a", "b", None, "é", "", "Z"]), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([f"Text {i} É", "", None, "same", f"lower {i}"])) for i in range(900)]
    out += [(None, "a", None, None, None), (5, "a", "x", 1, "twice"), (5, "a", "x", 1, "twice"), (5, "a", "x", 1, "again"), (-7, "alone", "en", 3, "ABC")]
    return [(*r, "clash", "n", "p", 1) for r in out]


@pytest.mark.parametrize(("fanout", "stride"), [(16, 2), (2, 3), (3, 1)])
def test_manifest(spark, rows, fanout, stride):
    from bazaarlake.llm.merkle import fold, merkle_manifest

    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = merkle_manifest(docs, fanout=fanout, stride=stride)
    found = found.withColumn("again", fold(found["leaf"], found["path"])).collect()
    want = [(r[0], leaf(r, r[4]), subroot, root, [tuple(x) for x in path]) for r, subroot, root, path in manifest([r[:5] for r in rows], fanout)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], repr(x[4]))
    assert sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in found], key=key) == sorted(want, key=key)
    assert all(r["again"] == r["root"] for r in found)


def test_manifest_query(spark, rows, tmp_path):
    from bazaarlake.llm.merkle import op11_merkle_manifest

    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = []
    for r, subroot, root, path in manifest([r[:5] for r in rows], 16):
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        text = r[4].encode().translate(LOWER).decode() if tampered and r[4] is not None else r[4]
        node = leaf(r, text)
        for before, after in path:
            node = sha(before, node, after)
        want.append((r[0], leaf(r, r[4]), subroot, root, sha(*(x for step in path for x in step)), node, node == root))
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert 0 < sum(not r["verified"] for r in found) < len(found)


@pytest.mark.parametrize("kept", [0, 1, 2])
def test_small_manifests(spark, kept):
    from bazaarlake.llm.merkle import merkle_manifest

    rows = [(1, "a", "en", 2, "x" * 300_000, "t", "n", "p", 1), (2, "b", "en", 2, "", "t", "n", "p", 1)][:kept]
    found = {r["doc_id"]: r for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(found) == [1, 2][:kept]
    for r in rows:
        own = leaf(r, r[4])
        assert found[r[0]]["leaf"] == found[r[0]]["subroot"] == own
        assert found[r[0]]["root"] == (own if kept == 1 else sha(leaf(rows[0], rows[0][4]), leaf(rows[1], "")))
        assert len(found[r[0]]["path"]) == kept - 1


# --- top-k search ---------------------------------------------------------------------------


def best(rows, queries, k, scale=1024):
    """The best score of each id, by plain loops with Python's integers."""
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]
    took = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for q in sorted({i for i, _ in took if i in queries}):
        score = {}
        for i, v in took:
            if i != q:
                for j, u in took:
                    if j == q:
                        s = sum(a * b for a, b in zip(u, v, strict=False))
                        score[i] = max(score.get(i, s), s)
        ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(ranked)]
    return out


def vectors(rng, n, d, kind):
    if kind == "clusters":
        centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
        return [[x + rng.gauss(0, 0.05) for x in rng.choice(centres)] for _ in range(n)]
    if kind == "ties":
        return [[float(rng.randrange(-1, 2)) for _ in range(d)] for _ in range(n)]
    return [[rng.gauss(0, 10 ** rng.uniform(-3, 2)) for _ in range(d)] for _ in range(n)]


@pytest.mark.parametrize(("kind", "d"), [("clusters", 4), ("ties", 3), ("scales", 6)])
def test_top_k(spark, monkeypatch, kind, d):
    from bazaarlake.llm import cover_tree

    for name, value in {"PIVOTS": 8, "CHUNK": 40, "GROUP": 7, "AROUND": 2, "ROUNDS": (0, 1, 3, 8)}.items():
        monkeypatch.setattr(cover_tree, name, value)
    rng = random.Random(d)
    rows = list(enumerate(vectors(rng, 400, d, kind)))
    rows += [(i, rows[0][1]) for i in range(400, 600)]  # a third of the rows
    rows += [(1000, None), (1005, [None] * d), (1010, [math.nan] * d), (1015, [math.inf] * d), (None, [1.0] * d), (1020, [0.5]), (1025, []), (15, rows[15][1]), (30, [2.0] * d)]
    df = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<double>, id string, score double").repartition(6)
    found = cover_tree.top_k_search(df, df.filter("vec_id % 5 = 0"), k=4)
    assert sorted(tuple(r) for r in found.collect()) == best(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, 4)


def test_top_k_edges(spark):
    from bazaarlake.llm.cover_tree import top_k_search

    schema = "vec_id long, embedding array<float>"
    assert top_k_search(*[spark.createDataFrame([], schema)] * 2).collect() == []
    alone = spark.createDataFrame([(1, [1.0])], schema)
    assert top_k_search(alone, alone).collect() == []
    few = spark.createDataFrame([(3, [1.0, 0.0]), (1, [-0.0001, 1.0]), (2, [1.0, 1.0])], schema)
    assert sorted(map(tuple, top_k_search(few, few.filter("vec_id = 1")).collect())) == [(1, 1, 2, 1024 * 1023), (1, 2, 3, -1024)]
    large = spark.createDataFrame([(1, [2.0**20, 3.0]), (2, [2.0**20, 1.0]), (3, [2.0**20, 5.0])], schema)
    assert [r["score"] for r in top_k_search(large, large.filter("vec_id = 1")).orderBy("rank").collect()] == [2**60 + 15 * 2**20, 2**60 + 3 * 2**20]


def test_cover_tree_is_one():
    """Nets cover and separate; a dual search leaves all that reach the needed scores, and prunes where it can."""
    from bazaarlake.llm.cover_tree import Tree, dual

    rng = np.random.default_rng(1)
    x = np.unique(np.floor(1024 * np.concatenate([rng.normal(c, 0.02, (60, 3)) for c in rng.normal(0, 1, (8, 3))])), axis=0)
    tree = Tree(x)
    assert sorted(map(tuple, tree.x)) == sorted(map(tuple, x))
    for at, start in enumerate(tree.starts[:-1]):
        apart = np.sqrt(((tree.x[:start, None] - tree.x[None, :start]) ** 2).sum(2)) + 1e18 * np.eye(start)
        level = 2.0 ** np.ceil(np.log2(max(np.sqrt(((tree.x[start] - tree.x[:start]) ** 2).sum(1)).min(), 1e-9)))
        assert start == 1 or apart.min() > level / 1.000001
        far = np.sqrt(((tree.x - tree.x[tree.above(start)]) ** 2).sum(1))
        assert (far <= tree.radius[at][tree.above(start)] + 1e-9).all()
    scores = tree.x @ tree.x.T
    needed = np.sort(scores, axis=1)[:, -5]
    few = Tree(x[:20])
    rows, cols = dual(few, tree, np.sort(few.x @ tree.x.T, axis=1)[:, -5])
    assert set(np.flatnonzero((few.x @ tree.x.T >= np.sort(few.x @ tree.x.T, axis=1)[:, -5][:, None]).any(0))) <= set(cols.tolist())
    assert len(rows) == 20 and len(cols) < len(x) / 2 and len(needed) == len(x)


# --- collocations ---------------------------------------------------------------------------


def collocations(rows, threshold, longest, first, cover):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        inside = lambda p: any(100 * a >= cover * found[p] and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, a in found.items())  # noqa: B023, E731
        scored = []
        for p, a in found.items():
            if not inside(p):
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, b" ".join(p), c[p[:k]], c[p[k:]]))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(scored[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["É", "Über", "x.y", "#tag", "\x1cq"]
    weights = [1 / (i + 1) for i in range(len(words))]
    idioms = ["as it were so to", "New York city", "w1 w1 w1 w1", "kick the bucket now", "once upon a time there was"]
    out = []
    for i in range(160):
        w = rng.choices(words, weights, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(idioms))
        out.append((rng.choice([" ", "  ", "\t"]).join(w + rng.choices([",", ". ", "\n", "?!"], k=2)), rng.choice(["en", "en", "de", None])))
    return out + [(None, "en"), ("", None), (" .,; ", "fr"), ("only words here", "fr"), (out[0][0], out[0][1]), (" ".join(rng.choices(words, weights, k=20000)), "en"), ("\r\n" * 50 + "new YORK\x0bCity", "en")]


@pytest.mark.parametrize(("threshold", "longest", "first", "cover", "shards", "slots"), [(5, 5, 2000, 100, 4, 1 << 16), (3, 4, 12, 70, 3, 64), (8, 2, None, 100, 1, 1 << 12), (2, 6, 40, 100, 7, 1 << 10)])
def test_collocations(spark, monkeypatch, prose, threshold, longest, first, cover, shards, slots):
    """Also with so few slots that most phrases share them: counts stay exact."""
    from bazaarlake.llm import collocations as c

    monkeypatch.setattr(c, "CHUNK", 1500)
    monkeypatch.setattr(c, "FLUSH", 700)
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in prose], "text string, lang string, h string, f int, words int").repartition(5)
    found = c.mine_collocations(docs, threshold=threshold, longest=longest, first=first, cover=cover, shards=shards, slots=slots)
    assert sorted(tuple(r) for r in found.collect()) == collocations(prose, threshold, longest, first, cover)


def test_collocations_of_nothing(spark):
    from bazaarlake.llm.collocations import mine_collocations

    empty = spark.createDataFrame([], "text string, lang string")
    assert mine_collocations(empty, slots=64).collect() == []
    assert mine_collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string"), slots=64).collect() == []


def test_scores_beyond_64_bits(spark):
    """The score's arithmetic, as the operator writes it, at sizes whose products pass 64 bits."""
    a, n, left, right = 3_000_000_007, 9_000_000_000_013, 3_000_000_019, 7_000_000_001
    row = spark.sql(f"SELECT (cast(1000 * cast({a} as decimal(19, 0)) as decimal(19, 0)) * cast({n} as decimal(19, 0))) div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0))) AS score").first()
    assert row["score"] == 1000 * a * n // (left * right) and 1000 * a * n > 1 << 64


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_top_k", "op13_collocations"])
def test_query_and_sql(spark, name):
    import duckdb

    from bazaarlake.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = QUERIES[name](spark, sf)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(repr, result.fetchall()))
