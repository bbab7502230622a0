"""The pruned cosine join against all pairs."""

import random
from collections import Counter, defaultdict
from math import log, sqrt

import pytest

from bazaarlake.operators import recommend as N
from bazaarlake.sources.scratch import stored


def vectors_of(items):
    tokens = {i: Counter(w for w in text.lower().split() if len(w) > 1 and w not in N.STOP_WORDS) for i, text in items.items()}
    df = Counter(w for c in tokens.values() for w in c)
    out = {}
    for i, c in tokens.items():
        v = {w: n * (log((1 + len(items)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        out[i] = {w: x / norm for w, x in v.items()}
    return out


def all_pairs(vectors, k, asked):
    for q in asked:
        scores = [(-round(sum(x * vectors[o].get(w, 0) for w, x in vectors[q].items()), 9), o) for o in vectors if o != q and vectors[q].keys() & vectors[o].keys()]
        for place, (score, other) in enumerate(sorted(scores)[:k], 1):
            yield q, other, round(-score, 6), place


@pytest.fixture(scope="module")
def items():
    """400 titles: a word that all have, some that many have, many that few have; repeated titles, an empty one and one of stop words."""
    draw = random.Random(5)
    texts = {i: " ".join(["ware", *draw.choices([f"often{n}" for n in range(6)], k=2), *draw.choices([f"rare{n}" for n in range(90)], k=3)]) for i in range(397)}
    texts |= {397: "", 398: "the of", 399: texts[3]}
    for i in range(20, 40):
        texts[i] = texts[20]
    return texts


@pytest.mark.parametrize("pieces", [200_000, 7])
def test_pruned_join_is_whole(spark, items, monkeypatch, pieces):
    monkeypatch.setattr(N, "_SLICE", pieces)  # with 7, frequent tokens are dealt out in up to 57 slices
    df = spark.createDataFrame(list(items.items()), "id long, name string")
    asked = sorted(items)[::7]
    queries = spark.createDataFrame([(i,) for i in asked], "id long")
    vectors = stored(N.tfidf(df, ["name"]), "vectors")
    plain = vectors_of(items)
    for k in (1, 5):
        want = sorted(all_pairs(plain, k, asked))
        got = sorted((r["id"], r["other"], round(r["score"], 6), r["place"]) for r in N.similar_topk(vectors, k, queries, unit=True).collect())
        assert got == want
    pairs = N.similar_candidates(vectors, 5, queries, "id", unit=True)[0].count()
    everything = len(list(all_pairs(plain, len(items), asked)))
    assert pairs < everything / 5


def test_vectors_of_any_length(spark):
    """A long vector beats nearer ones; a query with fewer partners than k has them all; two tables without rows."""
    rows = [(1, "x", 1.0), (1, "y", 1.0), (2, "y", 50.0), (3, "x", 1.0), (3, "y", 1.0), (4, "x", 0.1), (5, "z", 1.0)]
    vectors = spark.createDataFrame(rows, "id long, token string, weight double")
    by = defaultdict(dict)
    for i, w, x in rows:
        by[i][w] = x
    for k in (1, 2, 9):
        got = sorted((r["id"], r["other"], round(r["score"], 6), r["place"]) for r in N.similar_topk(vectors, k).collect())
        assert got == sorted(all_pairs(by, k, list(by)))
    assert N.similar_topk(vectors.limit(0), 3).count() == 0 and N.similar_topk(vectors, 3, vectors.select("id").limit(0)).count() == 0
