"""Content recommendations: TF-IDF and cosine similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.sources.scratch import stored

#: Postings of a token that are joined in one piece, and what rounding to nine places may take off a score.
_SLICE, _MARGIN = 200_000, 1e-8
#: English words without content; fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "were", "will", "with", "you")


def tfidf(items: DataFrame, columns: Sequence[str], key: str = "id", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(key, token, weight): lower-case tokens of two or more word characters, tf (ln((1 + n) / (1 + df)) + 1), of unit length per item."""
    text = F.concat_ws(" ", *columns)
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), 1), lambda w: ~w.isin(*stop_words))
    tf = items.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = items.agg(F.count("*").alias("n"))
    weighed = tf.join(df, "token").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # over one item's tokens
    return weighed.select(key, "token", (F.col("w") / norm).alias("weight"))


def _lookup(tokens: DataFrame, vectors: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Queries' tokens (key, token, wa, slices) -> (key, other, partial): the sums over these tokens. Postings of a frequent token are dealt out in slices."""
    a = tokens.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(key, "token", "wa", "slice")
    b = vectors.join(hot, "token", "left").withColumn("slice", F.pmod(F.hash(key), F.coalesce("slices", F.lit(1)))).select(F.col(key).alias("other"), "token", F.col("weight").alias("wb"), "slice")
    return a.join(b, ["token", "slice"]).filter(F.col(key) != F.col("other")).groupBy(key, "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("partial"))


def _complete(pairs: DataFrame, tokens: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Pairs (key, other, partial) -> (key, other, score): the sums over the remaining tokens are added. The join is by (other, token), so no frequent token is a hot key."""
    b = vectors.select(F.col(key).alias("other"), "token", F.col("weight").alias("wb"))
    rows = pairs.join(tokens.select(key, "token", "wa"), key, "left").join(b, ["other", "token"], "left")
    return rows.groupBy(key, "other").agg(F.round(F.first("partial") + F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0.0)), 9).alias("score"))


def similar_candidates(vectors: DataFrame, k: int, queries: DataFrame | None, key: str, unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pairs (key, other, partial) that can be among the k best of a query, and the queries' tokens (key, token, wa) that are not in partial yet. vectors is read several times; with `unit` none is longer than 1.

    A query's tokens are ordered from the rarest to the most frequent. What the tokens from one on can add is bounded by their weights' norm times the
    longest vector, and by their weights times the highest weight of each token. The pairs of the first tokens (until these have four times k postings) give k
    scores, and the lowest of them is the query's threshold: tokens from the first one on whose bound is below it are not looked up, and a pair whose
    partial sum and bound are below it goes. A query that has fewer than k such scores looks up all tokens.
    """
    terms = vectors.groupBy("token").agg(F.count("*").alias("df"), F.max("weight").alias("most")).withColumn("slices", F.ceil(F.col("df") / _SLICE).cast("int"))
    terms = stored(terms, "terms")
    hot = terms.filter("slices > 1").select("token", "slices")  # at most the number of postings / _SLICE
    left = vectors if queries is None else vectors.join(queries.select(key), key, "left_semi")
    rare, frequent = Window.partitionBy(key).orderBy("df", "token"), Window.partitionBy(key).orderBy(F.desc("df"), F.desc("token"))
    back = frequent.rowsBetween(Window.unboundedPreceding, 0)  # from the most frequent token to this one
    asked = left.withColumnRenamed("weight", "wa").join(terms, "token")
    if unit:
        asked = asked.withColumn("longest", F.lit(1.0))
    else:
        lengths = vectors.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
        asked = asked.join(F.broadcast(lengths.agg(F.sqrt(F.max("s")).alias("longest"))))  # one row
    bound = F.least(F.sqrt(F.sum(F.col("wa") * F.col("wa")).over(back)) * F.col("longest"), F.sum(F.col("wa") * F.col("most")).over(back))
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = stored(asked.select(key, "token", "wa", "slices", bound.alias("bound"), (before < 4 * k).alias("first")), "asked")
    seeds = _lookup(asked.filter("first"), vectors, hot, key).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("partial"), "other"))).filter(F.col("n") <= k)
    scores = _complete(seeds.drop("n"), asked.filter("not first"), vectors, key)
    least = scores.groupBy(key).agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select(key, (F.col("least") - _MARGIN).alias("least"))
    judged = asked.join(least, key, "left").withColumn("looked", F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)))
    judged = stored(judged.withColumn("rest", F.max(F.when(~F.col("looked"), F.col("bound"))).over(Window.partitionBy(key))), "judged")
    limits = judged.filter("rest is not null").select(key, "least", "rest").distinct()
    pairs = _lookup(judged.filter("looked"), vectors, hot, key).join(limits, key, "left").filter("least is null or partial + rest >= least").select(key, "other", "partial")
    return pairs, judged.filter("not looked").select(key, "token", "wa")


def similar_topk(vectors: DataFrame, k: int, queries: DataFrame | None = None, key: str = "id", items: DataFrame | None = None, unit: bool = False) -> DataFrame:
    """(key, other, score, place): the k most similar other items of each query (all items by default), ties to the lower id. With items (key), queries that share tokens with fewer than k of them get the lowest other ids, at score 0, up to k.

    vectors (key, token, weight) hold each token of an item once, with a weight above 0; `unit` says that none is longer than 1 (as those of tfidf). Pairs that can't be among the k best are left out before they are
    scored (similar_candidates), no others. Scores are rounded to nine places before they are ranked, so that ties don't depend on the order of a sum.
    """
    kept = stored(vectors.select(key, "token", "weight"), "vectors")
    scores = _complete(*similar_candidates(kept, k, queries, key, unit), kept, key)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "other")
    top = stored(scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k), "top")
    if items is None:
        return top
    # the k + 1 lowest ids are enough: at most k - 1 of them are found already, and one is the query itself
    every = items.select(key).distinct()
    lowest = every.orderBy(key).limit(k + 1).agg(F.array_sort(F.collect_list(key)).alias("lowest"))  # one row
    have = top.groupBy(key).agg(F.collect_list("other").alias("have"), F.max("place").alias("n"))  # k at most
    short = (every if queries is None else queries.select(key).distinct()).join(have, key, "left").filter(F.coalesce("n", F.lit(0)) < k).join(F.broadcast(lowest))
    free = F.filter("lowest", lambda x: (x != F.col(key)) & ~F.coalesce(F.array_contains("have", x), F.lit(False)))
    fill = short.withColumn("n", F.coalesce("n", F.lit(0))).select(key, "n", F.posexplode(F.slice(free, F.lit(1), k - F.col("n"))).alias("at", "other"))
    return top.unionByName(fill.select(key, "other", F.lit(0.0).alias("score"), (F.col("n") + F.col("at") + 1).alias("place")))


def from_history(history: DataFrame, similar: DataFrame, items: DataFrame, users: DataFrame, k: int, key: str = "id") -> DataFrame:
    """(user_id, item, score, place): scores of the similar items of a user's history (user_id, item) summed (nine places), without what was seen; users without history get the first k items."""
    found = history.distinct().join(similar.select(F.col(key).alias("item"), "other", "score"), "item").groupBy("user_id", F.col("other").alias("item")).agg(F.round(F.sum("score"), 9).alias("score"))
    fresh = found.join(history, ["user_id", "item"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "item")
    ranked = fresh.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    first = items.select(F.col(key).alias("item")).orderBy("item").limit(k).withColumn("place", F.row_number().over(Window.orderBy("item")))  # k rows
    empty = users.select("user_id").join(history, "user_id", "left_anti").join(F.broadcast(first)).select("user_id", "item", F.lit(0.0).alias("score"), "place")
    return ranked.select("user_id", "item", "score", "place").unionByName(empty)
