"""Mixing sources to target weights by entropy balancing.

Each source has one moment constraint: the words that it contributes. Among all document rates
between 0 and the cap that meet it, those closest to 1 in relative entropy (sum of r log r - r + 1) are
exponentially tilted by size: r = min(cap, exp(tilt * size / mean size)). The tilt solves the convex
dual, whose slope is the words at this tilt less the target; Newton's method finds it, kept inside
the interval that is known to hold the solution. The documents are first reduced to counts by
(source, size), which are sufficient, so an iteration is a small join and aggregation; its state is
one row for each source. The rates are then rounded into whole copies: within strata of a source
(by hash of the id, of bounded size) documents go from the largest to the smallest, and the
words that rounding gives or takes are carried to the next, as far as those left can make up
for them. So the words taken end next to the target, and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import SPACED, cut, slices, small_batches
from bazaarlake.operators.ingest import number_rows

#: Documents of a stratum, about.
STRATUM = 2_000
#: Iterations before the solution is given up as an error (some ten are enough), and the share of a target that may be missed.
NEWTON_STEPS, TOLERANCE = 200, 1e-10


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(x) for part in slices(batch.column(2), SPACED) for x in part.counts()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "source", "size"])


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(key, source_size, n) -> also target: `share` of all sizes by repeating weights in the order of the keys, none above `cap` times its size.

    The excess of capped sources is reshared by weight until none is above its cap: target =
    min(cap, level * weight), with one level for all. Each round is an aggregation to one row.
    """
    rows = number_rows(sources, "key", 0)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    rows = cut(rows.withColumn("weight", F.get(pattern, (F.col("number") % len(weights)).cast("int"))).withColumn("most", cap * F.col("source_size")).drop("number"), "weights")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:
        over = F.col("most") < level * F.col("weight")
        capped, free, n = rows.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == n_capped or not free:
            break
        level, n_capped = (total - capped) / free, n
    target = F.least("most", level * F.col("weight")) if free else F.col("most")
    return rows.withColumn("target", target).drop("most", "weight")


def fit_tilts(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """counts (key, size, n), targets (key, source_size, n, target) -> key, mean, tilt for each source with words.

    A target of all that the cap allows has no finite tilt: there it is null, and all rates are the cap.
    """
    wanted = targets.filter("source_size > 0 and target > 0").select("key", F.col("n").alias("docs"), (F.col("target") / F.col("source_size")).alias("ratio"), (F.col("source_size") / F.col("n")).alias("mean"))
    full = F.col("ratio") >= cap * (1 - 1e-12)
    state = cut(wanted.withColumns({"tilt": F.when(~full, F.lit(0.0)), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "off": F.when(~full, F.lit(1.0))}), "state")
    for _ in range(NEWTON_STEPS):
        if state.filter(F.col("off") > TOLERANCE).isEmpty():
            break
        at = counts.join(state.filter("tilt is not null"), "key").withColumn("x", F.col("size") / F.col("mean"))
        at = at.withColumn("rate", tilted(F.col("tilt") * F.col("x"), cap))
        sums = at.groupBy("key").agg(F.sum(F.expr("n * x * rate")).alias("words"), F.sum(F.when(F.col("rate") < cap, F.expr("n * x * x * rate")).otherwise(0.0)).alias("slope"))
        joined = state.join(sums, "key", "left").withColumn("miss", F.expr("docs * ratio - words"))
        joined = joined.withColumns({"low": F.when(F.col("miss") > 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("miss") <= 0, F.col("tilt")).otherwise(F.col("high")), "off": F.abs("miss") / (F.col("docs") * F.col("ratio"))})
        newton = F.col("tilt") + F.col("miss") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        beyond = F.when(F.col("high") == float("inf"), F.greatest(2 * F.col("tilt"), F.lit(1.0))).when(F.col("low") == float("-inf"), F.least(2 * F.col("tilt"), F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        tilt = F.when(F.col("off") <= TOLERANCE, F.col("tilt")).when(inside, newton).otherwise(beyond)
        state = cut(joined.withColumn("tilt", tilt).select(*state.columns), "state")
    else:
        raise RuntimeError("entropy balancing did not converge")
    return state.select("key", "mean", "tilt")


def tilted(exponent, cap: float):
    return F.when(exponent >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(exponent))


def _round(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["size", "id"], ascending=[False, True], kind="stable")
    carry, copies = 0.0, []
    rows = list(zip(frame["size"].tolist(), frame["rate"].tolist(), frame["most"].tolist(), strict=True))
    wanted_left, room_left = sum(s * r for s, r, _ in rows), sum(s * m for s, _, m in rows)
    for size, rate, most in rows:
        wanted = size * rate + carry
        wanted_left, room_left = wanted_left - size * rate, room_left - size * most

        def off(k: int) -> tuple[float, float]:
            """How far what is carried on is from what the documents left can take or give, and from nothing."""
            on = wanted - k * size
            return max(0.0, on - (room_left - wanted_left), -wanted_left - on), abs(on)

        near = int(wanted // size) if size else 0
        k = min((min(most, max(0, x)) for x in (near, near + 1)), key=off) if size else 0
        carry = wanted - k * size
        copies.append(k)
    return frame.assign(copies=copies)[["id", "key", "size", "rate", "copies"]]


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2
) -> DataFrame:
    """Copies of each document such that every source contributes its target of words.

    Returns one row per row of `docs`: the id, size (words), source_size, target (of its source),
    taken (words the mix takes, repeats counted), copies, rate. Defined cases: null and empty
    texts have size 0 and no copies; a null source is a source of its own, sorted last; sources
    without words have target 0; repeated ids are separate rows; an empty table gives an empty
    result; other columns are ignored. No document is taken more than `cap` (at least 1) times; `rate` is
    what the copies are rounded from.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    # keys sort as the sources do by code point, with null last
    rows = rows.mapInArrow(_sizes, "id long, source string, size long").withColumn("key", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")))
    rows = cut(rows, "sizes")
    counts = cut(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    sources = counts.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n"))
    targets = cut(source_targets(sources, weights, share, cap), "targets")

    tilts = fit_tilts(counts, targets, cap)
    joined = rows.join(targets.select("key", "n", "source_size", "target"), "key").join(tilts, "key", "left")
    rate = F.when(F.col("mean").isNull() | (F.col("size") == 0), F.lit(0.0)).when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(tilted(F.col("tilt") * F.col("size") / F.col("mean"), cap))
    joined = joined.withColumn("rate", F.round(rate, 9))
    stratum = F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("n") / STRATUM))
    dealt = joined.select("id", "key", "size", "rate", stratum.alias("stratum"), F.lit(cap).alias("most"))
    rounded = dealt.groupBy("key", "stratum").applyInPandas(_round, "id long, key string, size long, rate double, copies long")
    return rounded.join(targets.select("key", "source_size", "target"), "key").select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
