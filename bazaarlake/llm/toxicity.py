"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text, no confirmed clean examples: the risk of a
classifier is estimated as pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with the class prior pi, the
share of toxic rows among the labelled training rows. Features are the words of the whole text and
their beginnings (4 to 8 bytes), each by how often it stands in the text and in what share of the
words. The classifier is linear, trained with numpy on a bounded sample; scoring reads every
text once, in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bazaarlake.llm.common import _BYTE, ALNUM, Slice, _power, cut, fold, mix, slices, small_batches

#: Defaults of the training sample: at most so many toxic rows, so many unlabelled documents (by hash of the id), and so many bytes of text of either kind.
POSITIVES, UNLABELLED, SAMPLE_BYTES = 4_000, 16_000, 64 << 20
#: Terms that the classifier knows, documents of the toxic sample that a term must be in, and how much larger its share there must be than in the unlabelled sample.
TERMS, LEAST, LIFT = 4_096, 5, 3.0
#: Levels of a term: times in a text, and share of its words.
TIMES, SHARES = (1, 2, 3, 5, 8), (0.002, 0.006, 0.02)
LEVELS = len(TIMES) + len(SHARES)
BEGINNINGS = (4, 5, 6, 7, 8)
STEPS, RATE, DECAY = 400, 0.05, 1e-3


def _terms(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and beginning."""
    if not len(part.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _power(len(part.data) + 1)
    total = np.zeros(len(part.data) + 1, np.uint64)
    np.cumsum(_BYTE[part.data] * power[: len(part.data)], out=total[1:])
    docs, hashes = [part.doc], [mix((total[part.end] - total[part.start]) * inverse[part.start])]
    for size in BEGINNINGS:
        long = part.end - part.start >= size
        start = part.start[long]
        docs.append(part.doc[long])
        hashes.append(mix((total[start + size] - total[start]) * inverse[start] + np.uint64(size)))
    return np.concatenate(docs), np.concatenate(hashes)


def _levels(doc: np.ndarray, term: np.ndarray, n_words: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (document, place of the term) -> active features (document, feature)."""
    pair, times = np.unique(doc * n_terms + term, return_counts=True)
    doc, term = pair // n_terms, pair % n_terms
    share = times / n_words[doc]
    on = [times >= x for x in TIMES] + [share >= x for x in SHARES]
    return np.concatenate([doc[x] for x in on]), np.concatenate([term[x] * LEVELS + i for i, x in enumerate(on)])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> documents of both kinds that hold each term."""
    for batch in batches:
        kind = np.asarray(batch.column(1).to_pylist(), np.int64)
        for part in slices(batch.column(0), ALNUM):
            doc, term = _terms(part)
            _, first = np.unique(mix(term + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            doc, term = doc[first], term[first]
            values, back = np.unique(term, return_inverse=True)
            mine = kind[part.lo : part.lo + part.n_docs][doc]
            p = np.bincount(back, mine, len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(p), pa.array(np.bincount(back, minlength=len(values)) - p)], ["h", "p", "u"])


class Model:
    """Known terms (sorted hashes), a weight for each level of each, and a constant."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, constant: float):
        self.terms, self.weights, self.constant = terms, weights, constant

    def features(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        doc, term = _terms(part)
        if not len(self.terms) or not len(term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == term
        return _levels(doc[known], at[known], np.maximum(part.counts(), 1), len(self.terms))

    def score(self, part: Slice) -> np.ndarray:
        doc, feature = self.features(part)
        return 1 / (1 + np.exp(-np.clip(self.constant + np.bincount(doc, self.weights[feature], part.n_docs), -40, 40)))


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for part in slices(batch.column(0), ALNUM):
                doc, feature = model.features(part)
                feature = feature[np.argsort(doc, kind="stable")]
                at = np.searchsorted(np.sort(doc), np.arange(part.n_docs + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(part.lo, part.n_docs), lists], ["toxic", "f"])

    return run


def nnpu_risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative risk of decision values g with logistic loss, and the slope by g that a step of training follows.

    Where the negative part is below 0, a step goes up its slope instead (Kiryo et al. 2017).
    """
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    negative_loss, positive_loss = np.logaddexp(0, g), np.logaddexp(0, -g)
    rest = negative_loss[~positive].sum() / n_u - prior * negative_loss[positive].sum() / n_p
    # d/dg of the negative part: sigmoid(g); of the positive part: sigmoid(g) - 1
    of_rest = np.where(positive, -prior * s / n_p, s / n_u)
    slope = -of_rest if rest < 0 else of_rest + np.where(positive, prior * (s - 1) / n_p, 0)
    return prior * positive_loss[positive].sum() / n_p + max(0.0, rest), slope


def fit_nnpu(features: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Linear classifier by Adam on the non-negative risk with logistic loss; features: the active ones of each row."""
    rows = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
    columns = np.concatenate(features) if len(features) else np.zeros(0, np.int64)
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        g = w[-1] + np.bincount(rows, w[columns], len(features))
        _, slope = nnpu_risk(g, positive, prior)
        grad = np.append(np.bincount(columns, slope[rows], n_features), slope.sum())
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (1 - 0.9 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, toxic: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """docs: unlabelled text; toxic: ids of confirmed toxic examples among them.

    The sample is the first rows by hash of the id, as far as its bounds of rows and bytes go, so what
    reaches the driver (the active features of the sample) is bounded.
    """

    def first(rows: DataFrame, most: int) -> DataFrame:
        """The first ids by hash; those that can't be among them go before any are gathered."""
        share = min(1.0, 4 * (most + 100) / max(rows.count(), 1))
        return rows.filter(F.xxhash64("id") <= int(share * 2**64) - 2**63 - 1).orderBy(F.xxhash64("id"), "id").limit(most)

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    toxic = toxic.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    toxic, plain = first(toxic, positives), first(ids.select("id"), unlabelled)
    sample = toxic.withColumn("toxic", F.lit(1)).unionByName(plain.withColumn("toxic", F.lit(0)))
    found = cut(ids.join(F.broadcast(sample), "id").select("id", "text", "toxic"), "sample")  # positives + unlabelled ids at most
    upto = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id"))  # over a row for each id of the sample, without its text
    within = F.broadcast(found.select("id", "toxic", upto.alias("upto")).filter(F.col("upto") <= sample_bytes).select("id", "toxic").distinct())
    rows = found.join(within, ["id", "toxic"], "left_semi")
    n_p, n_u = rows.filter("toxic = 1").count(), rows.filter("toxic = 0").count()
    terms = rows.select("text", "toxic").mapInArrow(_document_counts, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= LEAST)
    # terms of which far more toxic than unlabelled documents have one, by the log-likelihood of their toxic documents
    gain = F.col("p") * F.log((F.col("p") + 0.5) * (n_u + 1.0) / ((F.col("u") + 0.5) * (n_p + 1.0)))
    best = terms.withColumn("gain", gain).filter(F.col("p") * n_u >= LIFT * F.col("u") * n_p).orderBy(F.desc("gain"), "h").limit(TERMS).select("h").toArrow()
    model = Model(np.sort(best.column("h").to_numpy().view(np.uint64)), np.zeros(0), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, 0.0))
    found = rows.orderBy("id", "toxic", F.xxhash64("text")).select("text", "toxic").mapInArrow(_features(shared), "toxic int, f array<int>").toArrow()
    lists = found.column("f").combine_chunks()
    features = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()) if len(lists) else []
    model.weights, model.constant = fit_nnpu(features, found.column("toxic").to_numpy() == 1, len(model.terms) * LEVELS, min(max(prior, 1e-4), 0.9999))
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            scores = [model.score(part) for part in slices(batch.column(1), ALNUM)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["id", "score"])

    return run


def _fitted(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, id_col: str, text_col: str):
    """The broadcast parts of a model learnt from the labels outside of the held-out fold."""
    kept = fold(F.col(id_col), folds) != held_out
    mine = labels.filter(kept & F.col("toxic").isNotNull())
    counts = mine.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    prior = (counts[1] or 0) / counts[0] if counts[0] else 0.0
    model = train(docs.filter(kept), mine.filter("toxic = 1"), prior, id_col, text_col)
    return docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.constant))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", score: DataFrame | None = None
) -> DataFrame:
    """Scores of the whole texts of `score` (or of `docs`), learnt from labels outside of the held-out fold (crc32 of the id as text, modulo).

    Returns one row per row scored: the id, held_out, score (0 to 1), predicted (score >=
    threshold). Defined cases: null and empty texts get the score of a text without known terms;
    texts of any length are read whole; labels that are null are no examples; repeated rows are scored
    each; a null id isn't held out; a term must be in LEAST toxic examples, so with fewer of them (or none)
    every text gets one score, the prior; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = _fitted(docs, labels, folds, held_out, id_col, text_col)
    rows = (docs if score is None else score).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), "id long, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of `docs` that aren't predicted to be toxic, all columns as they are; scored and filtered in one pass, without a shuffle of texts. Rows with a null id are judged by their texts, too."""
    small_batches(docs.sparkSession)
    model = _fitted(docs, labels, folds, held_out, "doc_id", "text")
    names = docs.columns
    scored = next(x for x in (f"_score{i}" for i in range(len(names) + 1)) if x not in names)
    schema = StructType([*docs.schema.fields, StructField(scored, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model.value)
        for batch in batches:
            scores = [own.score(part) for part in slices(batch.column(names.index("text")), ALNUM)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*names, scored])

    return docs.mapInArrow(run, schema).filter(F.col(scored) < threshold).drop(scored)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
