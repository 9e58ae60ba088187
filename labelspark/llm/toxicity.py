"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents, labelled or not, are unlabelled text that holds toxic ones
at the rate of the class prior.  With risk R+ of calling positives negative (and R- of calling them positive) the unbiased
risk is prior * R+(P) + R-(U) - prior * R-(P); its last two terms estimate a risk, so they must not fall below zero.  Where
they do, the step goes the other way, which keeps the classifier from learning the sample by heart.

Features are the words of a text and the first four bytes of longer words (present or not); the latter reach inflected forms
of a stem.  Only features that are clearly more frequent in positives than in unlabelled text are kept.  The sample, the
vocabulary and the classifiers have documented bounds; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelspark.llm import wordhash
from labelspark.llm.storage import write_table

POSITIVES, UNLABELLED = 2_000, 8_000  # bounds of the training sample, in documents
VOCABULARY, LEAST_DOCUMENTS = 40_000, 8  # features kept at most, and in how many documents of the sample at least
LEAST_DIFFERENCE = 4.0  # standard errors by which a feature is more frequent in positives than in unlabelled documents
CLASSIFIERS = 4  # each trained on its own part of the unlabelled sample; their scores are averaged
ROUNDS, RATE, SPARSE = 200, 0.05, 3e-4
FOLDS = 5  # rows whose crc32(id) is divisible by this are never learned from

SEPARATORS = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


STEM_BYTES = 4


def _present(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts with the features of their words, and the text that each belongs to (repeats included)."""
    hasher = wordhash.WordHasher(wordhash.word_bytes(SEPARATORS))
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    data, offsets = wordhash.utf8(column)
    for low, high in wordhash.slices(offsets):
        words, bounds, places = hasher(data, offsets[low:high + 1])
        of_text = np.repeat(np.arange(high - low), np.diff(bounds))
        ends = offsets[low + of_text + 1]
        stem, long_enough = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
        for j in range(STEM_BYTES):
            byte = data[np.minimum(places + j, ends - 1)]
            long_enough &= (places + j < ends) & hasher.is_word[byte]
            stem = (stem << np.uint64(8)) | lower[byte]
        stems = wordhash.mix(stem[long_enough] + np.uint64(1 << 40))
        yield low, high, np.concatenate([words, stems]).view(np.int64), np.concatenate([of_text, of_text[long_enough]])


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, features, of_text in _present(batch.column(2)):
            order = np.argsort(of_text, kind="stable")
            bounds = np.searchsorted(of_text[order], np.arange(high - low + 1))
            sets = [np.unique(features[order[s:e]]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "positive", "words"])


def fit(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, width: int, prior: float) -> np.ndarray:
    """Weights (bias last) of a linear classifier under the non-negative risk with the logistic loss.

    ``rows`` and ``columns``: the documents and words that are present.  ``positive``: by document.
    """
    n_p, n_u = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, ROUNDS + 1):
        z = np.bincount(rows, weights=w[columns], minlength=len(positive)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_negative = np.logaddexp(0, z)  # of calling it toxic when it is not
        remainder = loss_negative[~positive].sum() / n_u - prior * loss_negative[positive].sum() / n_p
        slope = np.where(positive, -prior * p / n_p, p / n_u)  # of that remainder
        if remainder >= 0:
            slope = slope + np.where(positive, prior * (p - 1) / n_p, 0.0)
        else:
            slope = -slope
        grad = np.append(np.bincount(columns, weights=slope[rows], minlength=width), slope.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        scale = np.sqrt(second / (1 - 0.999 ** step)) + 1e-8
        w -= RATE * (first / (1 - 0.9 ** step)) / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - RATE * SPARSE / scale[:-1], 0)  # few words carry weight
    return w


def _trainer(vocabulary, prior: float):
    def train(table: pa.Table) -> pa.Table:
        known = vocabulary.value
        lists = table.column("words").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.values.to_numpy()
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        rows = np.repeat(np.arange(len(counts)), counts)[hit]
        positive = table.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        w = fit(rows, at[hit], positive, len(known), prior)
        return pa.table({"weights": pa.array([w.tolist()], pa.list_(pa.float64()))})
    return train


class ToxicityModel:
    """A vocabulary of word hashes and the mean weights of the classifiers."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights

    def score(self, docs: DataFrame, text_column: str = "text", name: str = "toxicity_score") -> DataFrame:
        """``docs`` with a column of scores (0 to 1); a null text counts as empty and gets the score of the bias."""
        model = docs.sparkSession.sparkContext.broadcast((self.vocabulary, self.weights))  # bounded by VOCABULARY
        at = docs.columns.index(text_column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, w = model.value
            for batch in batches:
                scores = [np.zeros(0)]
                for low, high, features, of_text in _present(batch.column(at)):
                    total = np.full(high - low, w[-1])
                    if len(known) and len(features):
                        slot = np.minimum(np.searchsorted(known, features), len(known) - 1)
                        hit = known[slot] == features
                        pairs = np.unique(of_text[hit] * len(known) + slot[hit])
                        total += np.bincount(pairs // len(known), weights=w[pairs % len(known)], minlength=high - low)
                    scores.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))],
                                                 names=[*batch.schema.names, name])

        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, f"{columns}, {name} double")


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> ToxicityModel:
    """Fit the classifiers on ``docs`` and the confirmed rows of ``labels`` (id, toxic), leaving out the held-out fold.

    The prior is the share of toxic rows among the labelled ones outside the held-out fold.  An id that is labelled several
    times counts as toxic if one row says so.  Without positives every score is 0.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_column).isNotNull() & F.col("toxic").isNotNull() & (fold(F.col(id_column)) != 0))
    known = known.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return ToxicityModel(np.zeros(0, np.int64), np.array([-30.0]))
    prior = min(toxic / n, 0.9)
    order = F.xxhash64("doc_id")
    confirmed = known.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")).orderBy(order, "doc_id").limit(POSITIVES)
    others = docs.select(F.col(id_column).cast("long").alias("doc_id")).where("doc_id is not null").where(fold(F.col("doc_id")) != 0)
    others = others.select("doc_id", F.lit(False).alias("positive")).orderBy(order, "doc_id").limit(UNLABELLED)
    chosen = F.broadcast(write_table(confirmed.unionByName(others), "tox_ids"))  # POSITIVES + UNLABELLED ids at most
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).join(chosen, "doc_id")
    sample = write_table(texts.select("doc_id", "positive", "text").mapInArrow(
        _word_lists, "doc_id long, positive boolean, words array<long>"), "tox_sample")

    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    words = sample.select(F.explode("words").alias("word"), F.col("positive").cast("long").alias("p"))
    words = words.groupBy("word").agg(F.sum("p").alias("k_p"), F.sum(1 - F.col("p")).alias("k_u")).where(
        F.col("k_p") + F.col("k_u") >= LEAST_DOCUMENTS)
    rate = (F.col("k_p") + F.col("k_u")) / (n_p + n_u)
    error = F.sqrt(rate * (1 - rate) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    words = words.withColumn("difference", (F.col("k_p") / max(n_p, 1) - F.col("k_u") / max(n_u, 1)) / F.nullif(error, F.lit(0.0)))
    kept = words.where(F.col("difference") >= LEAST_DIFFERENCE).orderBy(F.desc("difference"), "word").limit(VOCABULARY).collect()
    vocabulary = np.sort(np.array([r["word"] for r in kept], dtype=np.int64))
    if not len(vocabulary):
        return ToxicityModel(vocabulary, np.array([np.log(prior / (1 - prior))]))
    shared = spark.sparkContext.broadcast(vocabulary)
    bags = F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(CLASSIFIERS - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CLASSIFIERS)).cast("int")))
    bagged = sample.select(F.explode(bags).alias("bag"), "positive", "words")
    trained = bagged.groupBy("bag").applyInArrow(_trainer(shared, prior), "weights array<double>").collect()
    return ToxicityModel(vocabulary, np.mean([r["weights"] for r in trained], axis=0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5.

    Null and empty texts are scored like any other (by the prior alone), null ids stay, repeated rows get the same score each, long
    texts are read whole.  Columns may have any name; an empty table gives no rows.
    """
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return train(docs, labels).score(docs, name=name).where(F.col(name) < 0.5).drop(name)
