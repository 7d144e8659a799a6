"""Toxicity by multiple-instance learning.

Only documents are labelled; what offends are sentences. A sentence's score is logistic in the marked
features it holds, a document's is the noisy-or of its sentences: one minus the product of their
complements. Features are words and word beginnings. Those are marked that distinct sentences of toxic
documents hold more often than others do, by a lower confidence bound: copies of a document add no
sentence. Their weights are fitted together by gradient ascent on the noisy-or likelihood of the document
labels, under a ridge penalty, and then locate the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, annotate, class_sample, discard, written

#: A sentence ends behind ., !, ? or a line end; its place counts bytes of UTF-8.
_SENTENCE = re.compile(rb"[^.!?\n]+[.!?\n]*")


def features_of(word: bytes, stems: tuple[int, ...]) -> list[bytes]:
    """A word, and its beginnings of so many bytes."""
    return [word, *(word[:n] + b"-" for n in stems if len(word) > n)]


class ToxicityModel(NamedTuple):
    """Weights of the marked features, the offset of a sentence that has any, and a document's score
    if no sentence has: the share of toxic ones among such documents, whatever it is."""

    weights: dict[bytes, float]
    offset: float
    rest: float
    stems: tuple[int, ...] = (4, 7)


def noisy_or_fit(bags: list[list[list[int]]], y: np.ndarray, n_features: int, start: np.ndarray, ridge: float = 0.02, steps: int = 300):
    """(weights, offset, rest) by gradient ascent (Adam). A bag has the features of each marked sentence."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    item = np.array([f for bag in bags for s in bag for f in s], np.int64)
    of = np.array([i for i, s in enumerate(s for bag in bags for s in bag) for _ in s], np.int64)
    bare = np.array([not bag for bag in bags], bool)
    rest = float((y[bare].sum() + 0.1) / (bare.sum() + 1)) if len(y) else 0.0
    w, b = start.astype(float).copy(), -1.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    has = np.flatnonzero(~bare)
    for step in range(1, steps + 1 if len(doc) else 1):
        z = b + np.bincount(of, w[item], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        miss = np.log(max(1 - rest, 1e-9)) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
        q = 1 - np.exp(miss)
        # d log-likelihood / d miss: -1 for label 0's sum of logs, else through log(1 - exp(miss)).
        slope = np.where(y > 0.5, -np.exp(miss) / np.maximum(q, 1e-9), 1.0)
        dz = slope[doc] * -p
        grad = np.r_[np.bincount(item, dz[of], n_features) - ridge * len(has) / max(n_features, 1) * w, dz.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w + move[:-1], b + move[-1]
    return w, b, rest


def fit_toxicity(
    labelled: DataFrame,
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 20_000,
    least: int = 5,
    lift: float = 4.0,
    errors: float = 2.0,
    stems: tuple[int, ...] = (4, 7),
    ridge: float = 0.1,
) -> ToxicityModel:
    """Fits the model on texts labelled 1 or 0; other labels and null texts are left out.

    At most about ``sample_rows`` texts are used. A feature is marked if at least ``least`` distinct
    sentences hold it and, with ``errors`` standard errors to spare, the odds that they stem from toxic
    documents are over ``lift`` times a document's. All such features are fitted; the sample bounds them.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label")
    )
    sample = class_sample(rows.withColumn("any", F.lit(0)), "any", "text", sample_rows)
    sample = sample.select(F.col("text").cast("binary").alias("text"), "label")
    n, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    odds = lift * ((toxic or 0) + 0.5) / (n - (toxic or 0) + 0.5)

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, found = [], []
                for s in _SENTENCE.findall(text):
                    words = alnum_words(s)
                    if words:
                        keys.append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63))
                        found.append(sorted({f for w in words for f in features_of(w, stems)}))
                arrays = [pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.binary())), pa.array([label] * len(keys), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "features", "label"])

    # One row a distinct sentence and feature; the label is that of the toxic document, if any.
    said = sample.mapInArrow(sentences, "key long, features array<binary>, label int")
    pairs = said.select("key", "label", F.explode("features").alias("feature")).groupBy("key", "feature").agg(F.max("label").alias("label"))
    counts = pairs.groupBy("feature").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("t"))
    share, z = F.col("t") / F.col("n"), float(errors)
    spread = F.sqrt(share * (1 - share) / F.col("n") + F.lit(z * z / 4) / (F.col("n") * F.col("n")))
    low = (share + F.lit(z * z / 2) / F.col("n") - F.lit(z) * spread) / (1 + F.lit(z * z) / F.col("n"))
    marked = counts.where(F.col("n") >= least).withColumn("low", low).where(F.col("low") > odds / (1 + odds))
    chosen = marked.orderBy(F.desc("low"), "feature").collect()
    index = {bytes(r.feature): i for i, r in enumerate(chosen)}
    start = np.array([np.log(r.low / (1 - r.low)) for r in chosen])

    shared = labelled.sparkSession.sparkContext.broadcast(index)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                lists = [sorted({known[f] for w in alnum_words(s) for f in features_of(w, stems) if f in known}) for s in _SENTENCE.findall(text)]
                found.append([x for x in lists if x])
            keys = pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.list_(pa.list_(pa.int32()))), batch.column(1)], ["key", "bag", "label"])

    # A text that repeats counts once. What comes to the driver is bounded by the sample.
    fitted = sample.mapInArrow(bags, "key long, bag array<array<int>>, label int")
    points = fitted.groupBy("key").agg(F.max("label").alias("label"), F.max("bag").alias("bag")).orderBy("key").collect()
    w, b, rest = noisy_or_fit([r.bag for r in points], np.array([r.label for r in points], float), len(index), start, ridge)
    return ToxicityModel({f: float(w[i]) for f, i in index.items()}, float(b), rest, stems)


def cross_validated(
    labelled: DataFrame, settings: list[dict], text: str = "text", label: str = "toxic", folds: int = 4, threshold: float = 0.5
) -> list[tuple[dict, int, int, int]]:
    """(setting, caught, toxic, flagged) of each setting of ``fit_toxicity``, the best F1 first, equal ones in their order.

    Each labelled text is scored by a model that was fitted without its fold, which a hash of the text decides, so that
    copies are in one. Give it only rows that may be learned from: then a choice by it leaves held-out rows unseen.
    Null texts and labels other than 0 and 1 count nowhere; an empty table has no counts.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).alias("label"))
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(folds))))
    out = []
    for setting in settings:
        sums = [0, 0, 0]
        for fold in range(folds):
            model = fit_toxicity(rows.where(F.col("fold") != fold), "text", "label", **setting)
            scored = score_toxicity(rows.where(F.col("fold") == fold), model, "text", threshold, keep=["label"])
            found = scored.selectExpr("count_if(predicted = 1 and label = 1)", "count_if(label = 1)", "count_if(predicted = 1)").first()
            sums = [x + y for x, y in zip(sums, found, strict=True)]
        out.append((setting, *sums))
    discard(rows)
    return sorted(out, key=lambda x: -2 * x[1] / max(x[2] + x[3], 1))


class _Scorer:
    """Scores texts for one task; remembers the weights of up to ``memory`` words."""

    def __init__(self, model: ToxicityModel, memory: int = 200_000):
        self.model, self.memory, self.known = model, memory, {}

    def _marked(self, word: bytes) -> frozenset[bytes]:
        if len(self.known) >= self.memory:
            self.known.clear()
        found = frozenset(f for f in features_of(word, self.model.stems) if f in self.model.weights)
        self.known[word] = found
        return found

    def _of(self, words: list[bytes]) -> set[bytes]:
        known, out = self.known, set()
        for w in words:
            found = known.get(w)
            if found is None:
                found = self._marked(w)
            if found:
                out |= found
        return out

    def score(self, text: bytes | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (begin, end, score) of every sentence with a marked word."""
        miss, found = 1 - self.model.rest, []
        if text and self._of(alnum_words(text)):
            for s in _SENTENCE.finditer(text):
                own = self._of(alnum_words(s[0]))
                if own:
                    z = self.model.offset + sum(self.model.weights[f] for f in own)
                    p = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                    miss *= 1 - p
                    found.append((s.start(), s.end(), p))
        return 1 - miss, found


SENTENCE = T.StructType(
    [T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
)


def score_toxicity(
    documents: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None
) -> DataFrame:
    """Adds score (0 to 1), predicted (1 from ``threshold`` on) and offending sentences.

    ``offending`` lists begin, end (bytes of UTF-8) and score of each sentence that scores ``threshold``
    or more by itself. Whole texts are read, and nothing else. Edge cases: null and empty texts, and
    those without a marked word, get the model's remaining chance; repeated rows score alike; an empty
    table gives none; input columns named like an added one give way to it.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows():
        of = _Scorer(shared.value)

        def batch(texts):
            found = [of.score(x) for x in texts]
            named = [[dict(zip(("begin", "end", "score"), s, strict=True)) for s in x[1] if s[2] >= threshold] for x in found]
            return [[x[0] for x in found], [int(x[0] >= threshold) for x in found], named]

        return batch

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(SENTENCE))]
    return annotate(documents, rows, fields, text, keep)
