"""Language identification by rank-order n-gram profiles.

A profile is the most frequent n-grams (of 1 to 3 letters, words padded with a boundary mark) in rank
order. A document's profile is compared to each language's by the out-of-place distance: the sum over
its n-grams of how far the ranks are apart, ``top`` if the language's profile lacks the n-gram.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, class_sample

UNKNOWN = "und"
_MARK = 0x5F


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or the mark for what is not a letter."""
    table = np.full(0x110000, _MARK, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, as integers in ascending order, and how often each occurs."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    x = np.r_[_MARK, _letters()[points], _MARK]
    x = x[np.r_[True, (x[1:] != _MARK) | (x[:-1] != _MARK)]]
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = x[:-1] << 21 | x[1:]
    three = two[:-1] << 21 | x[2:]
    return np.unique(np.concatenate([x[x != _MARK], two, three[x[1:-1] != _MARK]]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The n-grams by falling count, ties by n-gram, ``top`` at most."""
    return keys[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Rank-order profiles of some languages."""

    def __init__(self, by_language: dict[str, list[int]], top: int):
        self.languages, self.top = sorted(by_language), top
        self.keys = np.unique(np.array([k for v in by_language.values() for k in v], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int64)
        for j, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, by_language[language]), j] = np.arange(len(by_language[language]))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        own = ranked(*grams(text), self.top)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.ranks[at]
        away = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.top)
        total = away.sum(0)
        best = int(np.argmin(total))
        return self.languages[best], float(1 - total[best] / (self.top * len(own)))


def fit_profiles(
    labelled: DataFrame, by: str, text: str = "text", lang: str = "lang", top: int = 400, sample_rows: int = 3000
) -> Profiles:
    """Profiles from labelled rows, of which about ``sample_rows`` a language, chosen by a hash of column
    ``by``, are used at most. Rows whose lang or text is null are left out."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(by).alias("by"))
    sample = class_sample(rows, "lang", "by", sample_rows).where("text is not null")

    def count(batches):
        found: dict[str, dict[int, int]] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = found.setdefault(language, {})
                for k, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    counts[k] = counts.get(k, 0) + n
        for language, counts in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(counts)), pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())],
                ["lang", "gram", "n"],
            )

    counted = sample.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = total.withColumn("rank", rank).where(F.col("rank") <= top).collect()
    by_language: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r.lang, r.rank)):
        by_language.setdefault(r.lang, []).append(r.gram)
    return Profiles(by_language, top)


def identify_language(documents: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (1: all ranks agree, 0: no n-gram is known) from whole texts.

    Edge cases: ``und`` and score 0 if a text is null or has no letter, or no language was learned;
    equal distances go to the first language by code point; repeated rows are judged alike; an empty
    table gives none; input columns named like an added one give way to it.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def rows():
        known = shared.value

        def of(texts):
            found = [known.predict(x) for x in texts]
            return [[x[0] for x in found], [x[1] for x in found]]

        return of

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return annotate(documents, rows, fields, text, keep)


