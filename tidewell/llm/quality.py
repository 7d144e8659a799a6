"""Quality classifier by compression.

Two zstandard dictionaries are trained, from pieces of good and of bad labelled texts. A text is
compressed piece by piece with either; how many bytes fewer the good one needs, per byte of text, is
the normalised difference. A logistic curve turns it into a calibrated score. As short texts tell little,
whatever they are, what a text adds to the log-odds of good labels is damped by length / (length + 256):
the score of an empty text is the share of good labels. Pieces keep a dictionary's help alike at the end of a long text
and at its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, class_sample


class QualityModel(NamedTuple):
    """Dictionaries (None where a class has no text) and the logistic curve: its offset, and the slopes
    for the damped difference and the damping itself."""

    good: bytes | None
    bad: bytes | None
    offset: float = 0.0
    slope: float = 0.0
    length: float = 0.0
    piece: int = 1024
    level: int = 3


class _Compressor:
    """The normalised difference of texts, for one task."""

    def __init__(self, model: QualityModel):
        self.piece = model.piece
        self.kinds = [self._of(x, model.level) for x in (model.good, model.bad)] if model.good and model.bad else []

    @staticmethod
    def _of(data: bytes, level: int):
        kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        words = zstandard.ZstdCompressionDict(data, dict_type=kind)
        words.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_dict_id=False)

    def difference(self, text: bytes | None) -> float:
        if not text or not self.kinds:
            return 0.0
        good = bad = 0
        for at in range(0, len(text), self.piece):
            part = text[at : at + self.piece]
            good += len(self.kinds[0].compress(part))
            bad += len(self.kinds[1].compress(part))
        return (bad - good) / len(text)


def train_dictionary(pieces: list[bytes], size: int) -> bytes | None:
    """A zstandard dictionary; the pieces themselves where they are too few to train one."""
    if not pieces:
        return None
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float | None = None, ridge: float = 1e-4, steps: int = 100
) -> list[float]:
    """Offset and slopes of a logistic curve over the columns of x, by Newton's method with a slight ridge.

    An ``offset`` that is given stays.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return [float(np.log(share / (1 - share))), *[0.0] * x.shape[1]]
    scale = np.r_[1.0, np.where(x.std(0) > 0, x.std(0), 1.0)]
    a, b = np.column_stack([np.ones(len(x)), x]) / scale, np.zeros(x.shape[1] + 1)
    damp = np.r_[0.0, np.full(x.shape[1], ridge * weight.sum())]
    if offset is not None:
        b[0], a[:, 0] = offset, 0.0
        damp[0] = 1.0  # keeps the matrix regular; the gradient there is set to zero
    at = lambda b: a @ b + (b[0] if offset is not None else 0.0)
    loss = lambda b: weight @ (np.logaddexp(0, at(b)) - y * at(b)) + damp[1:] @ b[1:] ** 2 / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at(b), -500, 500)))
        curve = (a * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ a + np.diag(damp)
        slope = a.T @ (weight * (p - y)) + np.r_[0.0, damp[1:] * b[1:]]
        step, rate = np.linalg.solve(curve, slope), 1.0
        while loss(b - rate * step) > loss(b) + 1e-12 and rate > 1e-6:
            rate /= 2
        b = b - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return (b / scale).tolist()


def _known(n):
    """How much a text of n bytes tells, from 0 to 1; of numbers, arrays or columns."""
    return n / (n + 256)


def _pieces(sample: DataFrame, piece: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [text[i : i + piece] for i in range(0, len(text), piece)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array([label] * len(parts), pa.int32())], ["piece", "label"])

    return sample.select(F.col("text").cast("binary").alias("text"), "label").mapInArrow(cut, "piece binary, label int")


def fit_quality(
    labelled: DataFrame,
    text: str = "text",
    label: str = "quality",
    good_share: float | None = None,
    sample_rows: int = 4000,
    sample_pieces: int = 8000,
    piece: int = 1024,
    dictionary: int = 112_640,
    level: int = 3,
) -> QualityModel:
    """Fits the model on texts labelled 1 (good) and 0 (bad); other labels and null texts are left out.

    Of each class at most about ``sample_rows`` texts are used, a half (by hash) for the dictionaries,
    of which at most about ``sample_pieces`` distinct pieces a class come to the driver, the other half
    for the curve, of which distinct texts count once. If the rows are a sample that changed the share of
    good ones, ``good_share`` tells it, so that the score is calibrated for all.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1) & (F.length(text) > 0))
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sample = class_sample(rows, "label", "text", sample_rows)
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2))
    distinct = _pieces(sample.where(half == 0), piece).groupBy("piece").agg(F.max("label").alias("label"))
    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    for r in class_sample(distinct, "label", "piece", sample_pieces).toLocalIterator():
        pieces[r.label].append(bytes(r.piece))
    size = lambda p: max(256, min(dictionary, sum(map(len, p)) // 4))
    good, bad = (train_dictionary(sorted(pieces[k]), size(pieces[k])) for k in (1, 0))
    model = QualityModel(good, bad, piece=piece, level=level)
    scored = with_difference(sample.where(half == 1), model, keep=["label"], key=True)
    found = scored.groupBy("key").agg(*(F.max(c).alias(c) for c in ("label", "difference", "bytes"))).orderBy("key").collect()
    x = np.array([(r.difference * _known(r.bytes), _known(r.bytes)) for r in found]).reshape(-1, 2)
    y = np.array([r.label for r in found], float)
    weight, start = np.ones(len(y)), None
    if len(y) and 0 < y.mean() < 1:
        share = y.mean() if good_share is None else good_share
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        start = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    offset, slope, length = fit_logistic(x, y, weight, start)
    return model._replace(offset=offset, slope=slope, length=length)


def with_difference(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, key: bool = False) -> DataFrame:
    """Adds the normalised difference and the length in bytes, and with ``key`` a hash of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows():
        of = _Compressor(shared.value)
        return lambda texts: [[of.difference(x) for x in texts], [len(x or b"") for x in texts]]

    if key:
        df, keep = df.withColumn("key", F.xxhash64(text)), [*(keep or []), "key"]
    fields = [T.StructField("difference", T.DoubleType()), T.StructField("bytes", T.LongType())]
    return annotate(df, rows, fields, text, keep)


def score_quality(documents: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold`` on).

    Whole texts are compressed; nothing but the text is read. Edge cases: null and empty texts score the share
    of good labels; without labels of both kinds all texts score it (0.5 without any); repeated rows score alike; an empty table gives none; input columns named
    like an added one give way to it.
    """
    made = ("score", "predicted", "difference", "bytes")
    names = [c for c in (keep if keep is not None else documents.columns) if c.lower() not in made]
    out = with_difference(documents, model, text, names)
    level = F.lit(model.offset) + (F.lit(model.slope) * F.col("difference") + F.lit(model.length)) * _known(F.col("bytes"))
    score = 1 / (1 + F.exp(-F.least(F.greatest(level, F.lit(-40.0)), F.lit(40.0))))
    out = out.select(*(F.col(f"`{c}`") for c in names), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
