"""Benchmark decontamination by winnowing.

Every text is a sequence of words. A *window* is ``window`` consecutive words of a benchmark item;
an item of fewer words is one window. Fingerprints are winnowed: of each run of ``w`` consecutive
``k``-gram hashes the least (rightmost if tied) is kept, with ``k + w - 1 = window``. Which one is
kept depends on those ``window`` words alone, so document and item keep the same one of every
shared window: each shared span of that length meets in the fingerprint join. Hits are extended to
maximal runs of equal words, so that no hash decides. Items shorter than a window are fingerprinted
with ``k`` = their length and ``w`` = 1.

Items are tokenised and cut in tasks into pieces that overlap by ``window - 1`` words, so that each
window lies whole in one of them; copies are dropped. Pieces fill blocks of at most ``block_words``
words and eight bytes a word, whose index is broadcast: its size is bounded by that parameter, not by
the data. Documents are scanned once a block and never shuffled, so neither a passage that a third of
all documents share nor one long document makes a hot task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, annotate, discard, distinct_columns, written

#: Words of a piece of an item, and bytes of pieces that the driver takes from a task at once.
_PIECE, _FETCH = 4096, 8 << 20

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _kgrams(hashes: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the highest value where a word is unknown to the benchmark."""
    n = len(hashes) - k + 1
    out, ok = np.zeros(max(n, 0), np.uint64), np.ones(max(n, 0), bool)
    for j in range(k if n > 0 else 0):
        out = out * _FACTOR + hashes[j : j + n]
        ok &= known[j : j + n]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    out ^= out >> np.uint64(29)
    out[~ok] = _NONE
    return out


def _winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions kept by winnowing: of each w consecutive hashes the least, rightmost if tied."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        new = grams[j : j + n]
        less = new <= best
        best[less] = new[less]
        at[less] = np.flatnonzero(less) + j
    at = at[best != _NONE]
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


class BlockIndex:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, k: int):
        self.window, self.vocabulary = window, {}
        self.ids, self.words = [], []
        for item, text in items:
            words = alnum_words(text)
            if words:
                self.ids.append(item)
                self.words.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words])
        self.hashes = np.array([0, *(xxhash.xxh64_intdigest(x) for x in self.vocabulary)], np.uint64)
        postings: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            short = len(words) < window
            shape = (len(words), 1) if short else (k, window - k + 1)
            grams = self._grams(np.array(words), shape[0])
            for at in _winnow(grams, shape[1]).tolist():
                postings.setdefault(shape, []).append((int(grams[at]), i, at))
        self.tables = []
        for shape, found in sorted(postings.items()):
            found.sort()
            keys = np.array([x[0] for x in found], np.uint64)
            self.tables.append((shape, keys, [x[1:] for x in found]))

    def _grams(self, ids: np.ndarray, k: int) -> np.ndarray:
        return _kgrams(self.hashes[ids], ids > 0, k)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        ids = list(map(self.vocabulary.get, words, repeat(0)))
        array = np.fromiter(ids, np.int64, len(ids))
        for (k, w), keys, places in self.tables:
            grams = self._grams(array, k)
            at = _winnow(grams, w)
            if not len(at):
                continue
            first, last = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
            some = np.flatnonzero(last > first)
            done: dict[tuple[int, int], int] = {}
            for p, i, j in zip(at[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                for item, q in places[i:j]:
                    if done.get((item, p - q), -1) > p:
                        continue  # inside a run that was found before
                    begin, end = self._run(ids, p, self.words[item], q)
                    done[item, p - q] = end
                    if end - begin >= min(self.window, len(self.words[item])):
                        hit[begin:end] = True
                        found.add(item)
        return hit, found

    @staticmethod
    def _run(doc: list[int], p: int, item: list[int], q: int) -> tuple[int, int]:
        """The maximal run of equal words about doc[p] = item[q]."""
        back = 0
        while back < p and back < q and doc[p - back - 1] == item[q - back - 1]:
            back += 1
        on, most = 0, min(len(doc) - p, len(item) - q)
        while on < most and doc[p + on] == item[q + on]:
            on += 1
        return p - back, p + on


def _pieces(items: DataFrame, window: int, length: int) -> DataFrame:
    """Distinct (id, piece, size) of (id, text) items: pieces of ``length`` words at most, in which each window
    lies whole; ``size`` is the number of words, or an eighth of that of bytes if that is more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                starts = range(0, max(len(words) - window, 0) + 1 if words else 0, length - window + 1)
                parts = [words[i : i + length] for i in starts]
                pieces = [b" ".join(x) for x in parts]
                sizes = [max(len(x), len(y) // 8) for x, y in zip(parts, pieces, strict=True)]
                columns = [pa.array([item] * len(parts), pa.string()), pa.array(pieces, pa.binary()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "size"])

    return items.mapInArrow(cut, "id string, piece binary, size long").distinct()


def _blocks(pieces: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The pieces in blocks whose sizes add up to ``block_words`` at most, or of one piece; one empty block of none."""
    total = pieces.agg(F.sum("size")).first()[0] or 0
    block, size = [], 0
    for r in pieces.repartition(1 + total * 8 // _FETCH, "id", "piece").toLocalIterator():
        if block and size + r.size > block_words:
            yield block
            block, size = [], 0
        block.append((r.id, bytes(r.piece)))
        size += r.size
    yield block


#: What find_contamination adds to each document.
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    k: int = 5,
    block_words: int = 2_000_000,
    hot_rows: int = 200_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds to each document n_words, n_hit, items (ids as strings, sorted) and spans.

    A document word is hit if it lies inside an occurrence of a window; ``spans`` lists the maximal
    hit runs as [first word, behind the last word]. Edge cases: a null or wordless text has no words,
    spans or items; a null or wordless item has no windows; an item whose id is null hits words but
    is not listed; repeated ids are listed once; repeated document rows are judged row by row; an
    empty benchmark hits nothing; input columns named like an added one give way to it.
    """
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to window")
    source = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text"))
    length = max(window, min(_PIECE, block_words))
    blocks = _blocks(_pieces(source, window, length), block_words)
    block, after = next(blocks), next(blocks, None)
    spark = documents.sparkSession
    indexed = lambda block: spark.sparkContext.broadcast(BlockIndex(sorted(block, key=lambda x: (x[0] is None, x)), window, k))
    if after is None:
        return _scan(documents, indexed(block), text, True, keep)
    # What a text holds is its own, so that copies are one. A pass yields the texts that hold something of its block.
    mark = F.struct(*(F.xxhash64(F.lit(i), F.col(text)).alias(f"h{i}") for i in (0, 1)))
    texts, parts = documents.select(mark.alias("mark"), F.col(text).alias("text")), []
    while block is not None:
        index = indexed(block)
        found = _scan(texts, index, "text", True, ["mark"]).where("n_hit > 0").groupBy("mark")
        parts.append(written(found.agg(F.any_value("items").alias("items"), F.any_value("spans").alias("spans"))))
        index.destroy()  # so that one block's index is held at a time
        block, after = after, next(blocks, None)
    both = reduce(DataFrame.unionByName, parts).groupBy("mark")
    both = written(both.agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")))
    for part in parts:
        discard(part)
    # Where they are few, documents stay where they are; else they are shuffled once.
    met = F.broadcast(both) if both.count() <= hot_rows else both
    names = distinct_columns(documents, [f.name for f in FIELDS])
    own = [c for c in names if keep is None or c in keep]
    marked = documents.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), mark.alias("mark"), F.col(text).alias("text"))
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in FIELDS[2:]}
    joined = marked.join(met, "mark", "left").withColumns(empty)
    out = _scan(joined, indexed([]), "text", False, ["own"])
    return out.select(*(F.col("own")[c].alias(c) for c in own), *(f.name for f in FIELDS))


def _scan(documents: DataFrame, index, text: str, first: bool, keep: list[str] | None) -> DataFrame:
    """One pass over the documents; where it isn't the ``first``, what was found before, as items and spans, is added."""
    before = [] if first else ["items", "spans"]

    def rows():
        block = index.value

        def of(texts, earlier=None):
            n_words, n_hit, items, spans = [], [], [], []
            for i, data in enumerate(texts):
                words = alnum_words(data)
                hit, found = block.hits(words)
                named = {block.ids[x] for x in found} - {None}
                if earlier:
                    named |= set(earlier["items"][i])
                    for begin, end in earlier["spans"][i]:
                        hit[begin:end] = True
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                items.append(sorted(named))
                spans.append(edges.reshape(-1, 2).tolist())
            return [n_words, n_hit, items, spans]

        return of

    return annotate(documents, rows, FIELDS, text, keep, carried=before)
