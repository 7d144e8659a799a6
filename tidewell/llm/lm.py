"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model over whole-corpus counts, smoothed by a Dirichlet prior: a word w after v
has (c(v w) + prior * p(w)) / (c(v) + prior), where p is the unigram model (c + 0.5) / (N + 0.5 (V + 1)),
which is also the base score. As an automaton: every learned word is a state, beside that of the empty
history; an arc of state v is a learned bigram, with that log-probability; v's failure arc leads to the
empty history at log(prior / (c(v) + prior)), whose arcs are the words. A text is one traversal from left
to right, beginning in the state of the end token. All words and all bigrams of the training texts
count, at any size of the corpus: nothing is cut by a share or a least count.

Scale: documents are read in blocks of about ``block_tokens`` tokens. A block asks once for each of its
distinct words and bigrams (64-bit keys), and says how often its own training texts have it: keys are
dealt to buckets by ranges, a bucket adds up what all blocks say, and answers each block that asked.
The block then has the part of the automaton that its texts can meet, and traverses them. So the
counts are never whole anywhere, a frequent key comes once a block, and both exchanges carry sorted,
packed keys and counts. The number of buckets follows the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, space_words, tidied

#: The end of a text, which is no word: words hold no white space.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))

_EXCHANGED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
_EXCHANGED_DDL = "bucket int, block long, keys binary, counts binary, texts binary"


class _Keys(dict):
    """The 64-bit key of each word; at most ``bound`` are remembered."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word)
        return key

    def of(self, text: bytes) -> np.ndarray:
        """The keys of a text's tokens: its words, then the end."""
        words = space_words(text)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of bigrams of words with such keys."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Grams:
    """A block's tokens and bigrams: ``keys`` are its distinct ones in order, ``at`` the place of each
    token's and then of each bigram's key in them; ``starts`` are the texts' first tokens."""

    def __init__(self, texts: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        tokens = np.concatenate(texts)
        before = np.roll(tokens, 1)
        before[self.starts] = END
        grams = np.concatenate([tokens, pair_keys(before, tokens)])
        del tokens, before
        # As np.unique would give both, in less memory: a block's grams are the most that a task holds.
        order = np.argsort(grams)
        grams = grams[order]
        first = np.r_[True, grams[1:] != grams[:-1]]
        self.keys = grams[first]
        del grams
        self.at = np.empty(len(order), np.int32)
        self.at[order] = np.cumsum(first, dtype=np.int32) - 1

    def counts(self, learned: np.ndarray) -> np.ndarray:
        """How often the texts marked as learned have each key."""
        mask = np.repeat(learned, self.lengths)
        return np.bincount(self.at, np.r_[mask, mask], len(self.keys)).astype(np.uint64)


class Automaton:
    """The part of the model that one block's texts can meet; ``counts`` are those of ``grams.keys``."""

    def __init__(self, grams: Grams, counts: np.ndarray, z: float, prior: float):
        self.grams, self.prior = grams, prior
        n = len(grams.at) // 2
        found = counts.astype(np.float64)[grams.at]
        self.of_token, self.of_pair = found[:n], found[n:]
        self.of_state = np.roll(self.of_token, 1)
        self.of_state[grams.starts] = self.of_token[np.cumsum(grams.lengths) - 1]
        self.word = (self.of_token + 0.5) / z

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 base probability, number of learned tokens) of each text.

        The state a token is met in is the token before it, so that all steps are taken at once: by an
        arc if there is one, or else by the failure arc and the word's own.
        """
        word = np.log10(self.word)
        arc = np.log10((self.of_pair + self.prior * self.word) / (self.of_state + self.prior))
        fail = np.log10(self.prior / (self.of_state + self.prior))
        step = np.where(self.of_pair > 0, arc, fail + word)
        add = lambda x: np.add.reduceat(x, self.grams.starts)
        return add(step), add(word), add((self.of_token > 0).astype(np.int64))


def bucket_of(block: int, buckets: int) -> int:
    """The bucket that a block's texts pass through. By a hash: a block's number is its task's times 2**32, plus a few."""
    return xxhash.xxh64_intdigest(block.to_bytes(8, "little")) % buckets


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(x: bytes, kind: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _as_bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[tuple[int, pa.Table, list[np.ndarray]]]:
    """(number, rows of id, held_out and text, keys of their tokens) of each block of a task."""
    known, number = _Keys(), TaskContext.get().partitionId() << 32
    rows, keys, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            new = [known.of(x) for x in part.column(2).to_pylist()]
            rows.append(part)
            keys += new
            n += sum(map(len, new))
            if n >= block_tokens:
                yield number, pa.Table.from_batches(rows), keys
                rows, keys, n = [], [], 0
                number += 1
    if rows:
        yield number, pa.Table.from_batches(rows), keys


def _learned(rows: pa.Table) -> np.ndarray:
    return ~rows.column(1).to_numpy()


def totals(rows: DataFrame, block_tokens: int) -> tuple[int, int, int]:
    """(training tokens, distinct ones, tokens of all rows)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, keys in _blocks(batches, block_tokens):
            of = _learned(block)
            learned = [x for x, y in zip(keys, of, strict=True) if y]
            distinct, n = np.unique(np.concatenate(learned), return_counts=True) if learned else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            n = np.r_[n, sum(len(x) for x, y in zip(keys, of, strict=True) if not y)]
            yield pa.RecordBatch.from_arrays([pa.array([*distinct.view(np.int64), None], pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    known = F.when(F.col("key").isNotNull(), F.col("n"))
    with tidied(rows.sparkSession):
        found = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        n, v, everything = found.agg(F.sum(known), F.count("key"), F.sum("n")).first()
    return n or 0, v, everything or 0


def score_texts(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    folds: int = 5,
    held_out_fold: int = 1,
    prior: float = 1000.0,
    block_tokens: int = 1_000_000,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document row.

    Learned from the documents whose crc32 of the id as text, modulo ``folds``, isn't
    ``held_out_fold``. n_tokens counts words and the end, n_known those that were learned; scores are
    log10 probabilities. ``block_tokens`` bounds memory and changes no score; a block holds at least one
    text. Documents are best read from files: if a lost task is run again on rows in another order, its
    blocks no longer fit the answers, which raises an error and never gives a wrong score.
    Edge cases: a null text is the empty one, an end alone; a row whose id is null
    has no fold, isn't learned from and counts as held out; repeated rows are learned from and scored
    each; with nothing to learn from, all words are unknown; an empty table gives none; other columns
    are not read.
    """
    texts = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    rows = documents.select(F.col(id_col).alias("id"), is_held_out(id_col, folds, held_out_fold).alias("held_out"), texts)
    n, v, everything = totals(rows, block_tokens)
    z = n + 0.5 * (v + 1)
    buckets = max(-(-everything // block_tokens), documents.sparkSession.sparkContext.defaultParallelism)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, keys in _blocks(batches, block_tokens):
            grams = Grams(keys)
            counts = grams.counts(_learned(part))
            of = ((grams.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edges = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
            # Keys are in order: their differences pack better than they do.
            spans = [(int(of[i]), packed(np.diff(grams.keys[i:j], prepend=np.uint64(0))), packed(counts[i:j])) for i, j in zip(edges, edges[1:], strict=False)]
            whole = _as_bytes(part.combine_chunks().to_batches()[0])
            lists = [[s[0] for s in spans], [block] * len(spans), [s[1] for s in spans], [s[2] for s in spans], [None] * len(spans)]
            more = [bucket_of(block, buckets), block, None, None, whole]
            yield pa.RecordBatch.from_arrays([pa.array([*x, y], f.type) for x, y, f in zip(lists, more, _EXCHANGED, strict=True)], schema=_EXCHANGED)

    def answer(table: pa.Table) -> pa.Table:
        asked = table.filter(pa.compute.is_valid(table["keys"]))
        out = [table.filter(pa.compute.is_valid(table["texts"]))]
        if len(asked):
            keys = [np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in asked["keys"]]
            counts = np.concatenate([unpacked(x.as_py()) for x in asked["counts"]])
            at = np.unique(np.concatenate(keys), return_inverse=True)[1]
            sums = np.bincount(at, counts).astype(np.uint64)[at]
            ends = np.cumsum([len(x) for x in keys])
            # Instead of the keys, the block gets a sum of them to hold against its own.
            sent = [packed(sums[j - len(x) : j]) for x, j in zip(keys, ends, strict=True)]
            marks = [int(x.sum(dtype=np.uint64)).to_bytes(8, "little") for x in keys]
            out.append(pa.table([asked["bucket"], asked["block"], pa.array(marks, pa.binary()), pa.array(sent, pa.binary()), asked["texts"]], schema=_EXCHANGED))
        return pa.concat_tables(out)

    kind = documents.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def traverse(table: pa.Table) -> pa.Table:
        answers = table.filter(pa.compute.is_valid(table["counts"])).sort_by("bucket")
        (whole,) = table["texts"].drop_null().to_pylist()
        part = pa.ipc.open_stream(whole).read_all()
        known = _Keys()
        grams = Grams([known.of(x.as_py()) for x in part.column(2)])
        counts = np.concatenate([unpacked(x.as_py()) for x in answers["counts"]])
        marks = sum(int.from_bytes(x.as_py(), "little") for x in answers["keys"]) & 0xFFFFFFFFFFFFFFFF
        if len(counts) != len(grams.keys) or marks != int(grams.keys.sum(dtype=np.uint64)):
            raise RuntimeError("the documents' rows were read in different orders; write them to a table first")
        score, base, learned = Automaton(grams, counts, z, prior).scores()
        columns = [part.column(0), part.column(1), pa.array(grams.lengths), pa.array(learned), pa.array(base), pa.array(score)]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    asked = rows.mapInArrow(ask, _EXCHANGED_DDL)
    answered = asked.groupBy("bucket").applyInArrow(answer, _EXCHANGED_DDL)
    scored = answered.groupBy("block").applyInArrow(
        traverse, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
