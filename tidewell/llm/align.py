"""Alignment of two tokenizers' tokens over the same texts, as joins and windows.

Both tokenizers end a token wherever a visible character is followed by spaces and more text: no merge of either
reaches over such a place, which ``Tokenizers`` verifies in their files. So the tokens of a text are those of its
pieces between such places (of the whole text, if the files don't allow it), and each distinct piece of the corpus
is encoded and aligned once. In a piece:

- tokens are exploded with their places, and a window sums their lengths up to where each ends;
- tokens of both sides that end together meet by (piece, end); such an end is a cut;
- the running count of cuts numbers the groups;
- between two ends in a row, of either side, lies one overlap of one token of each: its link.

Documents are cut once, in blocks of about ``block_bytes`` of text. A block is one row: its distinct pieces, and its
documents as numbers of these. It asks once for each of its pieces, by the pieces' 64-bit keys, which are verified to be
distinct, and puts its documents together from the answers. Pieces that make up more than a ``share`` of all
occurrences, for each 16 bytes that they are long, are broadcast: these are fewer than 1 / ``share`` times 16 bytes in
all. The others meet those who ask in a shuffle, in which none is frequent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_counted, written
from .lm import _as_bytes, packed, unpacked

SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: A token as one long: side (0 for A), id, bytes, from the highest bit down.
_TOKENS = "array<long>"
_ID, _SIZE = 31, 31


@dataclass(frozen=True)
class Tokenizers:
    """The files of tokenizer A (byte-level BPE, JSON) and B (SentencePiece); every machine has them."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"

    def __reduce__(self):
        return Tokenizers, (self.a, self.b)  # tasks load the files themselves: settings of a model aren't pickled

    @cached_property
    def models(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(self.a)
        a.encode_special_tokens = True  # their strings in a text are plain text
        return a, SentencePieceProcessor(model_file=self.b)

    @cached_property
    def bytes_a(self) -> dict[int, bytes]:
        """Bytes of A's entries: printable bytes stand for themselves, the others, in order, for U+0100 and up."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        return {i: bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode() for entry, i in self.models[0].get_vocab().items()}

    @cached_property
    def bytes_b(self) -> list[bytes]:
        model = self.models[1]
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    @cached_property
    def separable(self) -> bool:
        """Whether no token of either reaches over a boundary: A splits texts by the byte-level expression, none of
        whose alternatives has white space after another character, and has no normalizer; no piece of B has a
        space after another character, and B leaves spaces alone."""
        import json

        a, b = self.models
        said = json.loads(a.to_str())
        first = said.get("pre_tokenizer") or {}
        by_words = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and said.get("normalizer") is None
        pieces = (b.id_to_piece(i) for i in range(b.get_piece_size()))
        return by_words and b.normalize("x  y ") == "▁x▁▁y▁" and not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list[bool], list[list[int]], list[list[int]]]:
        """(ok, A's ids, B's ids) of texts that begin with a space, which B adds itself; not ok, and without ids,
        where the tokens' bytes aren't the text's."""
        a, b = self.models
        ids_a = [x.ids for x in a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = b.encode([x[1:] for x in texts], num_threads=1)
        ok = []
        for text, one, two in zip(texts, ids_a, ids_b, strict=True):
            own = text.encode()
            ok.append(b"".join([self.bytes_a[i] for i in one]) == own == b"".join([self.bytes_b[i] for i in two]))
        empty: list[int] = []
        return ok, [x if y else empty for x, y in zip(ids_a, ok, strict=True)], [x if y else empty for x, y in zip(ids_b, ok, strict=True)]


@lru_cache(2)
def _loaded(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)  # once a worker


def _encoder(tokenizers: Tokenizers):
    """A UDF of pieces: their tokens, A's before B's; none where these don't give the piece back."""

    paths = (tokenizers.a, tokenizers.b)

    @F.arrow_udf(_TOKENS)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        tokenizers = _loaded(*paths)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        sizes_a = np.zeros(max(tokenizers.bytes_a) + 1, np.int32)
        sizes_a[list(tokenizers.bytes_a)] = [len(x) for x in tokenizers.bytes_a.values()]
        sizes_b = np.array([len(x) for x in tokenizers.bytes_b], np.int32)
        for batch in batches:
            ok, ids_a, ids_b = tokenizers.encode(batch.to_pylist())
            n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
            side = np.repeat(np.tile([0, 1], len(ok)), np.ravel([n_a, n_b], "F"))
            ids = np.fromiter(chain.from_iterable(chain.from_iterable(zip(ids_a, ids_b, strict=True))), np.int64, len(side))
            size = np.where(side == 0, sizes_a[np.where(side == 0, ids, 0)], sizes_b[np.where(side == 1, ids, 0)])
            ends = pa.array(np.r_[0, np.cumsum(n_a + n_b)].astype(np.int32))
            yield pa.ListArray.from_arrays(ends, pa.array(side << (_ID + _SIZE) | ids << _SIZE | size))

    return tokens


def pair_of(a: Column, b: Column) -> Column:
    """Both ids as one long."""
    return F.shiftleft(a.cast("long"), 31) + b


def align_pieces(pieces: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(key, hot, ok, n_a, n_b, n_groups, n_links, links, groups) of pieces (key, hot, piece), each of its own key.

    links are ``pair_of`` A's and B's ids; groups is ``a1,a2|b1;a3|b2;``.
    """
    by = ["key", "hot"]
    # One shuffle, of arrays: all windows and groupings below are by the key and more.
    encoded = pieces.select(*by, _encoder(tokenizers)("piece").alias("tokens")).repartition("key")
    # Few rows are put in order here, so that the many that come of them need no sorting but a look.
    encoded = encoded.sortWithinPartitions(*by)
    tokens = encoded.select(*by, F.posexplode_outer("tokens").alias("pos", "token"))
    part = lambda down, bits: F.shiftright("token", down).bitwiseAND((1 << bits) - 1)
    tokens = tokens.select(*by, "pos", part(_ID + _SIZE, 1).alias("side"), part(_SIZE, _ID).alias("id"), part(0, _SIZE).alias("size"))
    so_far = Window.partitionBy(*by, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.withColumn("end", F.sum("size").over(so_far))
    # Both sides come of the same rows: their outer join by (key, end) is a grouping, at most a row of each side.
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))
    ends = tokens.groupBy(*by, "end").agg(of(0).alias("a"), of(1).alias("b"))
    ends = ends.withColumn("cut", F.col("a").isNotNull() & F.col("b").isNotNull())
    # From the last end on, so that what is nearest at or after an end has been seen.
    back = Window.partitionBy(*by).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumns(
        {
            "to_a": F.last("a", True).over(back),
            "to_b": F.last("b", True).over(back),
            "group": F.sum(F.col("cut").cast("int")).over(back),
        }
    )
    # A token as one long, by its end: a sort of longs puts a side in order. It is its group's last on its side if it
    # ends at a cut.
    cut = F.col("cut").cast("long")
    in_order = lambda c: F.sort_array(F.collect_list(F.shiftleft(F.col("end"), 32) + F.shiftleft(F.col(c).cast("long"), 1) + cut))
    links = F.collect_list(F.when(F.col("end").isNotNull(), pair_of(F.col("to_a"), F.col("to_b"))))
    pieces = ends.groupBy(*by).agg(
        F.bool_and(F.col("end").isNotNull()).alias("ok"),
        F.count("a").alias("n_a"),
        F.count("b").alias("n_b"),
        F.coalesce(F.max("group"), F.lit(0)).cast("long").alias("n_groups"),
        F.count("end").alias("n_links"),
        links.alias("links"),
        in_order("a").alias("in_a"),
        in_order("b").alias("in_b"),
    )
    ids = lambda x: F.shiftright(x, 1).bitwiseAND((1 << _ID) - 1).cast("string")
    said = lambda side: F.array_join(F.transform(side, lambda x: F.concat(ids(x), F.when(x.bitwiseAND(1) == 1, ";").otherwise(","))), "")
    groups_of = lambda side: F.split(F.rtrim(said(side), F.lit(";")), ";", -1)
    groups = F.array_join(F.zip_with(groups_of("in_a"), groups_of("in_b"), lambda x, y: F.concat(x, F.lit("|"), y, F.lit(";"))), "")
    return pieces.withColumn("groups", F.when(F.col("n_groups") > 0, groups).otherwise("")).drop("in_a", "in_b")


@lru_cache(100_000)
def _visible(char: bytes) -> bool:
    """No white space of any kind, no control or unassigned character, no U+2581."""
    c = char.decode("utf-8", "replace")
    return unicodedata.category(c)[0] not in "ZC" and c != "\u2581"


def cut_texts(texts: list[bytes], whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, number of each text's pieces), with a space before each text; an empty text has none.

    A piece ends at a visible character before spaces and more text, or with its text (only so, if ``whole``).
    """
    some = [x for x in texts if x]
    joined = b"".join(y for x in some for y in (b" ", x))
    data = np.frombuffer(joined, np.uint8)
    stops = np.cumsum([len(x) + 1 for x in some], dtype=np.int64)
    starts = np.r_[0, stops[:-1]] if some else stops
    at = starts
    if some and not whole:
        spaces = data == 32
        change = np.flatnonzero(spaces[1:] != spaces[:-1]) + 1
        # All begins with a space: runs of others and of spaces follow in turn.
        runs, after = change[1::2], change[2::2]
        runs = runs[: len(after)]
        text_of = np.searchsorted(starts, runs, "right") - 1
        fine = (runs > starts[text_of]) & (after < stops[text_of])
        runs = runs[fine]
        before = data[runs - 1]
        fine = (before > 32) & (before < 127)
        for i in np.flatnonzero(before > 127).tolist():
            end = int(runs[i])
            begin = end - 1
            while data[begin] & 0xC0 == 0x80:
                begin -= 1
            fine[i] = _visible(joined[begin:end])
        at = np.sort(np.concatenate([starts, runs[fine]]), kind="stable")
    offsets = np.r_[at, len(data)].astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(joined))
    n = np.zeros(len(texts), np.int64)
    n[[i for i, x in enumerate(texts) if x]] = np.diff(np.searchsorted(at, np.r_[starts, len(data)])) if some else 0
    return pieces, n


def _blocks(block_bytes: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows (id, text) in blocks (block, pieces, counts, rows)."""

    def block_of(number: int, ids: list[pa.Array], texts: list[bytes | None]) -> pa.RecordBatch:
        pieces, n = cut_texts(texts, whole)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(n)], ["id", "n"])
        rows = pa.array([[_as_bytes(rows), packed(codes)]], pa.list_(pa.binary()))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        counts = pa.array(np.bincount(codes, minlength=len(coded.dictionary)))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(coded.dictionary), one(counts), rows], ["block", "pieces", "counts", "rows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids.append(part.column(0))
                texts += part.column(1).to_pylist()
                size += sum(len(x) for x in texts[-part.num_rows :] if x)
                if size >= block_bytes:
                    yield block_of(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield block_of(number, ids, texts)

    return work


def _documents(block: pa.Table, answers: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Table]:
    """(ids, number of pieces of each document, all of these as places in the answers, answers in the order of codes);
    a document has none where its tokens don't give it back."""
    (stored,) = block["rows"].to_pylist()
    rows = pa.ipc.open_stream(stored[0]).read_all()
    n, codes = rows["n"].to_numpy(), unpacked(stored[1], np.int32)
    answers = answers.sort_by("code")
    if len(answers) != (codes.max() + 1 if len(codes) else 0):
        raise RuntimeError("a block's pieces and their answers don't agree")
    doc = np.repeat(np.arange(len(n)), n)
    bad = np.zeros(len(n), bool)
    if len(codes):
        bad[doc[~answers["ok"].to_numpy()[codes]]] = True
    return rows["id"].combine_chunks(), np.where(bad, 0, n), codes[~bad[doc]], answers


def _held_pairs(block: pa.Table, answers: pa.Table) -> pa.Table:
    """(pair, docs): how many documents of a block hold each pair."""
    _, n, codes, answers = _documents(block, answers)
    made = [np.zeros(0, np.int64)] * 2
    if len(codes):
        links = answers["links"].combine_chunks()
        own, size = links.offsets.to_numpy()[:-1].astype(np.int64), links.value_lengths().to_numpy().astype(np.int64)
        pairs, of_link = np.unique(links.values.to_numpy(), return_inverse=True)
        once = np.unique(np.repeat(np.arange(len(n)), n) * len(answers) + codes)
        doc, code = np.divmod(once, len(answers))
        each = size[code]
        at = np.arange(each.sum()) + np.repeat(own[code] - np.r_[0, np.cumsum(each)[:-1]], each)
        held = np.unique(np.repeat(doc, each) * len(pairs) + of_link[at]) % len(pairs)
        docs = np.bincount(held, minlength=len(pairs))
        made = [pairs[docs > 0], docs[docs > 0]]
    return pa.table(made, names=["pair", "docs"])


def _put_together(block: pa.Table, answers: pa.Table) -> pa.Table:
    """(id, the sums, groups) of each document of a block."""
    ids, n, codes, answers = _documents(block, answers)
    ends = np.cumsum(n)
    sums = []
    for c in SUMS:
        so_far = np.r_[0, np.cumsum(answers[c].to_numpy()[codes])].astype(np.int64)
        sums.append(pa.array(so_far[ends] - so_far[ends - n]))
    # Texts that are taken stand one after the other: those of a document are one.
    taken = pa.concat_arrays([*answers["groups"].chunks, pa.array([], pa.string())]).take(pa.array(codes))
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int32)
    offsets = np.r_[0, offsets[ends]].astype(np.int32)
    groups = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), taken.buffers()[2] if len(codes) else pa.py_buffer(b""))
    return pa.table([ids, *sums, groups], names=["id", *SUMS, "groups"])


def _distinct(rows: DataFrame, key: str) -> bool:
    return not rows.groupBy(key).count().where("count > 1").limit(1).count()


def _in_rounds(step: Callable[[Column], DataFrame], rounds: int = 4, key: str = "key") -> DataFrame:
    """All rows of ``step``, which gets a condition on keys; a part of the keys after the other, so that the shuffles of
    one part alone are on disk."""
    parts = [written(step(F.pmod(key, F.lit(rounds)) == i), "zstd", tidy=True) for i in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


def align_tokens(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    tokenizers: Tokenizers | None = None,
    share: float = 2e-6,
    block_bytes: int = 5_000_000,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document row.

    A's tokens are those of a space and the text, B's those of the text. groups lists the ids between the ends at
    which tokens of both end, as ``a1,a2|b1;a3|b2``. n_links counts the pairs of tokens whose bytes overlap; a pair of
    ids counts as many documents as hold it linked; count_sum is its sum over the links, n_best the links whose pair
    has the highest count of A's id. ``block_bytes`` bounds memory and changes no result; a block holds at least one
    text. Edge cases: a text that is null or empty, or that its tokens don't give back, has
    none, so that all is zero and groups is ''; rows that are alike are counted, and returned, as often as they are
    there; a null id is one like others; an empty table gives none; other columns are not read.
    """
    tokenizers = tokenizers or Tokenizers()
    source = documents.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(_blocks(block_bytes, not tokenizers.separable), "block long, pieces array<string>, counts array<long>, rows array<binary>")
    blocks = written(made, "zstd", tidy=True)

    counted = blocks.select(F.explode(F.arrays_zip("pieces", "counts")).alias("x")).groupBy(F.col("x.pieces").alias("piece")).agg(F.sum("x.counts").alias("n"))
    seed = 0
    while True:
        key = F.xxhash64("piece", F.lit(seed)).alias("key")
        pieces = written(counted.select(key, "piece", "n"), "zstd", tidy=True)
        if _distinct(pieces, "key"):
            break
        discard(pieces)
        seed += 1
    total = pieces.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > share * total * F.ceil(F.octet_length("piece") / 16)
    aligned = written(align_pieces(pieces.select("key", "piece", is_hot.alias("hot")), tokenizers), "zstd", tidy=True)
    discard(pieces)

    def by_block(part: Column, known: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``work`` of each block and what is known (key, hot and more) of its pieces."""
        own = blocks.where(part)
        asked = own.select("block", F.posexplode("pieces").alias("code", "piece")).select("block", "code", key)
        hot, rest = known.where("hot").drop("hot"), known.where("not hot").drop("hot")
        rare = asked.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest.hint("shuffle_merge"), "key")
        answers = asked.join(F.broadcast(hot), "key").unionByName(rare).drop("key")
        return own.select(F.col("block").alias("of"), "rows").groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(work, schema)

    # How many documents hold a pair of ids linked.
    links = aligned.select("key", "hot", "ok", "links")
    held = _in_rounds(lambda part: by_block(part, links, _held_pairs, "pair long, docs long"), 2, "block")
    counts = held.groupBy("pair").agg(F.sum("docs").alias("docs"))
    best = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 31)))
    counts = counts.select("pair", "docs", (F.col("docs") == best).alias("best"))
    linked = aligned.select("key", "hot", F.explode("links").alias("pair"))
    counts = written(counts.join(linked.groupBy("pair").agg(F.count("*").alias("n")), "pair"), "zstd", tidy=True)
    discard(held)
    worth = join_counted(linked, counts, "pair", share=share).groupBy("key")
    worth = written(worth.agg(F.count_if("best").alias("n_best"), F.sum("docs").alias("count_sum")), "zstd", tidy=True)
    discard(counts)

    # The documents' sums and groups, in the order of their pieces. Pieces that no document holds have no worth.
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    known = written(aligned.drop("links").join(worth, "key", "left").withColumns(zero), "zstd", tidy=True)
    for table in (aligned, worth):
        discard(table)
    sums = ", ".join(f"{c} long" for c in SUMS)
    out = _in_rounds(lambda part: by_block(part, known, _put_together, f"id {kind}, {sums}, groups string"), key="block")
    for table in (blocks, known):
        discard(table)
    return out.withColumn("groups", F.rtrim("groups", F.lit(";"))).withColumnRenamed("id", id_col)
