"""LIKE over many files: a Bloom sketch of each file's trigrams says which can't hold the text.

A sketch is a set of bits, one a trigram, by its hash; it is kept as 4 KB bitmaps, of which a file has as many as it
was given. A pattern's parts between wildcards have trigrams too, all of which a matching text holds; a file that
lacks the bit of one has no match, and isn't read. The exact filter runs on all others: those that may match, those
without a sketch, and those that were written since.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions.
BITS = 32_768


def trigrams_of(pattern: str, escape: str = "\\") -> set[str]:
    """Trigrams that every text which is LIKE the pattern holds; none for parts of fewer than three characters."""
    parts, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == escape and at + 1 < len(pattern):
            parts[-1] += pattern[at + 1]
            at += 1
        elif c in "%_":
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return {p[i : i + 3] for p in parts for i in range(len(p) - 2)}


def _bits(texts: list[str], bitmaps: int) -> np.ndarray:
    """The bits of all trigrams of some texts, repeats included."""
    # A lone surrogate, which no text holds, keeps the texts apart.
    code = np.frombuffer("\ud800".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(code) < 3:
        return np.empty(0, np.uint32)
    mixed = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> 15
    mixed *= np.uint32(0x27D4EB2F)
    mixed ^= mixed >> 13
    apart = code == 0xD800
    return mixed[~(apart[:-2] | apart[1:-1] | apart[2:])] % np.uint32(bitmaps * BITS)


def _batches(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts that aren't null, about ``size`` bytes at once, or one."""
    batch, held = [], 0
    for text in texts:
        if text is not None:
            batch.append(text.decode("utf-8", "replace"))
            held += len(text)
            if held >= size:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def sketch(files: DataFrame, column: str, bitmaps: int = 8) -> DataFrame:
    """(path, size, modified, bitmaps, bitmap, bits): the sketches of the files that ``files`` reads.

    About 8 * 32,768 bits, 32 KB a file, let a quarter of random trigrams pass at 75,000 distinct ones. Bits are
    set in the scan's tasks, which yield a row for each of a file's bitmaps, and merged by file and bitmap; so a
    trigram is never a row, and a file of any size, and of any number of tasks, makes no large group.
    """
    meta = F.col("_metadata")
    rows = files.select(
        meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), F.col(column).cast("string").alias("text")
    )

    def bits_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, np.zeros(bitmaps * BITS, bool)

        def made() -> pa.RecordBatch:
            of = held.reshape(bitmaps, BITS)
            # A file without a trigram has a sketch too: an empty one.
            kept = np.flatnonzero(of.any(1)) if of.any() else np.array([0])
            packed = [np.packbits(of[i], bitorder="little").tobytes() for i in kept]
            own = [pa.array([x.as_py()] * len(kept), x.type) for x in file]
            return pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.int32()), pa.array(packed, pa.binary())], ["path", "size", "modified", "bitmap", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").dictionary_encode().indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
            text = batch.column("text")
            text = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own = [batch.column(c)[start] for c in ("path", "size", "modified")]
                if file is not None and own != file:  # a task reads file after file
                    yield made()
                    held[:] = False
                file = own
                for texts in _batches(text[start:end].to_pylist()):
                    held[_bits(texts, bitmaps)] = True
        if file is not None:
            yield made()

    parts = rows.mapInArrow(bits_of_files, "path string, size long, modified timestamp, bitmap int, bits binary")
    merged = parts.groupBy("path", "size", "modified", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.withColumn("bitmaps", F.lit(bitmaps))


def may_match(sketches: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, size, modified, possible) of every sketched file: whether any of the patterns may match a row of it."""
    asked = [(i, t) for i, p in enumerate(patterns) for t in sorted(trigrams_of(p))]
    files = ["path", "size", "modified"]
    if len({i for i, _ in asked}) < len(patterns):  # one pattern has no trigram: any file may match
        return sketches.select(*files, F.lit(True).alias("possible")).distinct()
    spark = sketches.sparkSession
    kinds = [r.bitmaps for r in sketches.select("bitmaps").distinct().collect()]
    # Bounded by the length of the patterns: a row for each trigram.
    bits = {(k, i, int(_bits([t], k)[0])) for k in kinds for i, t in asked}
    wanted = spark.createDataFrame([(k, i, *divmod(bit, BITS)) for k, i, bit in sorted(bits)], "bitmaps int, pattern int, bitmap int, bit int")
    byte = F.conv(F.hex(F.substr("bits", F.expr("bit div 8") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0, F.lit(False))
    met = sketches.join(F.broadcast(wanted), ["bitmaps", "bitmap"])
    per_pattern = met.where(held).groupBy(*files, "bitmaps", "pattern").agg(F.count("*").alias("n"))
    needed = wanted.groupBy("bitmaps", "pattern").agg(F.count("*").alias("n"))
    possible = per_pattern.join(F.broadcast(needed), ["bitmaps", "pattern", "n"]).select(*files).distinct().withColumn("possible", F.lit(True))
    every = sketches.select(*files).distinct()
    return every.join(possible, files, "left").withColumn("possible", F.coalesce("possible", F.lit(False)))


def like_scan(spark: SparkSession, path: str, sketches: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows of the Parquet files below ``path`` whose column is LIKE one of the patterns; case-sensitive, with \\ to
    escape. Files that their sketch rules out aren't read; a file that changed since it was sketched is."""
    table = spark.read.parquet(path)
    if not patterns:
        return table.limit(0)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    ruled_out = {(_name(r.path), r.size, r.modified) for r in may_match(sketches, patterns).where("not possible").select("path", "size", F.unix_millis("modified").alias("modified")).collect()}
    kept = []
    for file in table.inputFiles():  # as Spark lists them to plan the scan
        status = fs.getFileStatus(fs_path(file))
        if (_name(file), status.getLen(), status.getModificationTime()) not in ruled_out:
            kept.append(file)
    if not kept:
        return table.limit(0)
    condition = F.lit(False)
    for p in patterns:
        condition = condition | F.col(column).like(p)
    return spark.read.schema(table.schema).parquet(*kept).where(condition)


def _name(path: str) -> str:
    """A file's path without its scheme, in which listings and metadata may differ."""
    return re.sub(r"^\w+:/*", "/", path)
