"""Helpers shared by the text operators: tokenising, Arrow mapping, samples and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte map for alphanumeric words: A-Z to lower case; digits, letters and all non-ASCII bytes
#: stay; every other byte becomes a space, so that ``bytes.split`` yields the words.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; null has none."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8; null has none."""
    return text.lower().split() if text else []


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id, which belongs to no fold."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def is_held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where nothing may be learned from the row: its fold is held out, or its id is null."""
    return F.coalesce(fold(id_col, modulus) == remainder, F.lit(True))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder the cluster names.

    Only where ``spark.checkpoint.dir`` is unset and Spark runs in one process, as in tests, a temporary
    folder is used; on a cluster that is an error, as executors don't share one.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-checkpoint-"))
    return df.checkpoint(eager=True)


#: Spark deletes the files of a query's shuffles as it ends, not when the driver happens to collect garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here delete their shuffles at their end."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def written(df: DataFrame, compression: str = "snappy", tidy: bool = False) -> DataFrame:
    """Cuts lineage with a compressed Parquet table beside the checkpoints; for wider or longer tables.

    If ``tidy``, the write's own shuffles are deleted at its end; no later query reads them.
    """
    spark = df.sparkSession
    checkpointed(spark.range(1).limit(0))
    path = f"{_shared_folder(spark)}/{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true" if tidy else before)
    try:
        # Planned under this setting, which a frame keeps from where it was made.
        df.select("*").write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def discard(table: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing will read it any more; others are left alone."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if f"/{spark.sparkContext.applicationId}-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n", share: float = 1e-3) -> DataFrame:
    """Inner join of ``rows`` with ``counted``: one row a key, whose column ``n`` says how many rows have it.

    Keys of more than ``share`` of all rows number fewer than 1 / share: they are broadcast, and their
    rows stay where they are. The others meet in a shuffle, in which no key is hot. ``counted`` is
    read several times. Column ``n`` isn't kept; null keys meet nothing.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) > share * total
    hot, rest = counted.where(is_hot).drop(n), counted.where(~is_hot).drop(n)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def class_sample(df: DataFrame, label: str, by: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each label at most, chosen by a hash of ``by``; all of a label with fewer.

    Reruns agree. Rows whose label is null are left out. Copies in ``by`` are chosen together.
    """
    grain, chance = 1 << 30, F.lit(0)
    for label_of, n in df.where(F.col(label).isNotNull()).groupBy(label).count().collect():
        chance = F.when(F.col(label) == label_of, int(grain * min(1.0, bound / n))).otherwise(chance)
    return df.where(F.pmod(F.xxhash64(F.col(by), F.lit("sample")), F.lit(grain)) < chance)


def distinct_columns(df: DataFrame, added: list[str]) -> list[str]:
    """Columns of ``df`` whose names, in any case, don't clash with columns that an operator adds."""
    taken = {x.lower() for x in added}
    return [c for c in df.columns if c.lower() not in taken]


def annotate(
    df: DataFrame,
    rows: Callable[[], Callable[[list[bytes | None]], list[list]]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
    carried: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed from a text column, batch by batch, without a shuffle.

    ``rows`` is called once a task and returns the function of a batch: from its texts (UTF-8
    bytes or None) to one list a field. ``keep`` names the columns that stay (default: all);
    of these, columns that clash with an added name give way to it.
    ``carried`` names columns that a second argument of that function gets, as lists by name.
    """
    carried = carried or []
    added = [f.name for f in fields]
    names = [c for c in (keep if keep is not None else df.columns) if c in distinct_columns(df, added)]
    schema = T.StructType([df.schema[c] for c in names] + fields)
    kinds = [_arrow_type(f.dataType) for f in fields]
    source = df.select(*(F.col(f"`{c}`") for c in names), F.col(text).cast("binary").alias("__text"), *(F.col(c).alias(f"__{c}") for c in carried))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rows()
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(len(names)).to_pylist()
                more = {c: part.column(len(names) + 1 + i).to_pylist() for i, c in enumerate(carried)}
                results = of(texts, more) if carried else of(texts)
                arrays = [part.column(i) for i in range(len(names))]
                arrays += [pa.array(x, type=k) for x, k in zip(results, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    return source.mapInArrow(work, schema)


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that what a task holds beside the batch stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
