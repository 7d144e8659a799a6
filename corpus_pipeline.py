"""Corpus preparation, from raw documents to a mix of clean ones, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. The first four return
the columns of documents, whatever they are; the last adds the mix's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import decontaminate, mixing, queries, quality, simhash, toxicity
from tidewell.llm.common import discard, read, written


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns c0, c1, ..., so that none clashes with an operator's, and their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), {c.lower(): n for c, n in zip(reversed(docs.columns), reversed(names), strict=True)}


def _back(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts score the share of good labels; without labels of both kinds all documents score
    alike; rows that repeat fare alike; an empty table stays empty; columns may have any names.
    """
    model = queries.quality_model(docs, read(spark, sf_dir, "labels"))
    plain, names = _plain(docs)
    return _back(quality.score_quality(plain, model, names["text"]).where("predicted = 1"), docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted to be toxic.

    Null and empty texts score as documents without a marked word; rows that repeat fare alike; without
    labels the remaining chance is small and all stay; an empty table stays empty; columns may have any names.
    """
    model = queries.toxicity_model(docs, read(spark, sf_dir, "labels"))
    plain, names = _plain(docs)
    return _back(toxicity.score_toxicity(plain, model, names["text"]).where("predicted = 0"), docs)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the one row with the least doc_id.

    Near duplicates have a Jaccard similarity of 0.8 or more of their five-word shingles. Rows without an
    id come after all ids; of rows alike in id, as without one, that of the least hash of its other columns stays.
    Null and empty texts are one group; a row that repeats stays once; an empty table stays empty.
    """
    del spark, sf_dir
    plain, names = _plain(docs)
    # Written, so that a row has its number whenever it is read.
    rows = written(plain.withColumn("row", F.monotonically_increasing_id()))
    doc_id = F.col(names["doc_id"])
    mark = F.xxhash64(*(f.name for f in plain.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    keyed = rows.withColumn("key", F.struct(doc_id.isNull().alias("lacks"), doc_id.alias("doc_id"), mark.alias("mark"), "row"))
    groups = simhash.similar_documents(keyed, "key", names["text"])
    first = groups.where(F.col("key.row") == F.col("component_id.row")).select("key.row")
    return _back(rows.join(first, "row", "left_semi"), docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null texts and texts without words hold none and stay; rows that repeat fare alike; an empty table stays
    empty, an empty benchmark drops none; columns may have any names.
    """
    plain, names = _plain(docs)
    found = decontaminate.find_contamination(plain, read(spark, sf_dir, "benchmark"), names["text"])
    return _back(found.where("n_hit = 0"), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken.

    Null texts and texts without words give none and go; a null source is a source; null and repeated ids
    are rows like any other; an empty table stays empty; columns named like an added one give way to it.
    """
    del spark, sf_dir
    plain, names = _plain(docs)
    key, source = names["doc_id"], names["source"]
    rest = [c for c in plain.columns if c not in (key, source)]
    mixed = mixing.mix(plain, key, source, names["text"], carry=rest).where("taken > 0")
    added = ["size", "source_size", "target", "taken"]
    own = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in added]
    return mixed.select(*(n for n, _ in own), *added).toDF(*(c for _, c in own), *added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("source mix", source_mix),
]

#: Models fitted on the data decide in the first two stages; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of what the others kept, only its input stays written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
