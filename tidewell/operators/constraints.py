"""Checks of a table's constraints; each returns the rows that break it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; a null makes a key unlike any other."""
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def orphans(df: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return df.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(foreign) == F.col("__key"), "left_anti")


def negative(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(or_, (F.col(c) < 0 for c in columns)))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in a column that must have none."""
    return df.where(reduce(or_, (F.col(c).isNull() for c in columns)))
