"""Mutations as new states of a table: DataFrames don't change, so each returns the table after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(df: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Appends rows; columns they lack take a default, else null."""
    for name, value in (defaults or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, value.cast(df.schema[name].dataType))
    return df.unionByName(rows.select(*(c for c in rows.columns if c in df.columns)), allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns of the rows for which the condition holds; a null condition doesn't."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def patch(df: DataFrame, patches: DataFrame, key: str, set_fields: str = "set_fields") -> DataFrame:
    """Applies one patch a key: only the fields that it names in ``set_fields`` change, to null if it says so."""
    fields = [c for c in patches.columns if c not in (key, set_fields) and c in df.columns]
    changes = patches.select(F.col(key).alias("__key"), F.col(set_fields).alias("__set"), *(F.col(c).alias(f"__{c}") for c in fields))
    joined = df.join(changes, df[key] == F.col("__key"), "left")
    given = lambda c: F.coalesce(F.array_contains("__set", c), F.lit(False))
    return joined.withColumns({c: F.when(given(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in fields}).select(*df.columns)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(F.col(key).alias("__key")), df[key] == F.col("__key"), "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Without the rows for which the condition holds; those for which it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key, and are added otherwise."""
    return delete_keys(df, rows, key).unionByName(rows.select(*df.columns))


def clear_parent(children: DataFrame, deleted: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children of deleted parents lose the reference."""
    gone = deleted.select(F.col(key).alias("__key")).distinct()
    joined = children.join(gone, children[foreign] == F.col("__key"), "left")
    return joined.withColumn(foreign, F.when(F.col("__key").isNull(), F.col(foreign))).select(*children.columns)


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """A new column with a default in all rows, or nulls; an existing column stays."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns take new names; names that the table lacks are ignored."""
    return df.withColumnsRenamed(names)


def replace_column(df: DataFrame, old: str, new: str, kind: str, default=None) -> DataFrame:
    """A new column in place of an old one, whose values are given up."""
    return add_column(df.drop(old), new, kind, default)


def move_column(source: DataFrame, target: DataFrame, name: str, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """A column leaves ``source``, whose keys are unique, for the rows of ``target`` that refer to it; others get null."""
    moved = source.select(F.col(key).alias("__key"), F.col(name))
    return source.drop(name), target.join(moved, target[foreign] == F.col("__key"), "left").drop("__key")


def change_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Casts a column; from floating point to integers by rounding to the nearest even."""
    integer = kind in ("int", "integer", "bigint", "long", "smallint")
    real = df.schema[name].dataType.typeName() in ("double", "float")
    return df.withColumn(name, (F.rint(name) if integer and real else F.col(name)).cast(kind))
