"""Relationships as joins: a parent as a struct, children as an array of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attach_parent(df: DataFrame, parent: DataFrame, foreign: str, key: str = "id", name: str = "parent") -> DataFrame:
    """Adds the parent row as struct ``name``, null without one. Whether it is broadcast is left to Spark."""
    packed = parent.select(F.col(key).alias("__key"), F.struct(*parent.columns).alias(name))
    return df.join(packed, df[foreign] == F.col("__key"), "left").drop("__key")


def _has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_has_order(f.dataType) for f in kind)
    return _has_order(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def nest_children(
    df: DataFrame, children: DataFrame, foreign: str, key: str = "id", name: str = "children", order: list[str] | None = None
) -> DataFrame:
    """Adds each row's children as array ``name``, empty without any, ordered by ``order``, then all columns
    that have an order (maps have none).

    Children are grouped before they are joined, so that several nests don't multiply each other.
    """
    first = [*(order or []), *(c for c in children.columns if c not in (order or []))]
    keys = [c for c in first if _has_order(children.schema[c].dataType)]
    if keys == first:
        packed = F.sort_array(F.collect_list(F.struct(*first)))
    else:
        place = lambda x: F.struct(*(x[c] for c in keys))
        compare = lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)
        packed = F.array_sort(F.collect_list(F.struct(*first)), compare)
    if first != children.columns:
        packed = F.transform(packed, lambda x: F.struct(*(x[c].alias(c) for c in children.columns)))
    grouped = children.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("__key")).agg(packed.alias(name))
    joined = df.join(grouped, df[key] == F.col("__key"), "left").drop("__key")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def nest_linked(
    df: DataFrame, link: DataFrame, other: DataFrame, own_key: str, link_own: str, link_other: str, other_key: str, name: str
) -> DataFrame:
    """Adds the rows of ``other`` that a link table ties to each row, as array ``name``; a repeated link counts once."""
    pairs = link.select(F.col(link_own).alias("__own"), F.col(link_other).alias("__other")).distinct()
    linked = pairs.join(other, F.col("__other") == other[other_key]).drop("__other")
    nested = nest_children(df, linked, "__own", own_key, name)
    return nested.withColumn(name, F.transform(name, lambda x: x.dropFields("__own")))


def with_associations(df: DataFrame, link: DataFrame, inputs: DataFrame, key: str = "id", name: str = "input_associations") -> DataFrame:
    """Adds a submission's links in processing order, each with its input object as struct input_object."""
    full = attach_parent(link, inputs, "input_object_id", "id", "input_object")
    return nest_children(df, full, "submission_id", key, name, ["processing_order", "input_object_id"])


def exists_child(df: DataFrame, children: DataFrame, foreign: str, key: str = "id", wanted: bool = True) -> DataFrame:
    """Rows that have a child, or have none."""
    keys = children.select(F.col(foreign).alias("__key"))
    return df.join(keys, df[key] == F.col("__key"), "left_semi" if wanted else "left_anti")


def children_summary(df: DataFrame, children: DataFrame, foreign: str, key: str, aggregates: dict[str, Column], counts: list[str]) -> DataFrame:
    """Adds aggregates over each row's children; those in ``counts`` are 0 without any, others null."""
    grouped = children.groupBy(F.col(foreign).alias("__key")).agg(*(c.alias(n) for n, c in aggregates.items()))
    joined = df.join(grouped, df[key] == F.col("__key"), "left").drop("__key")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}) if counts else joined
