"""List requests: filter, sort and range as JSON texts, compiled to a plan.

Three endpoints of the service understand the same texts differently; each is a ``Dialect``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import paging
from ..operators.security import Principal, visible

#: Offsets from here on are located by counts; up to here the rows before a page are few enough to pass one task.
DEEP = 10_000


@dataclass(frozen=True)
class Dialect:
    """``exact``: fields compared by equality (None: the uuid columns of the schema). ``any_of``: whether
    a list on such a field means any of its values, or all of them at once. ``empty_list``: whether an
    empty list keeps all rows. ``inclusive``: whether a range includes its end."""

    name: str
    exact: frozenset[str] | None
    any_of: bool = True
    empty_list: bool = False
    inclusive: bool = True


CRUD = Dialect("crud", None, empty_list=True, inclusive=False)
OBJECTS = Dialect("objects", frozenset({"id", "object_id", "transect_id"}))
SUBMISSIONS = Dialect("submissions", frozenset({"id", "submission_id"}), any_of=False)


@dataclass(frozen=True)
class ListSpec:
    filters: dict[str, Any] = field(default_factory=dict)
    sort: tuple[str, str] | None = None
    page: tuple[int, int] | None = None

    @classmethod
    def parse(cls, filter: str | None = None, sort: str | None = None, range: str | None = None) -> ListSpec:  # noqa: A002
        """Absent texts mean no filter, order or range; a sort that isn't a pair is ignored."""
        filters, order, page = (json.loads(x) if x else empty for x, empty in ((filter, {}), (sort, []), (range, [])))
        if not isinstance(filters, dict):
            raise ValueError("filter must be a JSON object")
        if page and len(page) != 2:
            raise ValueError("range must be a pair")
        if page and not 0 <= page[0]:
            raise ValueError("range begins below 0")
        return cls(filters, tuple(order) if len(order) == 2 else None, tuple(page) if page else None)


@dataclass(frozen=True)
class Resource:
    """A table to list: its primary key, owner and, by field, child tables for existence filters as
    (child, foreign key, own key)."""

    name: str
    df: DataFrame
    key: str = "id"
    owner: str = "owner"
    children: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)


def exact_fields(df: DataFrame, dialect: Dialect) -> frozenset[str]:
    if dialect.exact is not None:
        return dialect.exact
    return frozenset(f.name for f in df.schema if f.metadata.get("uuid") and not f.nullable)


def _check(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"unknown field: {name}")
    return df.schema[name].dataType


def _contains(df: DataFrame, name: str, value: Any) -> Column:
    """Case-sensitive LIKE with the value's own wildcards in force; text columns only."""
    if not isinstance(_check(df, name), T.StringType):
        raise TypeError(f"{name} is not text")
    return F.col(name).like(f"%{value}%")


def _equals(name: str, value: Any) -> Column:
    return F.col(name) == F.lit(value)


def predicate(df: DataFrame, name: str, value: Any, dialect: Dialect) -> Column | None:
    """The condition of one field; None where it keeps all rows."""
    _check(df, name)
    if isinstance(value, bool):
        return _equals(name, value)
    exact = name in exact_fields(df, dialect)
    if not isinstance(value, list):
        return _equals(name, value) if exact else _contains(df, name, value)
    if not value:
        return None if dialect.empty_list else F.lit(False)
    if not exact:
        return reduce(or_, (_contains(df, name, v) for v in value))
    return F.col(name).isin(value) if dialect.any_of else reduce(and_, (_equals(name, v) for v in value))


def apply_filters(resource: Resource, df: DataFrame, spec: ListSpec, dialect: Dialect) -> DataFrame:
    for name, value in spec.filters.items():
        if isinstance(value, bool) and name in resource.children:
            child, foreign, own = resource.children[name]
            keys = child.select(F.col(foreign).alias("__key")).where("__key is not null")
            df = df.join(keys, df[own] == F.col("__key"), "left_semi" if value else "left_anti")
            continue
        condition = predicate(df, name, value, dialect)
        df = df if condition is None else df.where(condition)
    return df


def order_by(df: DataFrame, spec: ListSpec, key: str) -> list[paging.By]:
    """The order asked for ("ASC", anything else falls), nulls as the largest value; ties by key."""
    if spec.sort is None:
        return [paging.By(key)]
    name, direction = spec.sort
    _check(df, name)
    return [paging.By(name, direction != "ASC"), paging.By(key)]


def order(df: DataFrame, spec: ListSpec, key: str) -> list[Column]:
    return [by.column() for by in order_by(df, spec, key)]


def matching(resource: Resource, spec: ListSpec, principal: Principal, dialect: Dialect) -> DataFrame:
    """The rows that the principal may see and the filters keep."""
    return apply_filters(resource, visible(resource.df, principal, resource.owner), spec, dialect)


def list_rows(resource: Resource, spec: ListSpec, principal: Principal, dialect: Dialect) -> DataFrame:
    """One page of the matching rows, in order; only its rows pass through the last sort.

    A page at ``DEEP`` or beyond is located by jobs that run before this returns. Where neither an order nor a
    page is asked for, rows come as they are."""
    df = matching(resource, spec, principal, dialect)
    if spec.sort is None and spec.page is None:
        return df
    if spec.page is None:
        return df.orderBy(*order(df, spec, resource.key))
    start, end = spec.page
    return page_of(df, order_by(df, spec, resource.key), start, max(0, end - start + dialect.inclusive))


def page_of(df: DataFrame, by: list[paging.By], start: int, count: int) -> DataFrame:
    if start >= DEEP and count:
        return paging.page(df, by, start, count)
    return df.orderBy(*(b.column() for b in by)).offset(start).limit(count)


def count_rows(resource: Resource, spec: ListSpec, principal: Principal, dialect: Dialect) -> DataFrame:
    """total: how many rows match, whatever the page."""
    return matching(resource, spec, principal, dialect).agg(F.count(F.lit(1)).alias("total"))


def content_range(resource: Resource, spec: ListSpec, principal: Principal, dialect: Dialect) -> DataFrame:
    """content_range: ``name start-end/total``; the end as asked for, the total without a range."""
    total = count_rows(resource, spec, principal, dialect)
    start, end = spec.page if spec.page else (0, None)
    last = F.col("total") if end is None else F.lit(end)
    text = F.concat(F.lit(f"{resource.name} {start}-"), last.cast("string"), F.lit("/"), F.col("total").cast("string"))
    return total.select(text.alias("content_range"))
