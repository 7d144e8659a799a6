"""Deep pages: the place of a row in a large order, found by counts.

``offset`` sends every row before the page to one task. Here the rows at the page's two ends are found first: a
bounded sample of the rows in question divides the order into ranges, closely about where it has the wanted
places, one pass counts the rows of each range, the counts say which ranges hold the places, and these are divided
again until they are small. Then the page is a range filter, which reaches the scan, and only its own rows are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Key = tuple[Any, ...]


@dataclass(frozen=True)
class By:
    """One column of an order; nulls count as the largest value."""

    name: str
    falling: bool = False

    def column(self) -> Column:
        return F.col(self.name).desc_nulls_first() if self.falling else F.col(self.name).asc_nulls_last()

    def _less(self, value: Any, kind: T.DataType) -> Column:
        c = F.col(self.name)
        return c.isNotNull() if value is None else c < F.lit(value).cast(kind)

    def _greater(self, value: Any, kind: T.DataType) -> Column:
        c = F.col(self.name)
        return F.lit(False) if value is None else c.isNull() | (c > F.lit(value).cast(kind))

    # Null conditions count as false; as they are only joined by and and or, none has to be made so.
    def before(self, value: Any, kind: T.DataType) -> Column:
        return self._greater(value, kind) if self.falling else self._less(value, kind)

    def after(self, value: Any, kind: T.DataType) -> Column:
        return self._less(value, kind) if self.falling else self._greater(value, kind)

    def equal(self, value: Any, kind: T.DataType) -> Column:
        return F.col(self.name).isNull() if value is None else F.col(self.name) == F.lit(value).cast(kind)


class Order:
    """A total order of a table's rows: its columns, then a hash of the whole row, so that only rows that are
    alike in all columns that can be hashed are equal."""

    def __init__(self, df: DataFrame, by: list[By]):
        hashable = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()]
        self.df = df.withColumn("__hash", F.xxhash64(*(F.col(f"`{c}`") for c in hashable)))
        self.by = [*by, By("__hash")]
        self.kinds = [self.df.schema[b.name].dataType for b in self.by]

    def columns(self) -> list[Column]:
        return [b.column() for b in self.by]

    def equal(self, key: Key) -> Column:
        return reduce(and_, (b.equal(v, k) for b, v, k in zip(self.by, key, self.kinds, strict=True)))

    def before(self, key: Key) -> Column:
        return self._side(By.before, key)

    def after(self, key: Key) -> Column:
        return self._side(By.after, key)

    def _side(self, side, key: Key) -> Column:
        parts, same = [], F.lit(True)
        for b, v, k in zip(self.by, key, self.kinds, strict=True):
            parts.append(same & side(b, v, k))
            same = same & b.equal(v, k)
        return reduce(or_, parts)

    def rows(self, low: Key | None, high: Key | None, closed: bool = False) -> DataFrame:
        """Those after ``low`` and before ``high``, or at them if closed; the bounds of the first column's values stand
        alone too, for the scan."""
        side = lambda inner, key: inner(key) | self.equal(key) if closed else inner(key)
        df = self.df if low is None else self.df.where(side(self.after, low))
        df = df if high is None else df.where(side(self.before, high))
        least, most = (high, low) if self.by[0].falling else (low, high)
        if most is not None and most[0] is not None:
            c, kind = F.col(self.by[0].name), self.kinds[0]
            df = df.where(c <= F.lit(most[0]).cast(kind))
            df = df if least is None else df.where(c >= F.lit(least[0]).cast(kind))
        return df

    def keys(self, rows: DataFrame) -> list[Key]:
        return [tuple(r) for r in rows.select(*(b.name for b in self.by)).collect()]


@dataclass(frozen=True)
class Place:
    """The key of the row at a place, how many rows come before the first of that key, and how many have it."""

    key: Key
    before: int
    equal: int


def locate(order: Order, place: int, total: int, small: int = 50_000, fan: int = 512) -> Place:
    """The row at ``place`` (from 0, below ``total``)."""
    return locate_all(order, [place], total, small, fan)[place]


def locate_all(order: Order, places: list[int], total: int, small: int = 50_000, fan: int = 512) -> dict[int, Place]:
    """The rows at some places, found together as long as one range holds them.

    A round is two passes over a range: a sample of some 128 * ``fan`` rows, which one task sorts, and a count of the
    rows between at most seven of them. Four lie about where the sample has the first and last wanted place, so that
    a round leaves about a hundredth of the rows; three divide the sample evenly, so that the range shrinks whatever
    the sample is worth. A row meets few bounds, as many make a method that the JVM compiles late or not at all.
    """
    found: dict[int, Place] = {}
    ranges = [(None, None, 0, total, sorted(set(places)))]
    while ranges:
        low, high, base, n, wanted = ranges.pop()
        rows = order.rows(low, high)
        if n <= small:
            found |= _few(order, rows, base, wanted)
            continue
        bounds = _bounds(order, rows, base, n, wanted, 128 * fan)
        counts = dict(rows.select(_range_of(order, bounds, 0, len(bounds)).alias("range")).groupBy("range").count().collect())
        start = base
        for i in range(2 * len(bounds) + 1):
            end = start + counts.get(i, 0)
            here = [p for p in wanted if start <= p < end]
            if i % 2:
                found |= {p: Place(bounds[i // 2], start, end - start) for p in here}
            elif here:
                ranges.append((bounds[i // 2 - 1] if i else low, bounds[i // 2] if i // 2 < len(bounds) else high, start, end - start, here))
            start = end
    return found


def _few(order: Order, rows: DataFrame, base: int, wanted: list[int]) -> dict[int, Place]:
    """Places among rows that are few enough for one task."""
    names = [b.name for b in order.by]
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*order.columns()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__before", before + base)
    meets = [(F.col("__before") <= p) & (F.col("__before") + F.col("__n") > p) for p in wanted]
    found = placed.where(reduce(or_, meets)).select(*names, "__before", "__n").collect()
    return {p: Place(tuple(r)[:-2], r[-2], r[-1]) for r in found for p in wanted if r[-2] <= p < r[-2] + r[-1]}


def _bounds(order: Order, rows: DataFrame, base: int, n: int, wanted: list[int], size: int) -> list[Key]:
    """Keys of a sample of ``size`` of the range's ``n`` rows, in order: some evenly, others about the wanted places."""
    # Chosen by a hash of place and row, so that rows chosen before don't decide; repeated rows come together.
    share = min(1.0, size / n)
    chosen = F.pmod(F.xxhash64("__hash", F.lit(base), F.lit(n)), F.lit(1 << 30)) < int(share * (1 << 30))
    names = [b.name for b in order.by]
    sample = rows.where(chosen).groupBy(*names).agg(F.count("*").alias("__n"))
    so_far = Window.orderBy(*order.columns()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = sample.withColumns({"__end": F.sum("__n").over(so_far), "__m": F.sum("__n").over(Window.partitionBy())})
    m = F.col("__m")
    asked = [m * (i / 4) for i in (1, 2, 3)]
    for p in {min(wanted), max(wanted)}:
        part = (p - base + 0.5) / n
        # Four standard deviations of the sample's count before the place, to each side; none if all rows are in it.
        reach = 4 * F.sqrt(m * (part * (1 - part) * (1 - share))) + int(share < 1)
        asked += [m * part - reach, m * part + reach]
    at = [F.greatest(F.lit(0.0), F.least(x, m - 0.5)) for x in asked]
    holds = [(F.col("__end") - F.col("__n") <= x) & (x < F.col("__end")) for x in at]
    found = sample.where(reduce(or_, holds)).select("__end", *names).collect()
    # None was chosen, as where most rows are alike: any key divides them.
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: r[0])] or order.keys(rows.select(*names).limit(1))


def _range_of(order: Order, bounds: list[Key], low: int, high: int) -> Column:
    """2 * i + 1 for rows of the i-th bound's key, 2 * i for those between it and the bound before; by halving."""
    if low == high:
        return F.lit(2 * low)
    at = (low + high) // 2
    key = bounds[at]
    return F.when(order.before(key), _range_of(order, bounds, low, at)).when(order.equal(key), F.lit(2 * at + 1)).otherwise(_range_of(order, bounds, at + 1, high))


def page(df: DataFrame, by: list[By], start: int, count: int, total: int | None = None, small: int = 50_000, fan: int = 512) -> DataFrame:
    """Rows ``start`` to ``start + count - 1`` in order; the rows that don't belong to it are never sorted.

    Rows that are equal in the order's columns come by a hash of the row: the pages of a table that doesn't change
    don't overlap. Rows alike in all columns are as good as each other, and as many as belong to the page are in it.
    """
    total = df.count() if total is None else total
    end = min(start + count, total)
    if start >= end:
        return df.limit(0)
    order = Order(df, by)
    places = locate_all(order, [start, end - 1], total, small, fan)
    first, last = places[start], places[end - 1]
    if first.key == last.key:
        rows = _some(order, first, end - start)
    elif first.before == start and last.before + last.equal == end:
        rows = order.rows(first.key, last.key, closed=True)
    else:
        rows = order.rows(first.key, last.key)
        rows = rows.unionByName(_some(order, first, first.before + first.equal - start)).unionByName(_some(order, last, end - last.before))
    # A small page is one partition: a sort of several reads all rows once more, to divide them.
    rows = rows.repartition(1).sortWithinPartitions(*order.columns()) if end - start <= small else rows.orderBy(*order.columns())
    return rows.select(*(F.col(f"`{c}`") for c in df.columns))


def _some(order: Order, place: Place, n: int) -> DataFrame:
    rows = order.df.where(order.equal(place.key))
    return rows if n >= place.equal else rows.limit(n)
