"""Lines laid out along a space-filling curve, and searched by box.

A line's place on the curve is its bounds' middle. As lines differ in length, each has a reach: the power of two of
degrees, from 2**-10 on, that its half extents don't exceed. A table is clustered by reach, then key. A box query
asks for each reach for the middles in the box widened by it: a few ranges of keys, which the scan holds against
the statistics of files and row groups. The bounds decide exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curve import Box, box_ranges, key_of
from ..functions.geo import line_bounds
from ..sources.tables import replace_table

BOUNDS = ("lat_min", "lat_max", "lon_min", "lon_max")
#: Reaches, as powers of two of degrees: a half extent of the whole world is within the last.
FIRST, LAST = -10, 8


def with_curve(df: DataFrame, geom: str | None = "geom") -> DataFrame:
    """Adds the bounds of a line (of well-known binary; or, without ``geom``, as the table has them), curve_reach and
    curve_key; all are null for what isn't a line."""
    if geom is not None:
        df = df.withColumn("__b", line_bounds(geom)).withColumns({c: F.col(f"__b.{c}") for c in BOUNDS}).drop("__b")
    half = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min")) / 2
    reach = F.greatest(F.lit(FIRST), F.least(F.lit(LAST), F.ceil(F.log2(half))))
    reach = F.when(half > 0, reach).when(half == 0, F.lit(FIRST)).cast("int")
    middle = lambda low, high: (F.col(low) + F.col(high)) / 2
    return df.withColumns({"curve_reach": reach, "curve_key": key_of(middle("lat_min", "lat_max"), middle("lon_min", "lon_max"))})


def replace_lines(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes lines, with ``with_curve``'s columns, clustered for ``lines_in_box``."""
    replace_table(df, path, ["curve_reach", "curve_key"], partitions)


def lines_in_box(df: DataFrame, box: Box, limit: int = 24) -> DataFrame:
    """Lines whose bounds meet the box (lat_min, lat_max, lon_min, lon_max), borders included."""
    lat_min, lat_max, lon_min, lon_max = box
    if lat_min > lat_max or lon_min > lon_max:
        return df.limit(0)
    asked = []
    for reach in range(FIRST, LAST + 1):
        by = 2.0**reach
        ranges = box_ranges((lat_min - by, lat_max + by, lon_min - by, lon_max + by), limit)
        asked.append((F.col("curve_reach") == reach) & _any([F.col("curve_key").between(*r) for r in ranges]))
    meets = (F.col("lat_max") >= lat_min) & (F.col("lat_min") <= lat_max) & (F.col("lon_max") >= lon_min) & (F.col("lon_min") <= lon_max)
    return df.where(_any(asked) & meets)


def _any(conditions: list[Column]) -> Column:
    """Whether one of them holds, as a tree without deep branches."""
    half = len(conditions) // 2
    return conditions[0] if not half else _any(conditions[:half]) | _any(conditions[half:])
