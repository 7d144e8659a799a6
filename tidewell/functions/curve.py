"""A space-filling curve over latitude and longitude: Morton keys, and boxes as ranges of keys.

A key interleaves the bits of a place's column and row on a grid, so that places near each other mostly have keys near
each other. A box is cut into quarters as far as it pays: a quarter inside the box is one range of keys, one at its
border is cut again, or taken whole once there are enough ranges. So ranges hold the box, and an exact filter follows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns and rows of the grid: 2 ** LEVELS each; half a kilometre at the equator.
LEVELS = 16
#: Shifts and masks that spread the low 16 bits of a number to its even places.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))

Box = tuple[float, float, float, float]


def _step(at: Column, low: float, span: float) -> Column:
    """The grid's column or row of a coordinate; those outside the world belong to its border."""
    n = 1 << LEVELS
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((at - low) / span * n))).cast("long")


def _spread(x: Column) -> Column:
    for by, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def key_of(lat: Column, lon: Column) -> Column:
    """The Morton key of a place; null if a coordinate is."""
    return _spread(_step(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_step(lat, -90.0, 180.0)), 1))


def _cell(at: float, low: float, span: float) -> int:
    n = 1 << LEVELS
    return max(0, min(n - 1, int((at - low) / span * n // 1)))


def box_ranges(box: Box, limit: int = 24) -> list[tuple[int, int]]:
    """Ranges of keys, ends included, that hold all places in (lat_min, lat_max, lon_min, lon_max); about ``limit``."""
    lat_min, lat_max, lon_min, lon_max = box
    if lat_min > lat_max or lon_min > lon_max:
        return []
    x0, x1 = _cell(lon_min, -180.0, 360.0), _cell(lon_max, -180.0, 360.0)
    y0, y1 = _cell(lat_min, -90.0, 180.0), _cell(lat_max, -90.0, 180.0)
    whole, open_ = [], [(-LEVELS, 0, 0, 0)]  # (-level, column, row, first key), the widest first
    while open_ and len(whole) + len(open_) < limit:
        level, x, y, key = heapq.heappop(open_)
        side = 1 << -level
        if x0 <= x and x + side - 1 <= x1 and y0 <= y and y + side - 1 <= y1:
            whole.append((key, key + side * side - 1))
            continue
        half = side // 2
        for i in range(4):
            qx, qy = x + (i & 1) * half, y + (i >> 1) * half
            if qx <= x1 and qx + half - 1 >= x0 and qy <= y1 and qy + half - 1 >= y0:
                heapq.heappush(open_, (level + 1, qx, qy, key + i * half * half))
    whole += [(key, key + (1 << -level) ** 2 - 1) for level, _, _, key in open_]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(whole):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged
