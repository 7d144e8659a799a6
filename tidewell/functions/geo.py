"""Line geometry: well-known text and binary, in longitude-latitude order."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SRID = 4326
_ENDS = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("lat_start", "lon_start", "lat_end", "lon_end")]
    + [T.StructField("n_points", T.IntegerType()), T.StructField("geojson", T.StringType())]
)


def line_wkt(lat_start: Column, lon_start: Column, lat_end: Column, lon_end: Column, digits: int = 16) -> Column:
    """``LINESTRING (lon lat, lon lat)``; null if a coordinate is."""
    number = f"%.{digits}f"
    text = F.format_string(f"LINESTRING ({number} {number}, {number} {number})", lon_start, lat_start, lon_end, lat_end)
    known = lat_start.isNotNull() & lon_start.isNotNull() & lat_end.isNotNull() & lon_end.isNotNull()
    return F.when(known, text)


def in_bounds(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def encode_line(points: list[tuple[float, float]], srid: int | None = SRID) -> bytes:
    """Little-endian (extended) WKB of (lon, lat) points."""
    head = struct.pack("<BII", 1, 2 | 0x20000000, srid) if srid is not None else struct.pack("<BI", 1, 2)
    return head + struct.pack(f"<I{2 * len(points)}d", len(points), *(x for p in points for x in p))


def decode_line(wkb: bytes | None) -> list[tuple[float, float]] | None:
    """The points of a WKB line in either byte order, with or without SRID, Z or M; None for anything else."""
    if not wkb or len(wkb) < 9 or wkb[0] > 1:
        return None
    order = "<" if wkb[0] == 1 else ">"
    kind = struct.unpack_from(f"{order}I", wkb, 1)[0]
    width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
    if kind & 0xFFFF != 2:
        return None
    at = 9 if kind & 0x20000000 else 5
    if len(wkb) < at + 4:
        return None
    n = struct.unpack_from(f"{order}I", wkb, at)[0]
    if len(wkb) < at + 4 + 8 * width * n:
        return None
    flat = struct.unpack_from(f"{order}{width * n}d", wkb, at + 4)
    return [(flat[i], flat[i + 1]) for i in range(0, width * n, width)]


def decode_lines(wkbs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, x, y) of many WKB lines at once: the rows that are lines of a point at least, where the points of
    each begin, then the end; all points' longitudes and latitudes. What ``decode_line`` gives, without a loop."""
    sizes = np.fromiter((len(w) if w else 0 for w in wkbs), np.int64, len(wkbs))
    data = np.frombuffer(b"".join(w for w in wkbs if w) + bytes(16), np.uint8)
    at = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)

    def number(at: np.ndarray, little: np.ndarray, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        taken = data[at[:, None] + np.where(little[:, None], np.arange(width), np.arange(width)[::-1])]
        return np.ascontiguousarray(taken).view(f"<{kind}").ravel()

    row = np.flatnonzero(sizes >= 9)
    row = row[data[at[row]] <= 1]
    little = data[at[row]] == 1
    kind = number(at[row] + 1, little, "u4")
    head = np.where(kind & 0x20000000, 9, 5)
    fine = ((kind & 0xFFFF) == 2) & (sizes[row] >= head + 4)
    row, little, kind, head = row[fine], little[fine], kind[fine], head[fine]
    width = 2 + (kind >> 31).astype(np.int64) + (kind >> 30 & 1)
    n = number(at[row] + head, little, "u4").astype(np.int64)
    fine = (n > 0) & (sizes[row] >= head + 4 + 8 * width * n)
    row, little, head, width, n = row[fine], little[fine], head[fine], width[fine], n[fine]
    first = np.r_[0, np.cumsum(n)].astype(np.int64)
    of = np.repeat(np.arange(len(row)), n)
    point = at[row][of] + head[of] + 4 + 8 * width[of] * (np.arange(first[-1]) - first[:-1][of])
    return row, first, number(point, little[of], "f8"), number(point + 8, little[of], "f8")


_BOUNDS = ("lat_min", "lat_max", "lon_min", "lon_max")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _BOUNDS]))
def line_bounds(wkb: pd.Series) -> pd.DataFrame:
    """The least and greatest latitude and longitude of a WKB line, to be kept as columns that scans can skip by;
    nulls for anything else."""
    row, first, x, y = decode_lines(wkb.tolist())
    out = pd.DataFrame(np.nan, index=range(len(wkb)), columns=list(_BOUNDS)).astype("Float64")
    if len(row):
        ends = [f.reduceat(v, first[:-1]) for v, f in ((y, np.minimum), (y, np.maximum), (x, np.minimum), (x, np.maximum))]
        out.iloc[row] = np.column_stack(ends)
    return out


@F.pandas_udf(T.BinaryType())
def line_wkb(lat_start: pd.Series, lon_start: pd.Series, lat_end: pd.Series, lon_end: pd.Series) -> pd.Series:
    """A two-point line; null if a coordinate is."""
    rows = zip(lat_start, lon_start, lat_end, lon_end, strict=True)
    return pd.Series([None if any(pd.isna(x) for x in r) else encode_line([(r[1], r[0]), (r[3], r[2])]) for r in rows], dtype=object)


@F.pandas_udf(_ENDS)
def line_ends(wkb: pd.Series) -> pd.DataFrame:
    """First and last point, number of points and GeoJSON of a WKB line; nulls for anything else."""
    row, first, x, y = decode_lines(wkb.tolist())
    out = pd.DataFrame({c: pd.array([None] * len(wkb), "Float64") for c in ("lat_start", "lon_start", "lat_end", "lon_end")})
    points, texts = pd.array([None] * len(wkb), "Int32"), np.full(len(wkb), None, object)
    if len(row):
        start, end = first[:-1], first[1:] - 1
        for name, values in (("lat_start", y[start]), ("lon_start", x[start]), ("lat_end", y[end]), ("lon_end", x[end])):
            out.iloc[row, out.columns.get_loc(name)] = values
        points[row] = np.diff(first).astype(np.int32)
        pairs = [f"[{a!r}, {b!r}]" for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        cut = first.tolist()
        texts[row] = [f'{{"type": "LineString", "coordinates": [{", ".join(pairs[i:j])}]}}' for i, j in zip(cut, cut[1:], strict=False)]
    out["n_points"], out["geojson"] = points, texts
    return out
