import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import curve, geo
from tidewell.operators import spatial


def morton(lat, lon):
    n = 1 << curve.LEVELS
    x, y = (max(0, min(n - 1, int((v - low) / span * n // 1))) for v, low, span in ((lon, -180, 360), (lat, -90, 180)))
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(curve.LEVELS))


def boxes(rnd, n):
    for _ in range(n):
        lat, lon = rnd.uniform(-95, 90), rnd.uniform(-190, 180)
        yield lat, lat + rnd.choice([0, 0.01, 1, 30, 200]), lon, lon + rnd.choice([0, 0.01, 1, 50, 400])


def test_keys_and_ranges(spark):
    rnd = random.Random(2)
    places = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(400)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (-91.0, 999.0)]
    rows = spark.createDataFrame(places, "lat double, lon double").select(curve.key_of(F.col("lat"), F.col("lon"))).collect()
    assert [r[0] for r in rows] == [morton(*p) for p in places]
    for limit in (1, 6, 24, 200):
        for box in boxes(rnd, 60):
            ranges = curve.box_ranges(box, limit)
            assert len(ranges) <= limit + 3 and all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
            inside = [p for p in places if box[0] <= p[0] <= box[1] and box[2] <= p[1] <= box[3]]
            assert all(any(a <= morton(*p) <= b for a, b in ranges) for p in inside)
    assert curve.box_ranges((1.0, 0.0, 0.0, 1.0)) == [] and curve.box_ranges((-90.0, 90.0, -180.0, 180.0)) == [(0, 2 ** (2 * curve.LEVELS) - 1)]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        lat, lon, size = rnd.uniform(-90, 90), rnd.uniform(-180, 180), rnd.choice([0, 0.001, 0.1, 2, 90] if i % 50 == 0 else [0.001, 0.1])
        rows.append((i, geo.encode_line([(lon + rnd.uniform(-size, size), lat + rnd.uniform(-size, size)) for _ in range(rnd.randint(1, 5))])))
    rows += [(3000, None), (3001, b"no line")]
    path = str(tmp_path_factory.mktemp("lines")) + "/t"
    spatial.replace_lines(spatial.with_curve(spark.createDataFrame(rows, "id long, geom binary")), path, 32)
    return path, rows


def test_boxes_against_all_lines(spark, lines):
    path, rows = lines
    df = spark.read.parquet(path)
    points = {i: geo.decode_line(g) for i, g in rows}
    for box in [*boxes(random.Random(7), 12), (-90.0, 90.0, -180.0, 180.0), (5.0, 4.0, 0.0, 1.0)]:
        lat_min, lat_max, lon_min, lon_max = box
        meets = lambda ps: ps and max(y for _, y in ps) >= lat_min and min(y for _, y in ps) <= lat_max and max(x for x, _ in ps) >= lon_min and min(x for x, _ in ps) <= lon_max  # noqa: B023, E731
        expected = sorted(i for i, ps in points.items() if meets(ps)) if lat_min <= lat_max else []
        assert sorted(r.id for r in spatial.lines_in_box(df, box).collect()) == expected


def test_few_row_groups_are_read(spark, lines):
    path, _ = lines
    found = spatial.lines_in_box(spark.read.parquet(path), (10.0, 14.0, 20.0, 28.0))
    from_files = {r.path for r in found.select(F.col("_metadata.file_path").alias("path")).collect()}
    assert len(from_files) <= 12
    rows = found.count()
    read = [m for m in _scans(found) if m is not None]
    assert read and rows <= read[0] < 900  # of 3,002


def _scans(df):
    """Rows that the scan put out, after row groups were skipped."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    todo, out = [execution.executedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Scan parquet" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
    return out


def test_many_lines_at_once_as_one_by_one():
    rnd = random.Random(9)
    line = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(4)]
    cases = [None, b"", b"\x01", geo.encode_line(line), geo.encode_line(line, None), geo.encode_line(line)[:-1], geo.encode_line([]), geo.encode_line(line[:1]), b"\x02" + geo.encode_line(line)[1:]]
    for flags in (0, 0x80000000, 0x40000000, 0xC0000000, 0x20000000, 0xE0000000):
        for order in "<>":
            width = 2 + bool(flags & 0x80000000) + bool(flags & 0x40000000)
            head = struct.pack(f"{order}BI", order == "<", 2 | flags) + (struct.pack(f"{order}I", 4326) if flags & 0x20000000 else b"")
            cases.append(head + struct.pack(f"{order}I{3 * width}d", 3, *(rnd.random() for _ in range(3 * width))))
    cases += [struct.pack("<BI", 1, 1) + b"\0" * 30, struct.pack("<BII", 1, 2, 4_000_000_000) + b"\0" * 64]
    rnd.shuffle(cases)
    row, first, x, y = geo.decode_lines(cases)
    found = {int(r): list(zip(x[i:j].tolist(), y[i:j].tolist(), strict=True)) for r, i, j in zip(row, first, first[1:], strict=False)}
    assert found == {i: p for i, p in enumerate(map(geo.decode_line, cases)) if p}
    assert geo.decode_lines([])[0].tolist() == [] and np.array_equal(geo.decode_lines([None])[1], [0])
