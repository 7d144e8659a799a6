import datetime as dt
import struct

from pyspark.sql import functions as F

from tidewell.functions import geo, text, values

UUID = "0123abcd-0123-4567-89ab-0123456789ab"


def of(spark, value, kind, *functions):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return tuple(df.select(*(f(F.col("x")) for f in functions)).first())


def test_text(spark):
    one = lambda v, f: of(spark, v, "string", f)[0]
    assert [one(v, text.basename) for v in ("a/b/c.txt", "c", "a/", None)] == ["c.txt", "c", "", None]
    assert [one(v, text.strip_pod_suffix) for v in ("a-b-c-d", "a-b", "a", "")] == ["a-b", "", "", ""]
    assert one(f"job-{UUID}-12345", text.submission_id_of) == UUID and one("job-1", text.submission_id_of) == ""
    assert [one(v, text.object_id_of) for v in ("inputs/abc+1+2", "p/inputs/abc", "abc")] == ["abc", "abc", None]
    assert one('"etag"', text.without_quotes) == "etag"
    assert one("10%\r50%\rdone\nnext\r", text.clean_log) == "done\n"
    assert one("Bearer abc", text.bearer_token) == "abc" and one("abc", text.bearer_token) is None
    assert [one(v, text.is_uuid) for v in (UUID, UUID.upper(), "x" + UUID, None)] == [True, True, False, False]
    assert one("a.MP4", lambda c: text.allowed_file(c, ("mp4", "mov"))) and not one("a.exe", lambda c: text.allowed_file(c, ("mp4",)))
    assert one("k", lambda c: text.object_key("https://s", c, "f")) == "https://s/k/f"
    assert one(UUID, lambda c: text.job_name("job", c, 1)).startswith(f"job-{UUID}-")
    methods = [{"login-method": ["google", "x"]}, {"login-method": []}, {}, None]
    assert [of(spark, m, "map<string,array<string>>", text.login_method)[0] for m in methods] == ["GOOGLE", "DEFAULT", "DEFAULT", "DEFAULT"]


def test_values(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 0, None), (0, 1, 2)], "n int, s int, e int")
    assert [r[0] for r in df.select(values.time_range(F.col("n"), F.col("s"), F.col("e"))).collect()] == ["None-5", "0-end,begin-None", "1-end,begin-2"]
    progress = spark.createDataFrame([(50, 200), (1, 3), (5, 0), (None, 3)], "o long, s long").select(values.upload_percent(F.col("o"), F.col("s")))
    assert [r[0] for r in progress.collect()][:2] == ["Upload progress: 25.00%", "Upload progress: 33.33%"]
    assert of(spark, 29.97002997, "double", values.rounded_fps, lambda c: values.duration(F.lit(300), c)) == (29.97, 10.01)
    assert of(spark, 0.0, "double", lambda c: values.duration(F.lit(300), c))[0] is None
    assert [of(spark, v, "int", lambda c: values.or_default(c, 15))[0] for v in (None, 0, 3)] == [15, 15, 3]
    assert of(spark, "", "string", values.empty_to_null)[0] is None
    since, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3, 0, 0, 1, 500_000)
    df = spark.createDataFrame([(since, now)], "a timestamp_ntz, b timestamp_ntz")
    seconds = values.elapsed_seconds(F.col("a"), F.col("b"))
    assert tuple(df.select(seconds, values.abandon_notice(seconds)).first()) == (172801.5, "Upload seems abandoned: no data for 172802 seconds")
    assert of(spark, 10, "long", lambda c: values.is_expired(c, F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")))[0]
    assert of(spark, since, "timestamp_ntz", lambda c: values.expiry(c, 6))[0] == dt.datetime(2024, 1, 1, 6)
    assert [of(spark, v, "boolean", lambda c: values.derived_status(F.lit("Running"), c))[0] for v in (True, False, None)] == ["Running", "Deleted", "Deleted"]
    assert [of(spark, v, "double", values.widen_to_int)[0] for v in (0.5, 1.5, -0.6)] == [0, 2, -1]


def test_time_windows(spark):
    cases = [(1, 2, 1, True), (2, 1, 1, False), (2, 2, 1, False), (2, 1, 2, True), (0, 1, 1, True), (5, 0, 1, True), (None, 1, 1, True), (-1, 3, 1, False), (1, -3, 3, False)]
    df = spark.createDataFrame(cases, "s int, e int, n int, fine boolean")
    assert df.where(values.window_is_valid(F.col("s"), F.col("e"), F.col("n")) != F.col("fine")).count() == 0


def test_geometry(spark):
    df = spark.createDataFrame([(1.5, -2.25, 3.0, 4.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    corners = [F.col(c) for c in "abcd"]
    assert [r[0] for r in df.select(geo.line_wkt(*corners, digits=2)).collect()] == ["LINESTRING (-2.25 1.50, 4.00 3.00)", None]
    rows = df.select(geo.line_ends(geo.line_wkb(*corners)).alias("e")).select("e.*").collect()
    assert tuple(rows[0]) == (1.5, -2.25, 3.0, 4.0, 2, '{"type": "LineString", "coordinates": [[-2.25, 1.5], [4.0, 3.0]]}')
    assert tuple(rows[1]) == (None,) * 6
    line = [(0.0, 0.0), (1.0, 5.0), (2.0, 2.0)]
    assert geo.decode_line(geo.encode_line(line)) == geo.decode_line(geo.encode_line(line, None)) == line
    assert geo.decode_line(struct.pack(">BII6d", 0, 2 | 0x80000000, 2, *range(6))) == [(0.0, 1.0), (3.0, 4.0)]
    assert geo.decode_line(b"\x01\x01\x00\x00\x00" + b"\0" * 16) is None and geo.decode_line(b"") is None
    assert geo.decode_line(geo.encode_line(line)[:-1]) is None
    assert [r[0] for r in df.select(geo.in_bounds(F.col("a"), F.col("b") * 100)).collect()][0] is False
