"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, values
from ..operators.mutate import change_type, move_column, rename_columns, replace_column
from ..operators.security import has_any_role
from ..operators import spatial
from ..session import shared_folder
from .registry import NOW, Registry, table

REGISTRY = Registry()


@REGISTRY.add("SELECT page_id, string_split(url, '/')[-1] AS filename FROM pages")
def Q31_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("filename"))


@REGISTRY.add("""
SELECT c_custkey AS id, c_name AS job, CASE WHEN len(string_split(c_name, '-')) > 2
  THEN array_to_string(string_split(c_name, '-')[:-3], '-') ELSE '' END AS bare FROM customer
""")
def Q32_strip_suffix(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    name = F.concat(F.col("c_name"), F.lit("-0-0"))
    both = customers.select(F.col("c_custkey").alias("id"), text.strip_pod_suffix(name).alias("job"), text.strip_pod_suffix(F.col("c_name")).alias("bare"))
    return both


@REGISTRY.add("""
WITH k AS (SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR) AS h FROM orders)
SELECT id, concat(h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32]) AS submission_id, id::VARCHAR AS object_id FROM k
""")
def Q33_extract_id(spark, sf_dir):
    h = F.md5(F.col("o_orderkey").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("job-"), uuid, F.lit("-12345")).alias("job"),
        F.concat(F.lit("inputs/"), F.col("o_orderkey").cast("string"), F.lit("+x+y")).alias("upload"),
    )
    return rows.select("id", text.submission_id_of(F.col("job")).alias("submission_id"), text.object_id_of(F.col("upload")).alias("object_id"))


@REGISTRY.add("""
SELECT conv_id, turn, array_to_string(list_transform(string_split(replace(text, ' ', chr(13)), chr(10)), lambda x: string_split(x, chr(13))[-1]), chr(10)) AS log
FROM conversations
""")
def Q34_log_clean(spark, sf_dir):
    log = F.translate("text", " ", "\r")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_log(log).alias("log"))


@REGISTRY.add("SELECT doc_id, upper(coalesce(nullif(lang, 'en'), 'default')) AS method FROM documents")
def Q35_upper_default(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.upper_or(F.nullif("lang", F.lit("en")), "default").alias("method"))


@REGISTRY.add("""
WITH n AS (SELECT l_orderkey AS id, count(*) AS n, nullif(min(l_linenumber), 2) AS s, max(l_quantity)::INT AS e FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN n = 1 THEN concat(coalesce(s::VARCHAR, 'None'), '-', coalesce(e::VARCHAR, 'None'))
  ELSE concat(coalesce(s::VARCHAR, 'None'), '-end,begin-', coalesce(e::VARCHAR, 'None')) END AS time_range FROM n
""")
def Q36_time_range_string(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    found = lines.agg(F.count(F.lit(1)).alias("n"), F.nullif(F.min("l_linenumber"), F.lit(2)).alias("s"), F.max("l_quantity").cast("int").alias("e"))
    return found.select("id", values.time_range(F.col("n"), F.col("s"), F.col("e")).alias("time_range"))


@REGISTRY.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('Upload progress: %.2f%%', l_quantity / 50 * 100) AS message FROM lineitem
""")
def Q37_upload_percent(spark, sf_dir):
    message = values.upload_percent(F.col("l_quantity"), F.lit(50))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", message.alias("message"))


@REGISTRY.add("""
SELECT event_id, ceil(epoch_us(TIMESTAMP '2024-02-01' - ts) / 1000000.0)::BIGINT AS seconds FROM events
""")
def Q38_elapsed_ceil(spark, sf_dir):
    seconds = F.ceil(values.elapsed_seconds(F.col("ts"), F.lit(NOW)))
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"))


@REGISTRY.add("SELECT p_partkey AS id, round_even(p_size / nullif(round_even(p_retailprice, 2), 0), 2) AS seconds, p_retailprice::INT - (p_retailprice::INT > p_retailprice)::INT AS whole FROM part")
def Q39_round_duration(spark, sf_dir):
    seconds = values.duration(F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), seconds.alias("seconds"), F.col("p_retailprice").cast("int").alias("whole"))


@REGISTRY.add("SELECT doc_id, md5(text) AS hash_md5sum FROM documents")
def Q40_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash_md5sum"))


@REGISTRY.add("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def Q41_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@REGISTRY.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN nullif(l_tax, 0.02) IS NULL OR nullif(l_tax, 0.02) = 0 THEN 15 ELSE l_tax END AS fps,
  nullif(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END, '') AS flag FROM lineitem
""")
def Q42_default_falsy(spark, sf_dir):
    fps = values.or_default(F.nullif("l_tax", F.lit(0.02)), float(values.DEFAULT_FPS))
    flag = values.empty_to_null(F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fps.alias("fps"), flag.alias("flag"))


@REGISTRY.add("""
WITH w AS (SELECT event_id, event_id % 5 - 1 AS s, nullif(user_id % 4, 3) AS e, 1 + event_id % 2 AS n FROM events)
SELECT event_id, coalesce(s >= 0, true) AND coalesce(e >= 0, true) AND (coalesce(s, 0) = 0 OR coalesce(e, 0) = 0 OR n >= 2 OR s < e) AS is_valid FROM w
""")
def Q43_window_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 5 - 1 AS s", "nullif(user_id % 4, 3) AS e", "1 + event_id % 2 AS n")
    return rows.select("event_id", values.window_is_valid(F.col("s"), F.col("e"), F.col("n")).alias("is_valid"))


def _corners(spark, sf_dir):
    """The first four components as latitudes and longitudes, in steps of 1/64 degree."""
    at = lambda i, scale: F.rint(F.element_at("embedding", i).cast("double") * scale * 64) / 64
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", at(1, 90).alias("lat_start"), at(2, 180).alias("lon_start"), at(3, 90).alias("lat_end"), at(4, 180).alias("lon_end")
    )


_CORNERS = """
WITH c AS (SELECT vec_id, round_even(embedding[1]::DOUBLE * 90 * 64, 0) / 64 AS lat_start, round_even(embedding[2]::DOUBLE * 180 * 64, 0) / 64 AS lon_start,
  round_even(embedding[3]::DOUBLE * 90 * 64, 0) / 64 AS lat_end, round_even(embedding[4]::DOUBLE * 180 * 64, 0) / 64 AS lon_end FROM embeddings)
"""


@REGISTRY.add(_CORNERS + "SELECT vec_id, printf('LINESTRING (%.6f %.6f, %.6f %.6f)', lon_start, lat_start, lon_end, lat_end) AS wkt FROM c")
def Q44_wkt_build(spark, sf_dir):
    wkt = geo.line_wkt(F.col("lat_start"), F.col("lon_start"), F.col("lat_end"), F.col("lon_end"), digits=6)
    return _corners(spark, sf_dir).select("vec_id", wkt.alias("wkt"))


@REGISTRY.add(_CORNERS + "SELECT vec_id, lat_start, lon_start, lat_end, lon_end FROM c")
def Q45_wkb_decode(spark, sf_dir):
    wkb = geo.line_wkb("lat_start", "lon_start", "lat_end", "lon_end")
    decoded = _corners(spark, sf_dir).select("vec_id", geo.line_ends(wkb).alias("e"))
    return decoded.select("vec_id", "e.lat_start", "e.lon_start", "e.lat_end", "e.lon_end")


@REGISTRY.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice, 0)::INT AS price, l_linenumber::DOUBLE AS line FROM lineitem
""")
def Q55_type_widen(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("line")
    )
    return change_type(change_type(rows, "price", "int"), "line", "double")


@REGISTRY.add("""
SELECT event_id, CASE WHEN event_type <> 'view' THEN user_id::VARCHAR END AS object_id, CASE WHEN event_type <> 'click' THEN event_id::VARCHAR END AS token,
  replace(props, '"', '') AS props, concat('inputs/', user_id, '/', event_type) AS object_key FROM events
""")
def Q71_upload_fields(spark, sf_dir):
    user = F.col("user_id").cast("string")
    upload = F.when(F.col("event_type") != "view", F.concat(F.lit("inputs/"), user, F.lit("+"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("outputs/"), user))
    header = F.concat(F.when(F.col("event_type") != "click", "Bearer ").otherwise("Basic "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.object_id_of(upload).alias("object_id"), text.bearer_token(header).alias("token"), text.without_quotes(F.col("props")).alias("props"),
        text.object_key("inputs", user, F.col("event_type")).alias("object_key"),
    )


@REGISTRY.add("""
SELECT doc_id, doc_id % 4 IN (0, 1) AS allowed FROM documents
""")
def Q72_allowed_files(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, (".MP4", ".avi", ".txt", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.allowed_file(F.concat("source", kind), ("mp4", "avi")).alias("allowed"))


@REGISTRY.add("SELECT event_id, event_id % 3 - 1 < 0 AS expired, 1706745600 + 4 * 3600 AS expires FROM events")
def Q73_token_expiry(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(1_706_745_600))
    expired = values.is_expired(F.lit(1_706_745_600) + F.col("event_id") % 3 - 1, now)
    return table(spark, sf_dir, "events").select("event_id", expired.alias("expired"), F.unix_seconds(values.expiry(now, 4)).cast("int").alias("expires"))


@REGISTRY.add("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_custkey % 4 = 0")
def Q74_has_any_role(spark, sf_dir):
    roles = F.array(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 4 == 0, "admin").otherwise("guest"))
    return table(spark, sf_dir, "customer").where(has_any_role(roles, "admin", "machinery")).select(F.col("c_custkey").alias("id"))


@REGISTRY.add(_CORNERS + """
SELECT vec_id, least(lat_start, lat_end) AS lat_min, greatest(lat_start, lat_end) AS lat_max,
  least(lon_start, lon_end) AS lon_min, greatest(lon_start, lon_end) AS lon_max FROM c
""")
def Q75_line_bounds(spark, sf_dir):
    bounds = geo.line_bounds(geo.line_wkb("lat_start", "lon_start", "lat_end", "lon_end"))
    return _corners(spark, sf_dir).select("vec_id", bounds.alias("b")).select("vec_id", "b.*")


@REGISTRY.add("""
SELECT o_orderkey AS id, o_custkey AS owner, c_mktsegment AS segment, 0::INT AS parts FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def Q76_move_and_replace_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    renamed = rename_columns(orders, {"o_orderkey": "id", "o_custkey": "owner"})
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return move_column(customers, replace_column(renamed, "o_orderstatus", "parts", "int", 0), "segment", "id", "owner")[1]


_LINES = _CORNERS.replace("embedding[3]::DOUBLE * 90", "(embedding[1] + embedding[3] / 8)::DOUBLE * 90").replace("embedding[4]::DOUBLE * 180", "(embedding[2] + embedding[4] / 8)::DOUBLE * 180")


@REGISTRY.add(_LINES + """
SELECT vec_id, lat_start, lon_start, lat_end, lon_end FROM c
WHERE greatest(lat_start, lat_end) >= 2 AND least(lat_start, lat_end) <= 9.5 AND greatest(lon_start, lon_end) >= -20 AND least(lon_start, lon_end) <= 0
""")
def Q82_lines_in_box(spark, sf_dir):
    """Short lines from a table that is laid out along a curve, as far as they meet a box."""
    of = lambda i: F.element_at("embedding", i)
    step = lambda x, scale: F.rint(x.cast("double") * scale * 64) / 64
    ends = {"lat_start": step(of(1), 90), "lon_start": step(of(2), 180), "lat_end": step(of(1) + of(3) / 8, 90), "lon_end": step(of(2) + of(4) / 8, 180)}
    lines = table(spark, sf_dir, "embeddings").select("vec_id", *(v.alias(k) for k, v in ends.items()))
    path = f"{shared_folder(spark)}/lines"
    spatial.replace_lines(spatial.with_curve(lines.withColumn("geom", geo.line_wkb(*ends))), path, 16)
    return spatial.lines_in_box(spark.read.parquet(path), (2.0, 9.5, -20.0, 0.0)).select("vec_id", *ends)


@REGISTRY.add("""
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || concat(source, '/', doc_id)::BLOB) AS h FROM documents)
SELECT doc_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab'), h[18:20], '-', h[21:32]) AS id FROM h
""")
def Q84_name_ids(spark, sf_dir):
    """Name-based ids of documents, by source and number."""
    namespace = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    return table(spark, sf_dir, "documents").select("doc_id", text.name_id(namespace, F.col("source"), F.col("doc_id")).alias("id"))
