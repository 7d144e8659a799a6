"""Reads with everything nested, flattened again to be held against SQL; users; logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import job_name
from ..operators import shapes
from ..operators.nest import attach_parent
from ..operators.security import Principal, find_one, roles_of_token
from ..sources.objects import file_outputs
from ..sources.snapshots import directory_users, job_states, list_users, users_page, users_range
from .registry import Registry, submissions, table
from .spec import CRUD, SUBMISSIONS, ListSpec, Resource, list_rows

REGISTRY = Registry()
ADMIN = Principal(0, ("admin",))


def _transects(spark, sf_dir) -> DataFrame:
    """Nations as transects, with a line as GeoJSON."""
    line = F.format_string('{"type": "LineString", "coordinates": [[%d, 2], [3, %d]]}', "n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), line.alias("geom"))


def _links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("input_object_id"), F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("processing_order")
    )


def _statuses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("submission_id"),
        F.col("event_type").alias("status"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("kubernetes_pod_name"),
        F.col("props").alias("logs"),
        F.col("ts").alias("last_updated"),
    )


@REGISTRY.add("""
WITH t AS (SELECT * FROM nation ORDER BY n_name DESC, n_nationkey LIMIT 6),
  i AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS first FROM supplier GROUP BY 1),
  r AS (SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1)
SELECT n_nationkey::BIGINT AS id, n_name AS name, n_nationkey::DOUBLE AS longitude_start, 2::DOUBLE AS latitude_start, 3::DOUBLE AS longitude_end,
  n_regionkey::DOUBLE AS latitude_end, coalesce(i.n, 0) AS n_inputs, i.first AS first_input, c_custkey AS submission_id, c_name AS submission_name,
  coalesce(r.n, 0) AS n_statuses, r.first AS first_status
FROM t LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN i ON s_nationkey = n_nationkey LEFT JOIN r ON user_id = c_custkey
""")
def Q63_transect_read(spark, sf_dir):
    page = list_rows(Resource("transects", _transects(spark, sf_dir)), ListSpec.parse(None, '["name", "DESC"]', "[0, 6]"), ADMIN, CRUD)
    inputs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("transect_id"))
    own = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("timestamp").alias("time_added_utc"), F.col("c_nationkey").cast("long").alias("transect_id")
    )
    read = shapes.transect_read(page, inputs, own, _statuses(spark, sf_dir))
    flat = read.withColumn("s", F.explode_outer("submissions"))
    places = [f"{x}itude_{y}" for x in ("lat", "long") for y in ("start", "end")]
    return flat.select(
        "id", "name", *places,
        F.size("inputs").cast("long").alias("n_inputs"), F.get("inputs", F.lit(0))["id"].alias("first_input"),
        F.col("s.id").alias("submission_id"), F.col("s.name").alias("submission_name"),
        F.coalesce(F.size("s.run_status"), F.lit(0)).cast("long").alias("n_statuses"), F.get("s.run_status", F.lit(0))["id"].alias("first_status"),
    )


@REGISTRY.add("""
WITH p AS (SELECT *, p_size % 30 AS t FROM part WHERE p_name LIKE '%blue%' ORDER BY p_partkey LIMIT 40)
SELECT p_partkey AS id, p_name AS filename, n_name AS transect, l_orderkey AS submission_id, l_linenumber AS processing_order
FROM p LEFT JOIN nation ON n_nationkey = t LEFT JOIN lineitem ON l_partkey = p_partkey
""")
def Q64_input_read(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"), (F.col("p_size") % 30).cast("long").alias("transect_id"))
    page = list_rows(Resource("inputs", parts), ListSpec.parse('{"filename": "blue"}', None, "[0, 40]"), ADMIN, CRUD)
    read = shapes.input_read(page, _links(spark, sf_dir), shapes.with_line(_transects(spark, sf_dir)))
    flat = read.withColumn("a", F.explode_outer("input_associations"))
    return flat.select("id", "filename", F.col("transect.name").alias("transect"), "a.submission_id", "a.processing_order")


@REGISTRY.add("""
WITH s AS (SELECT * FROM orders WHERE o_custkey = 7 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10),
  l AS (SELECT l_orderkey, string_agg(concat(l_linenumber, ':', coalesce(p_name, '')), ',' ORDER BY l_linenumber, l_partkey) AS inputs
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1),
  r AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), d AS (SELECT doc_id, concat(source, '.json') AS file, n_chars FROM documents)
SELECT o_orderkey AS id, o_totalprice AS total, inputs, coalesce(r.n, 0) AS n_statuses, file AS output, n_chars AS output_bytes, n_name AS transect
FROM s LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN r ON user_id = o_orderkey LEFT JOIN d ON doc_id = o_orderkey LEFT JOIN nation ON n_nationkey = o_orderkey % 30
""")
def Q65_submission_read(spark, sf_dir):
    own = submissions(spark, sf_dir).withColumn("transect_id", F.col("id") % 30)
    page = list_rows(Resource("submissions", own), ListSpec.parse(None, '["total", "DESC"]', "[0, 9]"), Principal(7, ("user",)), SUBMISSIONS)
    outputs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("submission_id"), F.concat("source", F.lit(".json")).alias("filename"), F.col("n_chars").alias("size_bytes")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"))
    read = shapes.submission_read(page, _statuses(spark, sf_dir), _links(spark, sf_dir), parts, _transects(spark, sf_dir), outputs)
    named = F.transform("input_associations", lambda a: F.concat(a["processing_order"].cast("string"), F.lit(":"), F.coalesce(a["input_object"]["filename"], F.lit(""))))
    first = F.get("file_outputs", F.lit(0))
    return read.select(
        "id", "total", F.when(F.size(named) > 0, F.array_join(named, ",")).alias("inputs"), F.size("run_status").cast("long").alias("n_statuses"),
        first["filename"].alias("output"), first["size_bytes"].alias("output_bytes"), F.col("transect.name").alias("transect"),
    )


@REGISTRY.add("""
SELECT l_orderkey AS submission_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS input_object_ids FROM lineitem GROUP BY 1
""")
def Q66_ordered_inputs(spark, sf_dir):
    found = shapes.ordered_inputs(_links(spark, sf_dir))
    return found.withColumn("input_object_ids", F.array_join(F.col("input_object_ids").cast("array<string>"), ","))


def _users(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers as users; those of two market segments have a role."""
    customers = table(spark, sf_dir, "customer")
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user")
    members = customers.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("id"), role.alias("role"))
    return customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username")), members


@REGISTRY.add("""
SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_name, c_custkey LIMIT 10 OFFSET 10
""")
def Q67_users_page(spark, sf_dir):
    return users_page(*_users(spark, sf_dir), ListSpec.parse('{"users_only": true}', None, "[10, 19]"))


@REGISTRY.add("SELECT concat('users 10-19/', count(*)) AS content_range FROM customer WHERE lower(c_name) LIKE '%00001%'")
def Q68_users_range(spark, sf_dir):
    return users_range(*_users(spark, sf_dir), ListSpec.parse('{"username": "00001"}', None, "[10, 19]"))


@REGISTRY.add("SELECT c_custkey AS id, c_name AS name, c_custkey AS owner FROM customer WHERE c_custkey = 7")
def Q69_own_row(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("owner"))
    user = Principal(7, ("user",))
    return find_one(own, user, "id", 7).unionByName(find_one(own, user, "id", 8))


@REGISTRY.add("""
SELECT 'job-7' AS kubernetes_pod_name, props AS logs FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1
""")
def Q70_log_by_pod(spark, sf_dir):
    return shapes.job_log(_statuses(spark, sf_dir), "job-7")


@REGISTRY.add("""
WITH o AS (SELECT o_orderkey::VARCHAR AS id, o_custkey AS owner, o_orderpriority AS name FROM orders)
SELECT id, owner, name FROM o WHERE id = '77' UNION ALL SELECT id, owner, name FROM o WHERE id IN ('5', '77', '78') AND name LIKE '%H%'
""")
def Q85_inferred_exact_fields(spark, sf_dir):
    """An id that the schema marks as one matches whole, alone and in a list; other texts match in part."""
    orders = submissions(spark, sf_dir).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "owner", "name")
    resource = Resource("submissions", orders.withMetadata("id", {"uuid": True}))
    one = list_rows(resource, ListSpec.parse('{"id": "77"}'), ADMIN, CRUD)
    return one.unionByName(list_rows(resource, ListSpec.parse('{"id": ["5", "77", "78"], "name": "H"}'), ADMIN, CRUD))


@REGISTRY.add("""
SELECT c_custkey AS id, c_name AS username, CASE WHEN c_nationkey % 3 = 0 THEN 'DEFAULT' ELSE upper(c_mktsegment) END AS login_method,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment = 'BUILDING' END AS is_admin,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN true END AS is_user FROM customer
""")
def Q86_directory_users(spark, sf_dir):
    """Users with how they log in and what they may; without a role both are unknown."""
    users, members = _users(spark, sf_dir)
    more = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("method"), "c_nationkey")
    attributes = F.when(F.col("c_nationkey") % 3 != 0, F.create_map(F.lit("login-method"), F.array("method")))
    found = directory_users(users.join(more, "id").select("id", "username", attributes.alias("attributes")), members)
    return found.select("id", "username", "login_method", "is_admin", "is_user")


@REGISTRY.add("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(lower(c_mktsegment), CASE WHEN c_nationkey = 7 THEN ',admin' ELSE '' END) END AS realm_roles,
  CASE WHEN c_custkey % 5 = 0 THEN 'viewer' ELSE '' END AS client_roles, c_custkey % 3 <> 0 AND c_nationkey = 7 AS is_admin FROM customer
""")
def Q87_token_roles(spark, sf_dir):
    """Roles out of token payloads, empty where a payload has none."""
    segment, admin = F.lower("c_mktsegment"), F.when(F.col("c_nationkey") == 7, F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>"))
    payload = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 != 0, F.struct(F.concat(F.array(segment), admin).alias("roles"))).alias("realm_access"),
        F.when(F.col("c_custkey") % 5 == 0, F.struct(F.array(F.lit("viewer")).alias("roles"))).alias("client_access"),
    )
    shown = roles_of_token(payload)
    return shown.select("id", F.array_join("realm_roles", ",").alias("realm_roles"), F.array_join("client_roles", ",").alias("client_roles"), "is_admin")


@REGISTRY.add("""
SELECT l_partkey AS input_object_id, l_orderkey AS submission_id, l_linenumber AS processing_order, o_orderstatus AS status, o_custkey AS owner
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) ON l_orderkey = o_orderkey
""")
def Q88_links_with_submissions(spark, sf_dir):
    """Each link with its submission, where that is there."""
    there = submissions(spark, sf_dir).where("id % 10 <> 0")
    linked = attach_parent(_links(spark, sf_dir), there, "submission_id", "id", "submission")
    return linked.select("input_object_id", "submission_id", "processing_order", F.col("submission.status").alias("status"), F.col("submission.owner").alias("owner"))


@REGISTRY.add("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_custkey IN (3, 8, 41, 99999999)")
def Q89_users_by_ids(spark, sf_dir):
    return list_users(*_users(spark, sf_dir), {"id": [3, 8, 41, 99_999_999]})


@REGISTRY.add("SELECT o_orderkey AS id, concat('job-', o_orderkey) AS stem, 5::INT AS digits FROM orders")
def Q90_job_names(spark, sf_dir):
    """Names of jobs: what stays of them without their random digits, and how many these are."""
    named = submissions(spark, sf_dir).select("id", job_name("job", F.col("id").cast("string"), seed=1).alias("name"))
    return named.select("id", F.regexp_replace("name", r"-\d+$", "").alias("stem"), F.length(F.regexp_extract("name", r"-(\d+)$", 1)).alias("digits"))


@REGISTRY.add("""
SELECT concat(doc_id, '.json') AS filename, n_chars AS size_bytes, concat('https://store/files/', lang, '/', doc_id, '.json') AS url
FROM documents WHERE lang = 'en'
""")
def Q91_file_outputs(spark, sf_dir):
    """A listing's objects as a submission's outputs."""
    documents = table(spark, sf_dir, "documents").where("lang = 'en'")
    key = F.concat(F.lit("p/outputs/en/"), F.col("doc_id").cast("string"), F.lit(".json"))
    listing = documents.select(key.alias("key"), F.col("n_chars").alias("size"), F.lit(None).cast("timestamp").alias("last_modified"))
    return file_outputs(listing, "https://store/files", "en").drop("last_modified")


@REGISTRY.add("""
SELECT concat('job-', user_id, '-0-', event_id) AS job_id, upper(event_type[1:1]) || event_type[2:] AS status, ts::VARCHAR AS time_started FROM events
""")
def Q92_job_states(spark, sf_dir):
    """Events as pods of a cluster, as the states of their jobs."""
    events = table(spark, sf_dir, "events")
    name = F.concat_ws("-", F.lit("job"), F.col("user_id").cast("string"), F.lit("0"), F.col("event_id").cast("string"))
    return job_states(events.select(name.alias("name"), F.initcap("event_type").alias("phase"), F.col("ts").cast("string").alias("start_time")))
