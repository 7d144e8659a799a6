"""List requests: filters, orders, pages, counts, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.nest import attach_parent
from ..operators.security import Principal, find_one, masked
from ..session import shared_folder
from ..sources.sketches import like_scan, sketch
from .registry import Registry, inputs, submissions, table
from .spec import CRUD, OBJECTS, SUBMISSIONS, ListSpec, Resource, content_range, count_rows, list_rows, order

REGISTRY = Registry()
OWNER, ADMIN = Principal(7, ("user",)), Principal(0, ("admin",))


def _ranked(resource: Resource, spec: ListSpec, principal: Principal, dialect) -> DataFrame:
    """A page with the rank of its rows, which shows the order."""
    page = list_rows(resource, spec, principal, dialect)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order(page, spec, resource.key))).cast("long"))


def _submissions(spark, sf_dir) -> Resource:
    return Resource("submissions", submissions(spark, sf_dir))


def admin_page(spark, sf_dir) -> DataFrame:
    """A page of all submissions by price, each with its owner's row."""
    spec = ListSpec.parse('{"name": "HIGH"}', '["total", "DESC"]', "[0, 9]")
    page = _ranked(_submissions(spark, sf_dir), spec, ADMIN, SUBMISSIONS)
    return attach_parent(page, table(spark, sf_dir, "customer"), "owner", "c_custkey", "customer")


@REGISTRY.add("""
SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS name, o_orderstatus AS status, o_totalprice AS total,
  o_orderdate AS time_added, row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS rank
FROM orders WHERE o_custkey = 7 AND o_orderpriority LIKE '%HIGH%'
ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10
""")
def Q01_list_owner_like(spark, sf_dir):
    spec = ListSpec.parse('{"name": "HIGH"}', '["total", "DESC"]', "[0, 9]")
    return _ranked(_submissions(spark, sf_dir), spec, OWNER, SUBMISSIONS)


@REGISTRY.add("SELECT count(*) AS total FROM orders WHERE o_custkey = 7 AND o_orderpriority LIKE '%HIGH%'")
def Q02_count_filtered(spark, sf_dir):
    return count_rows(_submissions(spark, sf_dir), ListSpec.parse('{"name": "HIGH"}'), OWNER, SUBMISSIONS)


@REGISTRY.add("""
SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS name, o_orderstatus AS status, o_totalprice AS total,
  o_orderdate AS time_added FROM orders WHERE o_orderkey IN (1, 5, 77, 400, 1200, 999999999)
""")
def Q03_in_list(spark, sf_dir):
    spec = ListSpec.parse('{"id": [1, 5, 77, 400, 1200, 999999999]}')
    return list_rows(_submissions(spark, sf_dir), spec, ADMIN, OBJECTS)


@REGISTRY.add("""
SELECT p_partkey AS id, p_name AS filename, p_type AS kind, p_size AS size FROM part
WHERE p_name LIKE '%blue%' OR p_name LIKE '%g_ar%'
""")
def Q04_or_like(spark, sf_dir):
    resource = Resource("inputs", inputs(spark, sf_dir))
    return list_rows(resource, ListSpec.parse('{"filename": ["blue", "g_ar"]}'), ADMIN, CRUD)


@REGISTRY.add("""
SELECT l_orderkey AS id, l_linenumber AS line, l_linestatus = 'O' AS is_open, l_quantity AS quantity FROM lineitem WHERE l_linestatus = 'O'
""")
def Q05_bool_eq(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_linestatus") == "O").alias("is_open"), F.col("l_quantity").alias("quantity")
    )
    return list_rows(Resource("lines", lines), ListSpec.parse('{"is_open": true}'), ADMIN, OBJECTS)


@REGISTRY.add("SELECT count(*) AS total FROM orders WHERE o_orderkey = 1 AND o_orderkey = 2")
def Q06_and_list_conflict(spark, sf_dir):
    return count_rows(_submissions(spark, sf_dir), ListSpec.parse('{"id": [1, 2]}'), ADMIN, SUBMISSIONS)


_PAGE = """
SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS name, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS time_added,
  row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey) AS rank FROM (
  SELECT * FROM orders ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT {limit} OFFSET 20)
"""


@REGISTRY.add(_PAGE.format(limit=10))
def Q07_page_half_open(spark, sf_dir):
    return _ranked(_submissions(spark, sf_dir), ListSpec.parse(None, '["time_added", "ASC"]', "[20, 30]"), ADMIN, CRUD)


@REGISTRY.add(_PAGE.format(limit=11))
def Q08_page_inclusive(spark, sf_dir):
    return _ranked(_submissions(spark, sf_dir), ListSpec.parse(None, '["time_added", "ASC"]', "[20, 30]"), ADMIN, OBJECTS)


_DEEP_PAGE = """
WITH l AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS id, l_shipdate AS shipped, l_extendedprice AS price, l_partkey AS part,
    count(*) OVER () * 9 // 10 AS start FROM lineitem
), r AS (SELECT *, row_number() OVER (ORDER BY {order}, id) - 1 AS place FROM l)
SELECT id, shipped, price, part FROM r WHERE place >= start AND place < start + {rows}
"""


def _lines(spark, sf_dir) -> tuple[Resource, int]:
    """Line items, with an id of their whole key, and where the last tenth of them begins."""
    lines = table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("id"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"),
    )
    return Resource("lines", lines), lines.count() * 9 // 10


@REGISTRY.add(_DEEP_PAGE.format(order="price DESC", rows=50))
def Q77_deep_page_half_open(spark, sf_dir):
    """A page of 50 rows behind nine tenths of all, by price, falling; equal prices by id."""
    resource, start = _lines(spark, sf_dir)
    return list_rows(resource, ListSpec.parse(None, '["price", "DESC"]', f"[{start}, {start + 50}]"), ADMIN, CRUD)


@REGISTRY.add(_DEEP_PAGE.format(order="shipped", rows=1001))
def Q78_deep_page_inclusive(spark, sf_dir):
    """A page of 1,001 rows behind nine tenths of all, by a date that many rows share."""
    resource, start = _lines(spark, sf_dir)
    return list_rows(resource, ListSpec.parse(None, '["shipped", "ASC"]', f"[{start}, {start + 1000}]"), ADMIN, OBJECTS)


@REGISTRY.add("""
SELECT event_id AS id, nullif(event_type, 'error') AS kind, row_number() OVER (ORDER BY nullif(event_type, 'error') NULLS LAST, event_id) AS rank
FROM events WHERE user_id = 7 QUALIFY rank <= 500
""")
def Q09_sort_nulls(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.nullif("event_type", F.lit("error")).alias("kind"), F.col("user_id").alias("owner")
    )
    return _ranked(Resource("events", events), ListSpec.parse(None, '["kind", "ASC"]', "[0, 500]"), OWNER, CRUD).drop("owner")


@REGISTRY.add("""
SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS name, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS time_added
FROM orders WHERE o_orderkey = 42
""")
def Q10_point_lookup(spark, sf_dir):
    found = find_one(submissions(spark, sf_dir), ADMIN, "id", 42)
    return found.unionByName(find_one(submissions(spark, sf_dir), Principal(-1, ("user",)), "id", 42))


@REGISTRY.add("SELECT concat('submissions 0-9/', count(*)) AS content_range FROM orders WHERE o_orderpriority LIKE '%HIGH%'")
def Q11_content_range(spark, sf_dir):
    return content_range(_submissions(spark, sf_dir), ListSpec.parse('{"name": "HIGH"}', None, "[0, 9]"), ADMIN, SUBMISSIONS)


@REGISTRY.add("SELECT s_suppkey AS id, s_name AS name, NULL::DOUBLE AS balance, 0::INT AS nation FROM supplier")
def Q56_role_mask(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return masked(suppliers, OWNER, {"balance": F.lit(None), "nation": F.lit(0)})


@REGISTRY.add("""
SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
""")
def Q58_list_with_children(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    children = {"events": (table(spark, sf_dir, "events"), "user_id", "id")}
    resource = Resource("customers", customers, children=children)
    return list_rows(resource, ListSpec.parse('{"events": true}'), ADMIN, CRUD)


@REGISTRY.add("SELECT 1 AS ok")
def Q59_probe(spark, sf_dir):
    from ..sources.tables import probe

    return probe(spark)


@REGISTRY.add(r"""
SELECT doc_id, lang, source, length(text) AS n FROM documents
WHERE text LIKE '%rning%al%' OR text LIKE '%_icense%' OR text LIKE '%@%.com%' OR text LIKE '%zq\_xj%' ESCAPE '\'
""")
def Q81_like_by_sketches(spark, sf_dir):
    """Documents like one of several patterns, from files whose sketches don't rule all of them out."""
    path = f"{shared_folder(spark)}/documents"
    table(spark, sf_dir, "documents").repartitionByRange(24, "doc_id").write.parquet(path)
    sketches = sketch(spark.read.parquet(path), "text")
    found = like_scan(spark, path, sketches, "text", ["%rning%al%", "%_icense%", "%@%.com%", "%zq\\_xj%"])
    return found.select("doc_id", "lang", "source", F.length("text").alias("n"))
