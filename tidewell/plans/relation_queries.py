"""Relationships, references, roles, orders, constraints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import constraints, dataflow, nest
from ..operators.substrings import texts_with_words
from ..session import shared_folder
from ..sources.keys import Keys
from .registry import Registry, inputs, submissions, table

REGISTRY = Registry()


@REGISTRY.add("""
SELECT c_custkey AS id, c_name AS name, n_nationkey AS nation_key, n_name AS nation_name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey
""")
def Q12_parent_left_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0")
    joined = nest.attach_parent(table(spark, sf_dir, "customer"), nations, "c_nationkey", "n_nationkey", "nation")
    return joined.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("nation.n_nationkey").alias("nation_key"), F.col("nation.n_name").alias("nation_name")
    )


@REGISTRY.add("""
SELECT c_custkey AS id, coalesce(n, 0) AS n_events, last_ts FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY user_id) ON user_id = c_custkey
""")
def Q13_children_agg(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    found = {"n_events": F.count(F.lit(1)), "last_ts": F.max("ts")}
    return nest.children_summary(customers, table(spark, sf_dir, "events"), "user_id", "id", found, ["n_events"])


@REGISTRY.add("""
SELECT o_orderkey AS id, count(DISTINCT p_partkey) AS n_inputs, min(p_name) AS first_name
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey
""")
def Q14_m2n_link(spark, sf_dir):
    orders = submissions(spark, sf_dir).select("id")
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    linked = pairs.join(inputs(spark, sf_dir), F.col("l_partkey") == F.col("id")).select("l_orderkey", "filename")
    found = {"n_inputs": F.count(F.lit(1)), "first_name": F.min("filename")}
    return nest.children_summary(orders, linked, "l_orderkey", "id", found, ["n_inputs"])


@REGISTRY.add("SELECT c_custkey AS id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def Q15_exists(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return nest.exists_child(customers, table(spark, sf_dir, "events"), "user_id")


@REGISTRY.add("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def Q16_not_exists(spark, sf_dir):
    orders = submissions(spark, sf_dir).select("id", "total")
    return nest.exists_child(orders, table(spark, sf_dir, "lineitem"), "l_orderkey", wanted=False)


@REGISTRY.add("""
WITH c AS (SELECT p_type, p_brand, round(sum(p_size) * 100.0 / (sum(sum(p_size)) OVER (PARTITION BY p_type)), 6) AS cover
  FROM part GROUP BY p_type, p_brand)
SELECT p_type AS kind, p_brand AS class, cover::DOUBLE AS percentage_cover, CASE WHEN p_brand <> 'Brand#11' THEN md5(p_brand) END AS color FROM c
""")
def Q17_map_left_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    sizes = parts.groupBy("p_type", "p_brand").agg(F.sum("p_size").alias("n"))
    of_type = sizes.groupBy(F.col("p_type").alias("kind")).agg(F.sum("n").alias("total"))
    cover = F.round(F.col("n") * F.lit(100.0) / F.col("total"), 6)
    covers = sizes.join(of_type, F.col("p_type").eqNullSafe(F.col("kind"))).select("kind", F.col("p_brand").alias("class"), cover.alias("percentage_cover"))
    colours = parts.where("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("class"), F.md5("p_brand").alias("color")).distinct()
    return covers.join(colours, "class", "left").select("kind", "class", "percentage_cover", "color")


@REGISTRY.add("""
SELECT conv_id AS id, bool_or(role = 'assistant') AS is_admin, true AS is_user FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id
""")
def Q18_role_union_precedence(spark, sf_dir):
    members = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select(F.col("conv_id").alias("id"), "role")
    return dataflow.merge_roles(members, admin="assistant")


@REGISTRY.add("""
WITH s AS (SELECT event_id AS id, user_id, event_type AS status, value > 10 AS live FROM events)
SELECT id, CASE WHEN live AND user_id % 2 <> 0 THEN 'Deleted' ELSE status END AS status,
  CASE WHEN live AND user_id % 2 <> 0 THEN false ELSE true END AS is_running,
  CASE WHEN live AND user_id % 2 <> 0 THEN false ELSE live END AS is_still_kubernetes_resource FROM s
""")
def Q19_reconcile_deleted(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    statuses = events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("kubernetes_pod_name"),
        F.col("event_type").alias("status"),
        F.lit(True).alias("is_running"),
        (F.col("value") > 10).alias("is_still_kubernetes_resource"),
    )
    pods = events.where("user_id % 2 = 0").select(F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-0-0")).alias("name")).distinct()
    return dataflow.reconcile(statuses, pods).drop("kubernetes_pod_name")


@REGISTRY.add("""
SELECT l_orderkey AS order_key, l_partkey AS part_key, l_linenumber AS line,
  CASE WHEN p_partkey IS NULL THEN 'missing' WHEN nullif(l_suppkey % 4, 0) IS DISTINCT FROM nullif(p_size % 4, 0) THEN 'mismatch' ELSE 'ok' END AS verdict
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = l_partkey
""")
def Q20_ref_check(spark, sf_dir):
    parts = inputs(spark, sf_dir).where("id % 10 <> 0").withColumn("parent", F.nullif(F.col("size") % 4, F.lit(0)).cast("long"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), F.col("l_linenumber").alias("line"), "l_suppkey"
    )
    own = F.nullif(F.col("l_suppkey") % 4, F.lit(0))
    return dataflow.check_references(lines, parts, "part_key", "id", own, "parent").drop("l_suppkey")


@REGISTRY.add("""
SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part_key FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 7)
""")
def Q21_owner_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_key")
    )
    own = submissions(spark, sf_dir).where("owner = 7")
    return nest.exists_child(lines, own, "id", "order_key")


@REGISTRY.add("""
SELECT l_orderkey AS order_key, l_partkey AS part_key, l_linenumber AS line, wanted FROM lineitem
JOIN (SELECT l_orderkey AS k, l_partkey AS p, max(l_linenumber) AS wanted FROM lineitem GROUP BY ALL)
ON k = l_orderkey AND p = l_partkey
""")
def Q22_composite_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), F.col("l_linenumber").alias("line")
    )
    wanted = lines.groupBy("order_key", "part_key").agg(F.max("line").alias("wanted"))
    return lines.join(wanted, ["order_key", "part_key"])


@REGISTRY.add("""
SELECT p_partkey AS id, word FROM part JOIN (VALUES ('ring'), ('t g'), ('%'), ('_g')) AS w(word) ON contains(p_name, word)
""")
def Q23_contains_theta(spark, sf_dir):
    words = spark.createDataFrame([("ring",), ("t g",), ("%",), ("_g",)], "word string")
    parts = inputs(spark, sf_dir).select("id", "filename")
    return dataflow.containing(parts, words, "filename", "word").select("id", "word")


@REGISTRY.add("""
SELECT count(*) FILTER (source LIKE 'src1%') AS inputs_count, coalesce(sum(n_chars) FILTER (source LIKE 'src1%'), 0)::BIGINT AS inputs_bytes,
  count(*) FILTER (source LIKE 'src2%') AS outputs_count, coalesce(sum(n_chars) FILTER (source LIKE 'src2%'), 0)::BIGINT AS outputs_bytes,
  count(*) FILTER (source LIKE 'src%') AS total_count, coalesce(sum(n_chars) FILTER (source LIKE 'src%'), 0)::BIGINT AS total_bytes FROM documents
""")
def Q24_prefix_usage(spark, sf_dir):
    listing = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("size"))
    return dataflow.prefix_usage(listing, {"inputs": "src1", "outputs": "src2", "total": "src"})


@REGISTRY.add("SELECT conv_id AS id, bool_or(role = 'assistant') AS is_admin, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def Q25_any_role(spark, sf_dir):
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("id"))
        .agg(F.bool_or(F.col("role") == "assistant").alias("is_admin"), F.count(F.lit(1)).alias("n_turns"))
    )


@REGISTRY.add("""
SELECT user_id, ts, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def Q26_latest_status(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return dataflow.latest(events, "user_id", "ts", "event_id")


@REGISTRY.add("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id
  ORDER BY coalesce(nullif(CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END, ''),
  '9999-00-00T00:00:00Z') DESC, event_id) AS rank FROM events
""")
def Q27_status_order(spark, sf_dir):
    started = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", started.alias("started"))
    return dataflow.status_rank(events, "user_id", "started", "event_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@REGISTRY.add("""
SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part_key, l_suppkey AS supp_key,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem
""")
def Q28_processing_order(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key")
    )
    ranked = dataflow.processing_rank(lines, "order_key", ["line", "part_key", "supp_key"])
    return ranked.withColumn("position", F.col("position").cast("long"))


@REGISTRY.add("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def Q29_role_intersect(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return dataflow.kept_roles(own, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])


@REGISTRY.add("""
WITH c AS (SELECT DISTINCT user_id FROM events), r AS (SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT user_id, 'add' AS action FROM (FROM r EXCEPT FROM c) UNION ALL SELECT user_id, 'delete' FROM (FROM c EXCEPT FROM r)
""")
def Q30_role_except(spark, sf_dir):
    current = table(spark, sf_dir, "events").select("user_id").distinct()
    requested = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id")).distinct()
    return dataflow.role_changes(current, requested, ["user_id"])


@REGISTRY.add("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def Q52_unique_violations(spark, sf_dir):
    return constraints.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@REGISTRY.add("""
SELECT o_orderkey AS id, nullif(o_custkey * 2, 14) AS owner FROM orders
WHERE nullif(o_custkey * 2, 14) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey * 2)
""")
def Q53_fk_orphans(spark, sf_dir):
    orders = submissions(spark, sf_dir).select("id", F.nullif(F.col("owner") * 2, F.lit(14)).alias("owner"))
    return constraints.orphans(orders, "owner", table(spark, sf_dir, "customer"), "c_custkey")


@REGISTRY.add("SELECT user_id, bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AS complete FROM events GROUP BY user_id")
def Q54_file_gate(spark, sf_dir):
    return dataflow.file_gate(table(spark, sf_dir, "events"), "user_id", "event_type", ("click", "purchase"))


@REGISTRY.add("""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT n_nationkey AS id, n_name AS name, count(c_custkey) AS n_customers, coalesce(sum(n), 0)::BIGINT AS n_orders
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL
""")
def Q57_two_level_nest(spark, sf_dir):
    orders = submissions(spark, sf_dir).select("id", "owner")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    counted = nest.children_summary(customers, orders, "owner", "id", {"n_orders": F.count(F.lit(1))}, ["n_orders"])
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    found = {"n_customers": F.count(F.lit(1)), "n_orders": F.sum("n_orders")}
    return nest.children_summary(nations, counted, "nation", "id", found, list(found))


@REGISTRY.add(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
n AS (SELECT p_partkey AS id, p_name AS name FROM part)
SELECT w.word, count(*) AS parts, min(n.id) AS first_part, max(n.id) AS last_part FROM w JOIN n ON contains(n.name, w.word) GROUP BY w.word
""")
def Q80_words_in_names(spark, sf_dir):
    """The documents' words that part names hold anywhere, with the number of parts; both sides grow with their tables."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    words = table(spark, sf_dir, "documents").select(F.explode(found).alias("word"))
    pairs = texts_with_words(table(spark, sf_dir, "part"), words, "p_partkey", "p_name", "word")
    return pairs.groupBy("word").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"), F.max("p_partkey").alias("last_part"))


@REGISTRY.add("""
WITH b AS (SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem WHERE l_quantity > 40 GROUP BY ALL),
e AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 40)
SELECT b.l_orderkey, b.l_linenumber, b.occurrences, e.l_orderkey IS NOT NULL AS stored FROM b LEFT JOIN e USING (l_orderkey, l_linenumber)
WHERE e.l_orderkey IS NOT NULL OR b.occurrences > 1
""")
def Q83_insert_breaks_keys(spark, sf_dir):
    """Line items of large quantity as a batch, against the keys of all others."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    stored = Keys.write(lines.where("l_quantity <= 40"), f"line_keys_{uuid.uuid4().hex}", keys, buckets=16, path=shared_folder(spark))
    return stored.breaks(lines.where("l_quantity > 40").select(*keys))
