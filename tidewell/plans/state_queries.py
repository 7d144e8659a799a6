"""Mutations and folds of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import abandon_notice, elapsed_seconds
from ..operators import mutate
from ..session import shared_folder
from ..sources.versions import VersionedTable
from ..streaming import jobs, uploads as upload_streams
from .registry import NOW, Registry, submissions, table, uploads

REGISTRY = Registry()

_FOLD = """
WITH u AS (SELECT user_id::VARCHAR AS object_id, ts, event_id AS seq, (props::JSON ->> '$.k')::BIGINT AS k,
  CASE event_type WHEN 'purchase' THEN 'Upload complete' WHEN 'signup' THEN 'Upload initiated'
  WHEN 'view' THEN printf('Upload progress: %.2f%%', (props::JSON ->> '$.k')::DOUBLE) ELSE 'Upload started' END AS message,
  event_type = 'purchase' AS done FROM events),
f AS (SELECT object_id, arg_max(message, (ts, seq)) AS message, arg_max(k, (ts, seq)) AS received, 100::BIGINT AS size,
  bool_or(done) AS all_parts_received, false AS deleted, max(ts) AS last_ts, arg_max(seq, (ts, seq)) AS last_seq FROM u GROUP BY object_id)
"""


@REGISTRY.add(_FOLD + "SELECT * FROM f")
def Q46_upload_fold(spark, sf_dir):
    return upload_streams.fold_uploads(uploads(spark, sf_dir))


@REGISTRY.add(_FOLD + """
SELECT object_id, NOT all_parts_received AND epoch_us(TIMESTAMP '2024-02-01' - last_ts) >= 86400 * 1000000::BIGINT AS expired FROM f
""")
def Q47_idle_expiry(spark, sf_dir):
    open_ = upload_streams.fold_uploads(uploads(spark, sf_dir))
    return upload_streams.idle_uploads(open_, F.lit(NOW), 86_400.0).select("object_id", "expired")


@REGISTRY.add("""
SELECT user_id, CASE WHEN epoch_us(TIMESTAMP '2024-02-01' - max(ts)) > 60000000 THEN concat('Upload seems abandoned: no data for ',
  ceil(epoch_us(TIMESTAMP '2024-02-01' - max(ts)) / 1000000.0)::BIGINT, ' seconds') END AS notice FROM events GROUP BY user_id
""")
def Q48_abandon_notice(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    idle = elapsed_seconds(F.col("last_ts"), F.lit(NOW))
    return last.select("user_id", F.when(idle > 60, abandon_notice(idle)).alias("notice"))


@REGISTRY.add("""
WITH s AS (SELECT user_id::VARCHAR AS job_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'view' THEN 'Running'
  WHEN 'click' THEN 'Pending' WHEN 'error' THEN NULL ELSE 'Failed' END AS status FROM events),
f AS (SELECT job_id, arg_max(struct_pack(s := status), (ts, seq)).s AS status, count(status) AS n FROM s GROUP BY job_id)
SELECT job_id, CASE WHEN n = 0 THEN 'timed_out' WHEN status IN ('Pending', 'Running') THEN 'running' WHEN status = 'Succeeded' THEN 'succeeded' ELSE 'failed' END AS state,
  CASE WHEN n > 0 THEN coalesce(status, 'Deleted') END AS status, status IN ('Pending', 'Running') AS is_running,
  coalesce(status = 'Succeeded', false) AS is_successful, status IS NOT NULL AS is_still_kubernetes_resource FROM f
""")
def Q49_job_final_state(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "Succeeded").when(kind == "view", "Running").when(kind == "click", "Pending").when(kind == "error", None).otherwise("Failed")
    snapshots = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), status.alias("status"), "ts", F.col("event_id").alias("seq"))
    return jobs.final_states(snapshots, F.lit(NOW))


@REGISTRY.add("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('new ', c_custkey) ELSE c_name END AS name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer
""")
def Q50_partial_update(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    fields = F.when(F.col("id") % 6 == 0, F.array(F.lit("name"), F.lit("balance"))).otherwise(F.array(F.lit("name")))
    patches = customers.where("id % 3 = 0").select(
        "id",
        F.concat(F.lit("new "), F.col("id").cast("string")).alias("name"),
        F.lit(None).cast("double").alias("balance"),
        F.lit("unset").alias("segment"),
        fields.alias("set_fields"),
    )
    return mutate.patch(customers, patches, "id")


@REGISTRY.add("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def Q51_delete_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return mutate.delete_keys(submissions(spark, sf_dir).select("id", "total"), gone, "id")


@REGISTRY.add("""
SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS balance FROM supplier
UNION ALL SELECT c_custkey + 1000000, c_name, NULL FROM customer WHERE c_nationkey = 3
""")
def Q60_insert_and_update(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    updated = mutate.update_where(suppliers, F.col("balance") < 0, {"balance": F.lit(0.0)})
    new = table(spark, sf_dir, "customer").where("c_nationkey = 3").select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_name").alias("name"))
    return mutate.insert(updated, new)


@REGISTRY.add("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END AS owner FROM orders
UNION ALL SELECT -o_orderkey, -1 FROM orders WHERE o_orderkey % 4 = 0
""")
def Q61_upsert(spark, sf_dir):
    orders = submissions(spark, sf_dir).select("id", "owner")
    rows = orders.where("id % 4 = 0").select("id", F.lit(-1).cast("long").alias("owner"))
    return mutate.upsert(orders, rows.unionByName(rows.withColumn("id", -F.col("id"))), "id")


@REGISTRY.add("SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_nationkey END AS nation, 1.5::DOUBLE AS fps FROM customer")
def Q62_clear_parent_and_add_column(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    gone = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"))
    return mutate.add_column(mutate.clear_parent(customers, gone, "nation"), "fps", "double", 1.5)


@REGISTRY.add("""
SELECT o_orderkey AS id, CASE WHEN o_custkey = 7 THEN -7 ELSE o_custkey END AS owner, CASE WHEN o_custkey = 7 THEN 'moved' ELSE o_orderpriority END AS name,
  o_orderstatus AS status, o_totalprice AS total, o_orderdate AS time_added FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)
UNION ALL SELECT -o_orderkey, o_custkey, 'new', o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 450000
""")
def Q79_copy_on_write(spark, sf_dir):
    """Orders as a versioned table, clustered by owner, after an update, a deletion and an upsert; each rewrites only
    the files that hold its keys."""
    orders = submissions(spark, sf_dir)
    held = VersionedTable.create(orders, shared_folder(spark), ["owner"], files=16)
    held.update_where(F.col("owner") == 7, {"owner": F.lit(-7), "name": F.lit("moved")})
    poor = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("owner"))
    held.delete_keys(poor, "owner")
    new = orders.where("total > 450000").select((-F.col("id")).alias("id"), "owner", F.lit("new").alias("name"), "status", "total", "time_added")
    held.upsert(new, "id")
    return held.read()
