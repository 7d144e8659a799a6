import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewell.sources.versions import Conflict, VersionedTable
from tidewell.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def stamps(table):
    """Name and modification time of the newest version's files."""
    paths = [f.removeprefix("file:") for f in table.files()]
    return {os.path.basename(os.path.dirname(p)) + "/" + os.path.basename(p): os.stat(p).st_mtime_ns for p in paths}


@pytest.fixture()
def table(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as name", "double(id) as total")
    return VersionedTable.create(df, f"{tmp_path}/t", ["id"], files=10)


def test_untouched_files_keep_name_and_time(spark, table):
    before = stamps(table)
    assert len(before) == 10
    patches = spark.createDataFrame([(5, "five", None, ["name", "total"]), (6, "six", 0.0, ["name"]), (9999, "x", 0.0, ["name"])], "id long, name string, total double, set_fields array<string>")
    table.patch(patches, "id")
    after = stamps(table)
    assert len(before.items() & after.items()) == 9
    rows = {r.id: (r.name, r.total) for r in table.read().collect()}
    assert len(rows) == 1000 and rows[5] == ("five", None) and rows[6] == ("six", 6.0) and rows[7] == ("0", 7.0)
    table.delete_keys(spark.createDataFrame([(5,), (None,)], "id long"), "id")
    table.update_where(F.col("id") == 999, {"name": F.lit("last")})
    last = stamps(table)
    assert len(before.items() & last.items()) == 8 and table.read().count() == 999
    assert table.read().where("name = 'last'").first().id == 999
    unchanged = table.version()
    assert table.update_where(F.col("id") == -1, {"name": F.lit("x")}) == unchanged
    assert table.delete_keys(spark.createDataFrame([(-5,)], "id long"), "id") == unchanged
    table.upsert(spark.createDataFrame([(999, "again", 1.0), (2000, "new", 2.0)], "id long, name string, total double"), "id")
    assert {r.id: r.name for r in table.read().where("id >= 998").collect()} == {998: "4", 999: "again", 2000: "new"}
    assert table.read(table.version(0)).count() == 1000  # the first version is still there


def test_two_writers_and_a_failure_before_the_commit(spark, table, monkeypatch):
    old = table.version()
    table.append(spark.createDataFrame([(5000, "a", 1.0)], "id long, name string, total double"))
    monkeypatch.setattr(VersionedTable, "version", lambda self, *a, **k: old)
    with pytest.raises(Conflict):
        table.append(spark.createDataFrame([(6000, "b", 1.0)], "id long, name string, total double"))
    monkeypatch.undo()
    assert table.read().count() == 1001 and not table.read().where("id = 6000").count()
    with pytest.raises(FileExistsError):
        VersionedTable.create(spark.range(1), table.root)
    assert table.forget(keep=1) >= 1  # what the loser wrote
    assert table.read().count() == 1001


def test_a_table_without_rows(spark, tmp_path):
    table = VersionedTable.create(spark.range(0).selectExpr("id", "'x' as name"), f"{tmp_path}/e")
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("n", 1)], "name string, id long"), "id")
    table.delete_keys(spark.createDataFrame([(1,)], "id long"), "id")
    assert table.read().count() == 0 and table.read().columns == ["id", "name"]


SCHEMA = "object_id string, message string, last_ts timestamp, last_seq long"


def test_batches_count_once(spark, tmp_path, monkeypatch):
    table = VersionedTable.create(spark.createDataFrame([("a", "old", T0, 0), ("k", "kept", T0, 0)], SCHEMA), f"{tmp_path}/t")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    spark.createDataFrame([("a", "one", at(1), 1), ("a", "two", at(1), 2), ("b", "new", at(1), 3)], SCHEMA).write.parquet(f"{tmp_path}/in")

    def run(checkpoint):
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = jobs.upsert_stream_once(source, "object_id", table, "uploads").option("checkpointLocation", f"{tmp_path}/{checkpoint}")
        query.trigger(availableNow=True).start().awaitTermination(120)

    # A failure after the new files were written, before the commit: nothing is seen of it.
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run("c")
    assert {r.object_id: r.message for r in table.read().collect()} == {"a": "old", "k": "kept"}
    run("c")  # the batch is run again
    expected = {"a": "two", "b": "new", "k": "kept"}
    assert {r.object_id: r.message for r in table.read().collect()} == expected
    # A failure after the commit, before Spark noted the batch: it comes again under the same number.
    version = table.version()
    assert version.ledger == {"uploads": 0}
    run("another")
    assert table.version() == version and table.read().count() == 3
    # Older states than the table's don't replace them, whatever the batch.
    spark.createDataFrame([("a", "late", at(0), 9), ("k", "newer", at(5), 1)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    run("c")
    assert {r.object_id: r.message for r in table.read().collect()} == expected | {"k": "newer"}
    assert table.version().ledger == {"uploads": 1}


def test_reconciliation_counts_once(spark, tmp_path):
    statuses = spark.createDataFrame(
        [(str(i), f"job-{i}", "Running", True, True) for i in range(40)],
        "id string, kubernetes_pod_name string, status string, is_running boolean, is_still_kubernetes_resource boolean",
    )
    table = VersionedTable.create(statuses, f"{tmp_path}/t", ["id"], files=8)
    before = stamps(table)
    schema = "taken timestamp, succeeded boolean, name string"
    rows = [(T0, True, f"job-{i}-0-0") for i in range(40) if i != 3] + [(T0, False, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.keep_reconciled_once(stream, table, "pods").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination(120)

    run("c")
    assert {r.id for r in table.read().where("status = 'Deleted'").collect()} == {"3"} and table.read().count() == 40
    assert len(before.items() & stamps(table).items()) == 7
    version = table.version()
    run("again")
    assert table.version() == version
