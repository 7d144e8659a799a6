import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewell.sources import events as event_source
from tidewell.sources import objects, snapshots, tables
from tidewell.streaming import jobs, uploads

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def hook(kind, object_id, seconds, seq, offset=None, size=100, partial=False):
    upload = {"ID": f"inputs/{object_id}+part", "Size": size, "Offset": offset, "IsPartial": partial, "MetaData": {"filename": "a.mp4"}}
    event = {"HTTPRequest": {"Header": {"Authorization": ["Bearer tok"]}}, "Upload": upload}
    return {"Type": kind, "Event": event, "received": at(seconds).isoformat() + "Z", "sequence": seq}


EVENTS = [
    hook("pre-create", "a", 0, 1), hook("post-create", "a", 1, 2), hook("post-receive", "a", 5, 4, 50), hook("post-receive", "a", 3, 3, 25),
    hook("pre-finish", "a", 9, 5, 100), hook("post-finish", "a", 9, 6, 100),
    hook("pre-create", "b", 2, 7), hook("post-receive", "b", 4, 8, 10, size=0),
    hook("post-create", "c", 2, 9), hook("post-finish", "c", 3, 10, partial=True),
    hook("unknown", "d", 1, 11),
]


@pytest.fixture()
def folder(tmp_path):
    for i in range(0, len(EVENTS), 4):
        (tmp_path / f"{i:02d}.json").write_text("\n".join(map(json.dumps, EVENTS[i : i + 4])))
    return str(tmp_path)


EXPECTED = {
    "a": ("Upload complete", 100, 100, True, False),
    "b": ("Upload progress: unknown", 10, 0, False, False),
    "c": ("Upload complete", None, 100, False, True),
}


def test_batch_fold(spark, folder):
    events = event_source.read_upload_events(spark, folder)
    assert {r.token for r in events.collect()} == {"tok"} and {r.filename for r in events.collect()} == {"a.mp4"}
    states = uploads.fold_uploads(events)
    found = {r.object_id: (r.message, r.received, r.size, r.all_parts_received, r.deleted) for r in states.collect()}
    assert found == EXPECTED
    idle = {r.object_id: (r.idle_seconds, r.expired, r.notice) for r in uploads.idle_uploads(states, F.lit(at(104)).cast("timestamp"), 100).collect()}
    assert idle["b"] == (100.0, True, "Upload seems abandoned: no data for 100 seconds")
    assert idle["a"][1:] == (False, None) and idle["c"][1:] == (False, None)
    assert not uploads.idle_uploads(states, F.lit(at(64)).cast("timestamp"), 100).where("notice is not null").count()


def drain(stream, tmp, name):
    query = stream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}")
    query.trigger(availableNow=True).start().awaitTermination(120)


def test_stream_fold_equals_batch_and_times_out(spark, folder, tmp_path_factory):
    tmp = str(tmp_path_factory.mktemp("state"))
    # A far event moves the watermark on, which fires the timer of b.
    with open(f"{folder}/90.json", "w") as f:
        f.write(json.dumps(hook("pre-create", "z", 5000, 90)))
    with open(f"{folder}/91.json", "w") as f:
        f.write(json.dumps(hook("post-create", "z", 5001, 91)))
    events = event_source.stream_upload_events(spark, folder, files_per_trigger=1)
    drain(uploads.follow_uploads(events, timeout_seconds=600, delay="60 seconds").writeStream, tmp, "followed")
    rows = spark.sql("select * from followed").collect()
    last = {}
    for r in rows:
        last[r.object_id] = (r.message, r.received, r.size, r.all_parts_received, r.deleted)
    assert last["a"] == EXPECTED["a"] and last["c"] == EXPECTED["c"]
    assert ("b", "Upload progress: unknown", False) in {(r.object_id, r.message, r.deleted) for r in rows}
    assert last["b"][0] == "Upload timed out" and last["b"][4]


def test_job_states(spark):
    rows = [("ok", "Running", 1), ("ok", "Succeeded", 2), ("run", "Pending", 3), ("bad", "Running", 1), ("bad", "Failed", 2), ("new", None, 0), ("gone", "Running", 1), ("gone", None, 5)]
    frame = spark.createDataFrame([(j, s, at(t), t) for j, s, t in rows], "job_id string, status string, ts timestamp_ntz, seq long")
    found = {r.job_id: (r.state, r.status, r.is_running, r.is_successful) for r in jobs.final_states(frame, F.lit(at(60))).collect()}
    assert found["ok"] == ("succeeded", "Succeeded", False, True) and found["run"] == ("running", "Pending", True, False)
    assert found["bad"][0] == "failed" and found["new"][:2] == ("waiting", None) and found["gone"][:2] == ("failed", "Deleted")
    late = {r.job_id: r.state for r in jobs.final_states(frame, F.lit(at(120))).collect()}
    assert late["new"] == "timed_out" and late["run"] == "running"


def test_job_stream_equals_batch_and_times_out(spark, tmp_path):
    rows = [("ok", "Running", 1), ("run", "Pending", 3), ("new", None, 0), ("gone", "Running", 1), ("ok", "Succeeded", 4), ("gone", None, 5), ("bad", "Failed", 2), ("late", None, 6)]
    rows += [("late", "Running", 100), ("zz", "Running", 5000), ("zz", "Running", 5001), ("zz", "Running", 5002)]
    (tmp_path / "in").mkdir()
    for i, (job, status, t) in enumerate(rows):
        path = tmp_path / "in" / f"{i:02d}.json"
        path.write_text(json.dumps({"job_id": job, "status": status, "ts": at(t).isoformat() + "Z", "seq": i}))
        os.utime(path, (1_700_000_000 + i,) * 2)  # files are read in this order
    schema = "job_id string, status string, ts timestamp, seq long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    drain(jobs.follow_jobs(stream, wait_seconds=120, delay="60 seconds").writeStream, str(tmp_path), "jobs_followed")
    found = {}
    for r in spark.sql("select * from jobs_followed").collect():
        found.setdefault(r.job_id, []).append(r)
    assert [r.state for r in found["new"]] == ["waiting", "timed_out"] and [r.state for r in found["late"]] == ["waiting", "running"]
    columns = ["state", "status", "is_running", "is_successful", "is_still_kubernetes_resource"]
    batch = jobs.final_states(spark.read.schema(schema).json(str(tmp_path / "in")), F.lit(at(5000)).cast("timestamp"))
    assert {r.job_id: tuple(r[c] for c in columns) for r in batch.collect()} == {j: tuple(x[-1][c] for c in columns) for j, x in found.items()}


def test_reconciliation_stream(spark, tmp_path):
    schema = "taken timestamp, succeeded boolean, name string"
    statuses = spark.createDataFrame(
        [("1", "job-1", "Running", True, True), ("2", "job-2", "Running", True, True)],
        "id string, kubernetes_pod_name string, status string, is_running boolean, is_still_kubernetes_resource boolean",
    )
    states = [statuses]
    spark.createDataFrame([(T0, False, None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def run():
        save = lambda df: states.append(df.sparkSession.createDataFrame(df.collect(), df.schema))
        jobs.keep_reconciled(stream(), lambda: states[-1], save).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)

    run()
    assert len(states) == 1
    spark.createDataFrame([(at(1), True, "job-1-0-0"), (T0, True, "job-2-0-0")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {r.id: r.status for r in states[-1].collect()} == {"1": "Running", "2": "Deleted"}


def test_upsert_stream(spark, tmp_path):
    schema = "object_id string, message string, last_ts timestamp, last_seq long"
    held = [spark.createDataFrame([("a", "old", T0, 0), ("k", "kept", T0, 0)], schema)]
    spark.createDataFrame([("a", "one", at(1), 1), ("a", "two", at(1), 2), ("b", "new", at(1), 3)], schema).write.parquet(f"{tmp_path}/in")
    save = lambda df: held.append(spark.createDataFrame(df.collect(), schema))
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    jobs.upsert_stream(source, "object_id", lambda: held[-1], save).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert {r.object_id: r.message for r in held[-1].collect()} == {"a": "two", "b": "new", "k": "kept"}


def test_object_store(spark, tmp_path):
    (tmp_path / "p/inputs").mkdir(parents=True)
    (tmp_path / "p/inputs/a.bin").write_bytes(b"12345")
    (tmp_path / "p/covers.json").write_text('{"coral": 0.5,\n "sand": 0.25}')
    (tmp_path / "p/job.log").write_text("1%\r2%\nend")
    listing = objects.list_objects(spark, str(tmp_path))
    assert {r.key: r["size"] for r in listing.collect()} == {"p/inputs/a.bin": 5, "p/covers.json": 29, "p/job.log": 9}
    assert [r.key for r in objects.list_objects(spark, str(tmp_path), "p/inputs/").collect()] == ["p/inputs/a.bin"]
    out = objects.file_outputs(listing.where("key like '%json'"), "https://x/files", "s1").first()
    assert (out.filename, out.size_bytes, out.url) == ("covers.json", 29, "https://x/files/s1/covers.json")
    assert objects.read_json_maps(spark, f"{tmp_path}/p/covers.json").first().document == {"coral": 0.5, "sand": 0.25}
    assert objects.read_logs(spark, f"{tmp_path}/p/job.log").first().log == "1%\r2%\nend"
    assert bytes(objects.read_binaries(spark, f"{tmp_path}/p/inputs").first().content) == b"12345"


def test_snapshots_and_directory(spark, tmp_path):
    (tmp_path / "pods.json").write_text(json.dumps({"metadata": {"name": "job-1-0-0"}, "status": {"phase": "Running", "startTime": "2024"}}))
    pods = snapshots.read_pods(spark, f"{tmp_path}/pods.json")
    assert tuple(snapshots.job_states(pods).first()) == ("job-1-0-0", "Running", "2024")
    assert snapshots.pods_from_rows(spark, [("x", None, None)]).first().name == "x"
    users = spark.createDataFrame([("1", "Ann", {"login-method": ["google"]}), ("2", "Bob", None)], "id string, username string, attributes map<string,array<string>>")
    members = spark.createDataFrame([("1", "admin"), ("1", "user")], "id string, role string")
    found = {r.id: (r.login_method, r.is_admin) for r in snapshots.directory_users(users, members).collect()}
    assert found == {"1": ("GOOGLE", True), "2": ("DEFAULT", None)}
    names = lambda f: [r.id for r in snapshots.list_users(users, members, f).orderBy("id").collect()]
    assert [names(f) for f in ({"users_only": True}, {"id": ["2", "9"]}, {"id": "1"}, {"username": "aN"}, {})] == [["1"], ["2"], ["1"], ["1"], ["1", "2"]]


def test_tables(spark, tmp_path):
    df = spark.range(50).withColumnRenamed("id", "owner")
    tables.replace_table(df, f"{tmp_path}/t.parquet", ["owner"], 3)
    tables.append_table(df.limit(5), f"{tmp_path}/t.parquet")
    assert tables.read_table(spark, str(tmp_path), "t", df.schema).count() == 55
    assert tables.probe(spark).first().ok == 1
