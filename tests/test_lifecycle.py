import datetime as dt
import json
import os

import pytest

from tidewell.streaming import lifecycle

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "object_id string, kind string, ts timestamp, seq long, offset long, size long, is_partial boolean"


class Source:
    """A folder of events, read file by file in the order in which they were put."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, str(root), 0
        os.mkdir(f"{self.root}/in")

    def put(self, *events):
        path = f"{self.root}/in/{self.n:04d}.json"
        lines = [dict(zip(("object_id", "kind", "ts", "seq", "offset", "size", "is_partial"), e, strict=False)) for e in events]
        for x in lines:
            x["ts"] = (T0 + dt.timedelta(seconds=x["ts"])).isoformat() + "Z"
        with open(path, "w") as f:
            f.write("\n".join(map(json.dumps, lines)))
        os.utime(path, (1_700_000_000 + self.n,) * 2)
        self.n += 1

    def run(self):
        """Reads what is new, from the checkpoint of the last run; (object, event, message, deleted) of all rows, and
        the number of states left."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{self.root}/in")
        out = lifecycle.follow_life(stream, timeout_seconds=300, keep_seconds=600, delay="10 seconds")
        rows = []

        def each(batch, batch_id):
            rows.extend((r.object_id, r.event, r.message, r.deleted, r.all_parts_received) for r in batch.collect())

        started = out.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{self.root}/c").trigger(availableNow=True).start()
        started.awaitTermination(180)
        left = [p.stateOperators[0].numRowsTotal for p in started.recentProgress if p.stateOperators]
        return rows, left[-1] if left else None


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    lifecycle.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def test_notice_expiry_completion_late_events_and_restart(rocks, tmp_path):
    source = Source(rocks, tmp_path)
    source.put(("idle", "post-create", 0, 1, None, 100, False), ("ok", "post-create", 0, 2, None, 100, False), ("part", "post-create", 1, 3, None, 9, False))
    source.put(("idle", "post-receive", 5, 4, 50, 100, False), ("ok", "post-finish", 6, 5, 100, 100, False), ("part", "post-finish", 6, 6, 9, 9, True))
    source.put(("clock", "pre-create", 90, 7, None, 1, False))  # the watermark passes 65: notice
    source.put(("clock", "post-receive", 91, 8, 1, 1, False))
    rows, _ = source.run()
    mine = lambda rows, k: [r[1:] for r in rows if r[0] == k]
    assert [r[0] for r in mine(rows, "idle")] == ["event", "event", "notice"]
    assert mine(rows, "idle")[1][1] == "Upload progress: 50.00%"
    assert mine(rows, "idle")[2][1].startswith("Upload seems abandoned: no data for 7")
    assert [r[0] for r in mine(rows, "ok")] == ["event", "event"] and mine(rows, "ok")[-1][1:] == ("Upload complete", False, True)
    assert mine(rows, "part")[-1][2]

    # After a restart: data comes again, which takes the notice back and moves both timers.
    source.put(("idle", "post-receive", 95, 9, 60, 100, False), ("ok", "post-receive", 85, 10, 70, 100, False))
    source.put(("clock", "post-receive", 200, 11, 1, 1, False))
    source.put(("clock", "post-receive", 201, 12, 1, 1, False))
    rows, _ = source.run()
    assert [r[0] for r in mine(rows, "idle")] == ["event", "notice"]
    # A late event of a finished upload finds its state: it stays finished.
    assert mine(rows, "ok") == [("event", "Upload progress: 70.00%", False, True)]

    # Nothing more for 300 seconds: expired; then everything is forgotten.
    source.put(("clock", "post-finish", 420, 13, 1, 1, False))
    source.put(("tick", "post-finish", 421, 14, 1, 1, False))
    rows, left = source.run()
    assert mine(rows, "idle") == [("expired", "Upload timed out", True, False)]
    assert not [r for r in rows if r[0] in ("ok", "part")]
    assert left > 0
    source.put(("tick", "post-finish", 3000, 15, 1, 1, False))
    source.put((None, "post-finish", 9000, 16, 1, 1, False), ("end", "post-finish", 3001, 17, 1, 1, False))
    source.put(("end", "post-finish", 9000, 18, 1, 1, False))
    source.put(("end", "post-finish", 9001, 19, 1, 1, False))
    rows, left = source.run()
    assert {r[0] for r in rows} == {"tick", "end"}
    # What is left is the last object's own state and timers; all others are gone.
    source.put(("last", "post-finish", 20_000, 20, 1, 1, False))
    source.put(("last", "post-finish", 20_001, 21, 1, 1, False))
    _, left_again = source.run()
    assert left_again <= left <= 4


def test_an_upload_that_outruns_its_notice(rocks, tmp_path):
    """No notice if the upload goes on in time, none after it ended, and none if expiry comes before it."""
    source = Source(rocks, tmp_path)
    for i in range(6):
        source.put(("a", "post-receive", 40 * i, i, i, 10, False))
    source.put(("a", "post-finish", 230, 9, 10, 10, False))
    source.put(("clock", "post-create", 400, 10, None, 1, False))
    source.put(("clock", "post-create", 401, 11, None, 1, False))
    rows, _ = source.run()
    assert {r[1] for r in rows if r[0] == "a"} == {"event"}
