"""Job states from pod snapshots, and reconciliation as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dataflow import reconcile
from ..operators.mutate import upsert
from ..sources.versions import VersionedTable

ACTIVE = ("Pending", "Running")


def final_states(snapshots: DataFrame, now, wait_seconds: int = 120) -> DataFrame:
    """State of each job from (job_id, status, ts, seq) snapshots and (first row) its submission time.

    waiting: no pod yet; timed_out: none for ``wait_seconds``; running: Pending or Running; succeeded,
    failed: anything after. A job whose last snapshot has a null status has lost its pod: Deleted.
    """
    at = F.struct("ts", "seq")
    folded = snapshots.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.count("status").alias("n_seen"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    waited = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    state = (
        F.when((F.col("n_seen") == 0) & (waited >= wait_seconds * 1_000_000), "timed_out")
        .when(F.col("n_seen") == 0, "waiting")
        .when(F.col("status").isin(*ACTIVE), "running")
        .when(F.col("status") == "Succeeded", "succeeded")
        .otherwise("failed")
    )
    return folded.select(
        "job_id",
        state.alias("state"),
        F.when(F.col("n_seen") > 0, F.coalesce("status", F.lit("Deleted"))).alias("status"),
        F.col("status").isin(*ACTIVE).alias("is_running"),
        F.coalesce(F.col("status") == "Succeeded", F.lit(False)).alias("is_successful"),
        F.col("status").isNotNull().alias("is_still_kubernetes_resource"),
    )


JOB = (
    "job_id string, state string, status string, is_running boolean, is_successful boolean, "
    "is_still_kubernetes_resource boolean, last_ts timestamp, last_seq long"
)


def follow_jobs(snapshots: DataFrame, wait_seconds: int = 120, delay: str = "10 seconds") -> DataFrame:
    """The same states as a stream: a row whenever a job's snapshots or its timer change them.

    The watermark, ``delay`` behind the latest snapshot, drives the timer. A job without a pod for
    ``wait_seconds`` is timed out and forgotten; one that ended is forgotten as long after its last snapshot.
    """
    kept = "status string, seen boolean, first timestamp, ts timestamp, seq long"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, False, None, None, None]
        if state.hasTimedOut:
            state.remove()
            if not now[1]:
                yield _job(key[0], "timed_out", now)
            return
        for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples():
            status, ts = None if pd.isna(r.status) else r.status, r.ts.to_pydatetime()
            now[1] = now[1] or status is not None
            now[2] = ts if now[2] is None else min(now[2], ts)
            if now[3] is None or (ts, int(r.seq)) >= (now[3], now[4]):
                now[0], now[3], now[4] = status, ts, int(r.seq)
        state.update(tuple(now))
        name = "waiting" if not now[1] else "running" if now[0] in ACTIVE else "succeeded" if now[0] == "Succeeded" else "failed"
        if name != "running":
            fire = int((pd.Timestamp(now[3] if now[1] else now[2]).timestamp() + wait_seconds) * 1000)
            state.setTimeoutTimestamp(max(fire, state.getCurrentWatermarkMs() + 1))
        yield _job(key[0], name, now)

    marked = snapshots.where("job_id is not null").withWatermark("ts", delay)
    return marked.groupBy("job_id").applyInPandasWithState(follow, JOB, kept, "update", GroupStateTimeout.EventTimeTimeout)


def _job(key: str, name: str, now: list) -> pd.DataFrame:
    status, seen, _, ts, seq = now
    shown = status if status is not None else "Deleted" if seen else None
    running = None if status is None else status in ACTIVE
    row = [key, name, shown, running, status == "Succeeded", status is not None, ts, seq]
    return pd.DataFrame([row], columns=[c.split()[0] for c in JOB.split(", ")]).astype({"is_running": "boolean"})


def keep_reconciled(snapshots: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None]) -> DataStreamWriter:
    """A stream writer that reconciles the run statuses with each batch's newest complete snapshot.

    ``snapshots`` has (taken, succeeded, name); a batch without a complete one changes nothing. ``save``
    must put the new state beside the old one, as the batch reads what it replaces.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        del batch_id
        complete = batch.where("succeeded").persist()
        newest = complete.agg(F.max("taken")).first()[0]
        if newest is not None:
            pods = complete.where((F.col("taken") == F.lit(newest)) & F.col("name").isNotNull())
            save(reconcile(load(), pods.select("name")))
        complete.unpersist()

    return snapshots.writeStream.outputMode("append").foreachBatch(each)


def upsert_stream(states: DataFrame, key: str, load: Callable[[], DataFrame], save: Callable[[DataFrame], None]) -> DataStreamWriter:
    """A stream writer that puts each key's newest state into a table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        del batch_id
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("last_ts", "last_seq")).alias("s")).select(key, "s.*")
        save(upsert(load(), last, key))

    return states.writeStream.outputMode("update").foreachBatch(each)


def keep_reconciled_once(snapshots: DataFrame, table: VersionedTable, stream: str, key: str = "id") -> DataStreamWriter:
    """``keep_reconciled`` into a versioned table: rows whose state doesn't change stay in their files, and a batch that
    is run again changes nothing. ``stream`` names the stream in the table's ledger."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if table.has(stream, batch_id):
            return
        complete = batch.where("succeeded").persist()
        newest = complete.agg(F.max("taken")).first()[0]
        changed = table.read().limit(0)
        if newest is not None:
            pods = complete.where((F.col("taken") == F.lit(newest)) & F.col("name").isNotNull())
            held = table.read()
            # Only a row that is marked now differs from before.
            changed = reconcile(held.where("is_still_kubernetes_resource"), pods.select("name")).where("not is_still_kubernetes_resource")
        table.upsert(changed, key, stream=stream, batch=batch_id)
        complete.unpersist()

    return snapshots.writeStream.outputMode("append").foreachBatch(each)


def upsert_stream_once(states: DataFrame, key: str, table: VersionedTable, stream: str) -> DataStreamWriter:
    """``upsert_stream`` into a versioned table, by the same ledger. A state older than the table's is left out, so
    that batches may be dealt anew after a restart."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if table.has(stream, batch_id):
            return
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("last_ts", "last_seq")).alias("s")).select(key, "s.*")
        at = F.struct("last_ts", "last_seq")
        held = table.read().select(F.col(key).alias("__key"), at.alias("__at"))
        joined = last.withColumn("__new", at).join(held, F.col(key) == F.col("__key"), "left")
        newer = joined.where("__at is null or __new >= __at").drop("__key", "__at", "__new")
        table.upsert(newer, key, stream=stream, batch=batch_id)

    return states.writeStream.outputMode("update").foreachBatch(each)
