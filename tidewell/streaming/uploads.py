"""The life of an upload: events folded into one state a object, as a batch and as a stream.

State of an object: message, received (offset), size, all_parts_received, deleted, last_ts, last_seq.
Events count in order of (ts, seq); the service itself lets the last arrival win. Deleted means that a
partial upload finished, or that one was idle for ``timeout`` seconds before it was complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.values import abandon_notice, elapsed_seconds

STATE = (
    "object_id string, message string, received long, size long, all_parts_received boolean, deleted boolean, last_ts timestamp, last_seq long"
)
_MESSAGES = {
    "pre-create": "Upload initiated",
    "post-create": "Upload started",
    "pre-finish": "Upload complete",
    "post-finish": "Upload complete",
}


def fold_uploads(events: DataFrame) -> DataFrame:
    """The final state of every object, as aggregates that are combined before the shuffle.

    The message and progress are the last event's; an upload is complete once a finishing event came.
    """
    at = F.struct("ts", "seq")
    percent = F.bround(F.try_divide("offset", "size") * 100, 2)
    progress = F.coalesce(F.format_string("Upload progress: %.2f%%", percent), F.lit("Upload progress: unknown"))
    progress = F.when(percent.isNull(), F.lit("Upload progress: unknown")).otherwise(progress)
    message = F.when(F.col("kind") == "post-receive", progress)
    for kind, text in _MESSAGES.items():
        message = message.when(F.col("kind") == kind, text)
    gone = (F.col("kind") == "post-finish") & F.col("is_partial")
    done = F.col("kind").isin("pre-finish", "post-finish") & ~gone
    said = events.withColumn("message", message.otherwise(None))
    return said.groupBy("object_id").agg(
        F.max_by("message", at).alias("message"),
        F.max_by("offset", F.when(F.col("offset").isNotNull(), at)).alias("received"),
        F.max_by("size", F.when(F.col("size").isNotNull(), at)).alias("size"),
        F.bool_or(done).alias("all_parts_received"),
        F.bool_or(gone).alias("deleted"),
        F.max(at).getField("ts").alias("last_ts"),
        F.max(at).getField("seq").alias("last_seq"),
    )


def idle_uploads(states: DataFrame, now, timeout: float, notice: float = 60.0) -> DataFrame:
    """Adds idle_seconds, expired (idle for ``timeout`` or longer, incomplete) and notice (over ``notice`` seconds)."""
    idle = elapsed_seconds(F.col("last_ts"), now)
    open_ = ~F.col("all_parts_received") & ~F.col("deleted")
    return states.withColumn("idle_seconds", idle).withColumns(
        {
            "expired": open_ & (F.col("idle_seconds") >= timeout),
            "notice": F.when(open_ & (F.col("idle_seconds") > notice), abandon_notice(F.col("idle_seconds"))),
        }
    )


def follow_uploads(events: DataFrame, timeout_seconds: int, delay: str = "10 seconds") -> DataFrame:
    """The same fold as a stream: a row with the new state whenever an object's events or its timer change it.

    The watermark, ``delay`` behind the latest event, drives the timer; late events within it are put in
    order, and older ones than an object's state don't change its message. A finished or deleted upload is forgotten
    as long after its last event as an open one expires. ``lifecycle`` has the notice too.
    """
    state_type = "message string, received long, size long, done boolean, deleted boolean, ts timestamp, seq long"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, None, None, False, False, None, None]
        if state.hasTimedOut:
            state.remove()
            if not now[3] and not now[4]:
                now[0], now[4] = "Upload timed out", True
                yield _row(key[0], now)
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for r in rows.itertuples():
            here = (r.ts, r.seq)
            newest = now[5] is None or here >= (pd.Timestamp(now[5]), now[6])
            gone = r.kind == "post-finish" and bool(r.is_partial)
            now[3] = now[3] or (r.kind in ("pre-finish", "post-finish") and not gone)
            now[4] = now[4] or gone
            if newest:
                now[0] = message_of(r)
                now[1] = now[1] if pd.isna(r.offset) else int(r.offset)
                now[2] = now[2] if pd.isna(r.size) else int(r.size)
                now[5], now[6] = r.ts.to_pydatetime(), int(r.seq)
        state.update(tuple(now))
        fire = int(pd.Timestamp(now[5]).timestamp() * 1000) + timeout_seconds * 1000
        state.setTimeoutTimestamp(max(fire, state.getCurrentWatermarkMs() + 1))
        yield _row(key[0], now)

    marked = events.where("object_id is not null").withWatermark("ts", delay)
    return marked.groupBy("object_id").applyInPandasWithState(follow, STATE, state_type, "update", GroupStateTimeout.EventTimeTimeout)


def message_of(r) -> str | None:
    if r.kind != "post-receive":
        return _MESSAGES.get(r.kind)
    if pd.isna(r.size) or pd.isna(r.offset) or not r.size:
        return "Upload progress: unknown"
    return f"Upload progress: {r.offset / r.size * 100:.2f}%"


def _row(key: str, now: list) -> pd.DataFrame:
    names = ["message", "received", "size", "all_parts_received", "deleted", "last_ts", "last_seq"]
    row = pd.DataFrame([[key, *now]], columns=["object_id", *names])
    return row.astype({"received": "Int64", "size": "Int64", "last_seq": "Int64"})
