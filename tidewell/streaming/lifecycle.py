"""The life of an upload as a stream with several timers a key: notice, expiry, and forgetting.

Each object has one state and up to three timers in event time, kept by Spark's state store:

- notice: ``notice_seconds`` after its last event it seems abandoned; the notice's text counts the seconds;
- expiry: ``timeout_seconds`` after its last event an incomplete upload is deleted;
- forgetting: ``keep_seconds`` after it was finished or deleted, the state goes. Until then, events that come late
  find it, so that a finished upload doesn't begin anew.

Timers fire once the watermark passes them; a timer that an event has outdated is deleted when that event comes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .uploads import message_of

OUTPUT = (
    "object_id string, event string, message string, received long, size long, all_parts_received boolean, deleted boolean, "
    "last_ts timestamp, last_seq long"
)
KEPT = "message string, received long, size long, done boolean, deleted boolean, last_ms long, last_seq long, notice_ms long, expiry_ms long, forget_ms long"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_FIELDS = [c.split()[0] for c in KEPT.split(", ")]


class UploadLife(StatefulProcessor):
    def __init__(self, timeout_seconds: float, notice_seconds: float = 60, keep_seconds: float = 3600):
        self.timeout, self.wait, self.keep = (int(x * 1000) for x in (timeout_seconds, notice_seconds, keep_seconds))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", KEPT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        now: dict[str, Any] = dict(zip(_FIELDS, known, strict=True)) if known else dict.fromkeys(_FIELDS) | {"done": False, "deleted": False}
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            gone = r.kind == "post-finish" and bool(r.is_partial)
            now["done"] = now["done"] or (r.kind in ("pre-finish", "post-finish") and not gone)
            at = (_ms(r.ts), int(r.seq))
            # What happened to a deleted upload can't bring it back, nor can old news change its message.
            if not (now["deleted"] and not gone) and (now["last_ms"] is None or at >= (now["last_ms"], now["last_seq"])):
                now["message"] = message_of(r)
                now["received"] = now["received"] if pd.isna(r.offset) else int(r.offset)
                now["size"] = now["size"] if pd.isna(r.size) else int(r.size)
                now["last_ms"], now["last_seq"] = at
            now["deleted"] = now["deleted"] or gone
        self._set_timers(now, int(timerValues.getCurrentWatermarkInMs()))
        self.state.update(tuple(now[f] for f in _FIELDS))
        yield _row(key[0], "event", now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if not known:
            return
        now, at = dict(zip(_FIELDS, known, strict=True)), int(expiredTimerInfo.getExpiryTimeInMs())
        watermark = int(timerValues.getCurrentWatermarkInMs())
        if at == now["forget_ms"]:
            self.state.clear()
            return
        if at == now["notice_ms"]:
            now["notice_ms"] = None
            if not (now["done"] or now["deleted"]):
                # As many seconds as the watermark says; a check that comes late says how late.
                idle = math.ceil((min(watermark, now["expiry_ms"] or watermark) - now["last_ms"]) / 1000)
                now["message"] = f"Upload seems abandoned: no data for {idle} seconds"
                yield _row(key[0], "notice", now)
        if at == now["expiry_ms"]:
            now["expiry_ms"] = None
            if not (now["done"] or now["deleted"]):
                now["message"], now["deleted"] = "Upload timed out", True
                self._set_timers(now, watermark)
                yield _row(key[0], "expired", now)
        self.state.update(tuple(now[f] for f in _FIELDS))

    def _set_timers(self, now: dict[str, Any], watermark: int) -> None:
        over = now["done"] or now["deleted"]
        last = now["last_ms"]
        wanted = {
            "notice_ms": None if over or self.wait >= self.timeout else last + self.wait,
            "expiry_ms": None if over else last + self.timeout,
            "forget_ms": max(last, watermark) + self.keep if over else None,
        }
        for name, ms in wanted.items():
            if ms is not None:
                ms = max(ms, watermark + 1)  # a timer in the past would never fire
            if now[name] is not None and now[name] != ms:
                self.handle.deleteTimer(now[name])
                now[name] = None
        for name, ms in wanted.items():
            if ms is not None:
                now[name] = max(ms, watermark + 1)
                while sum(now[other] == now[name] for other in wanted) > 1:
                    now[name] += 1  # one timer a millisecond
                self.handle.registerTimer(now[name])


def follow_life(
    events: DataFrame, timeout_seconds: float, notice_seconds: float = 60, keep_seconds: float = 3600, delay: str = "10 seconds"
) -> DataFrame:
    """A row whenever an object's events or its timers change it; column event says which: event, notice, expired.

    ``events`` has (object_id, kind, ts, seq, offset, size, is_partial); rows without an object are left out. The
    watermark is ``delay`` behind the latest event. Needs the RocksDB state store, see ``use_rocksdb``.
    """
    marked = events.where("object_id is not null").withWatermark("ts", delay)
    life = UploadLife(timeout_seconds, notice_seconds, keep_seconds)
    return marked.groupBy("object_id").transformWithStateInPandas(life, OUTPUT, "Update", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that states with timers need; it keeps states on disk, so that they may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(ts: Any) -> int:
    ts = pd.Timestamp(ts)
    ts = ts.tz_localize("UTC") if ts.tzinfo is None else ts
    return int(ts.timestamp() * 1000)


def _row(key: str, event: str, now: dict[str, Any]) -> pd.DataFrame:
    at = None if now["last_ms"] is None else pd.Timestamp(now["last_ms"], unit="ms", tz=timezone.utc).tz_localize(None)
    row = [key, event, now["message"], now["received"], now["size"], now["done"], now["deleted"], at, now["last_seq"]]
    return pd.DataFrame([row], columns=_COLUMNS).astype({"received": "Int64", "size": "Int64", "last_seq": "Int64"})
