"""Numbers, times, JSON and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FPS = 15


def time_range(n_inputs: Column, start: Column, end: Column) -> Column:
    """``s-e`` for one input, else ``s-end,begin-e``; a missing bound reads None."""
    s, e = (F.coalesce(x.cast("string"), F.lit("None")) for x in (start, end))
    return F.when(n_inputs == 1, F.concat(s, F.lit("-"), e)).otherwise(F.concat(s, F.lit("-end,begin-"), e))


def upload_percent(offset: Column, size: Column) -> Column:
    """``Upload progress: p%`` with two digits; null for an empty upload."""
    return F.format_string("Upload progress: %.2f%%", F.bround(F.try_divide(offset, size) * 100, 2))


def elapsed_seconds(since: Column, now: Column) -> Column:
    """Seconds, with their fraction, between two naive or two zoned times."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return (micros(now) - micros(since)) / 1_000_000


def abandon_notice(elapsed: Column) -> Column:
    return F.concat(F.lit("Upload seems abandoned: no data for "), F.ceil(elapsed).cast("string"), F.lit(" seconds"))


def rounded_fps(fps: Column) -> Column:
    return F.bround(fps, 2)


def duration(frames: Column, fps: Column) -> Column:
    """Seconds of a video, from the rounded frame rate; null at rate 0."""
    return F.bround(F.try_divide(frames, rounded_fps(fps)), 2)


def or_default(value: Column, default) -> Column:
    """The default where the value is null or zero."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_expired(expiry_epoch: Column, now: Column) -> Column:
    return F.timestamp_seconds(expiry_epoch) < now


def expiry(now: Column, hours: int) -> Column:
    return now + F.make_dt_interval(hours=F.lit(hours))


def window_is_valid(start: Column, end: Column, n_inputs: Column) -> Column:
    """Bounds aren't negative, and start precedes end if both are set (not 0) and there are fewer than two inputs."""
    fine = lambda x: F.coalesce(x >= 0, F.lit(True))
    both = (F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0)
    return fine(start) & fine(end) & (~both | (n_inputs >= 2) | (start < end))


def derived_status(status: Column, is_resource: Column) -> Column:
    """The pod's status while it exists, else Deleted."""
    return F.when(is_resource, status).otherwise("Deleted")


def widen_to_int(value: Column) -> Column:
    """A double as an integer, to the nearest even as a database rounds."""
    return F.rint(value).cast("int")
