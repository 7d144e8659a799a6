"""Table schemas, with what a list request needs to know of their columns in the metadata.

``uuid``: a non-null identifier, matched exactly by filters. Timestamps are naive. Geometry is WKB.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()


def _table(*columns: tuple) -> T.StructType:
    """Columns of (name, type), (name, type, nullable) or (name, type, nullable, metadata)."""
    fields = []
    for name, kind, *rest in columns:
        fields.append(T.StructField(name, kind, rest[0] if rest else True, rest[1] if len(rest) > 1 else None))
    return T.StructType(fields)


_UUID = {"uuid": True}
_FLAGS = [("processing_has_started", _B, False), ("processing_completed_successfully", _B, False)]

TRANSECT = _table(
    ("iterator", _L, False), ("id", _S, False, _UUID), ("name", _S, False), ("description", _S), ("length", _D), ("depth", _D),
    ("created_on", _TS), ("last_updated", _TS), ("geom", T.BinaryType()), ("owner", _S, False, _UUID),
)

INPUT_OBJECT = _table(
    ("iterator", _L, False), ("id", _S, False, _UUID), ("time_added_utc", _TS), ("filename", _S), ("owner", _S, False, _UUID),
    ("size_bytes", _L), ("hash_md5sum", _S), ("notes", _S), ("upload_id", _S), ("fps", _D), ("time_seconds", _D), ("frame_count", _I),
    *_FLAGS, ("processing_message", _S), ("last_part_received_utc", _TS), ("all_parts_received", _B, False), ("transect_id", _S),
    ("parts", T.ArrayType(T.MapType(_S, _S))),
)

LINK = _table(("iterator", _L, False), ("input_object_id", _S, False), ("submission_id", _S, False), ("processing_order", _I, False))

#: The colour is any JSON value, kept as its text.
COVER = _table(("class", _S), ("percentage_cover", _D), ("color", _S))

SUBMISSION = _table(
    ("iterator", _L, False), ("id", _S, False, _UUID), ("time_added_utc", _TS), ("name", _S), ("description", _S), ("comment", _S), *_FLAGS,
    ("fps", _I), ("time_seconds_start", _I), ("time_seconds_end", _I), ("percentage_covers", T.ArrayType(COVER)), ("transect_id", _S),
    ("owner", _S, False, _UUID),
)

RUN_STATUS = _table(
    ("id", _S, False, _UUID), ("submission_id", _S, False), ("kubernetes_pod_name", _S), ("status", _S), ("is_running", _B),
    ("is_successful", _B), ("is_still_kubernetes_resource", _B), ("time_started", _S), ("logs", _S), ("time_added_utc", _TS), ("last_updated", _TS),
)

OBJECT_LISTING = _table(("key", _S, False), ("size", _L), ("last_modified", T.TimestampType()))
POD = _table(("name", _S, False), ("phase", _S), ("start_time", _S))
USER = _table(("id", _S, False, _UUID), ("username", _S), ("email", _S), ("attributes", T.MapType(_S, T.ArrayType(_S))), ("realm_roles", T.ArrayType(_S)))

#: An upload server's webhook.
UPLOAD_EVENT = _table(
    ("Type", _S),
    ("Event", _table(
        ("HTTPRequest", _table(("Header", T.MapType(_S, T.ArrayType(_S))))),
        ("Upload", _table(("ID", _S), ("Size", _L), ("Offset", _L), ("IsPartial", _B), ("MetaData", T.MapType(_S, _S)))),
    )),
    ("received", T.TimestampType()),
    ("sequence", _L),
)
