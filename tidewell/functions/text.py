"""Text and identifier functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def basename(key: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(key, "/", -1)


def strip_pod_suffix(name: Column) -> Column:
    """Without the last two dash-separated parts; empty if there are no more."""
    parts = F.split(name, "-")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "-")


def submission_id_of(job: Column) -> Column:
    """The id within a job's name ``<prefix>-<uuid>-<number>``; empty without one."""
    return F.regexp_extract(job, f"({UUID})", 1)


def object_id_of(upload: Column, prefix: str = "inputs/") -> Column:
    """What stands between the prefix and the first plus sign of an upload id; null without the prefix."""
    rest = F.try_element_at(F.split(upload, F.lit(prefix)), F.lit(2))
    return F.substring_index(rest, "+", 1)


def without_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(""))


def clean_log(log: Column) -> Column:
    """Of each line what follows its last carriage return, as a terminal would show it."""
    return F.array_join(F.transform(F.split(log, "\n"), lambda x: F.substring_index(x, "\r", -1)), "\n")


def login_method(attributes: Column, default: str = "default") -> Column:
    """The first login-method attribute in upper case, else the default's."""
    return upper_or(F.get(F.try_element_at(attributes, F.lit("login-method")), F.lit(0)), default)


def upper_or(text: Column, default: str) -> Column:
    return F.upper(F.coalesce(text, F.lit(default)))


def object_key(*parts: Column | str) -> Column:
    """Parts of a key or URL, joined by slashes."""
    return F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def job_name(prefix: str, submission: Column, seed: int | None = None) -> Column:
    """``<prefix>-<id>-<five digits>``; the digits are random."""
    number = F.floor(F.rand(seed) * 90_000 + 10_000) if seed is not None else F.floor(F.rand() * 90_000 + 10_000)
    return F.concat_ws("-", F.lit(prefix), submission, number.cast("string"))


def bearer_token(header: Column) -> Column:
    return F.try_element_at(F.split(header, "Bearer "), F.lit(2))


def is_uuid(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(f"^{UUID}$"), F.lit(False))


def allowed_file(filename: Column, kinds: tuple[str, ...]) -> Column:
    """Whether the extension, whatever its case, is in the list."""
    return F.lower(F.substring_index(filename, ".", -1)).isin(*kinds)


def name_id(namespace: str, *parts: Column) -> Column:
    """A name-based id (version 5) of a namespace's id and a name, the parts joined by ``/``: the same wherever and
    whenever it is made, so that a task that is run again makes no second one. Null if a part is."""
    name = F.concat(*(x for i, p in enumerate(parts) for x in ((F.lit("/"), p.cast("string")) if i else (p.cast("string"),))))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    third, fourth = F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, fourth, F.substring(h, 21, 12))
    return F.when(name.isNotNull(), made)
