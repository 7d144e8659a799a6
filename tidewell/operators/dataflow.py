"""The dataflow around the tables: covers and colours, roles, reconciliation, references, usage, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_pod_suffix

#: Sorts before every ISO time when falling: a run that hasn't started comes first.
NOT_STARTED = "9999-00-00T00:00:00Z"


def covers_with_colours(covers: Column, colours: Column) -> Column:
    """Map of class to percentage and map of class to colour, as an array of (class, percentage_cover, color);
    the colour is null where its map lacks the class."""
    return F.transform(
        F.map_entries(covers),
        lambda e: F.struct(
            e["key"].alias("class"), e["value"].alias("percentage_cover"), F.try_element_at(colours, e["key"]).alias("color")
        ),
    )


def merge_roles(members: DataFrame, user: str = "id", role: str = "role", admin: str = "admin") -> DataFrame:
    """(user, is_admin, is_user) once a user, from role memberships; being admin in any row wins."""
    return members.groupBy(user).agg(
        F.bool_or(F.coalesce(F.col(role) == admin, F.lit(False))).alias("is_admin"),
        F.lit(True).alias("is_user"),
    )


def last_writer(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row a key: the one that ``by`` puts last."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__last"))
    return last.select(*key, *(F.col(f"__last.{c}").alias(c) for c in rest)).select(*df.columns)


def reconcile(statuses: DataFrame, snapshot: DataFrame, succeeded: Column | bool = True, pod: str = "kubernetes_pod_name") -> DataFrame:
    """Marks live run statuses whose pod isn't in the snapshot as Deleted; one without a pod's name stays as it is.

    Only if the snapshot was taken in full (``succeeded``): an empty one that comes of a failure proves nothing.
    """
    live = snapshot.select(strip_pod_suffix(F.col("name")).alias("__pod")).unionByName(snapshot.select(F.col("name").alias("__pod"))).distinct()
    joined = statuses.join(live, statuses[pod] == F.col("__pod"), "left")
    took = succeeded if isinstance(succeeded, Column) else F.lit(succeeded)
    gone = F.col(pod).isNotNull() & F.col("__pod").isNull() & F.coalesce("is_still_kubernetes_resource", F.lit(False)) & took
    new = {
        "status": F.when(gone, "Deleted").otherwise(F.col("status")),
        "is_running": F.when(gone, False).otherwise(F.col("is_running")),
        "is_still_kubernetes_resource": F.when(gone, False).otherwise(F.col("is_still_kubernetes_resource")),
    }
    return joined.withColumns(new).drop("__pod")


def check_references(
    links: DataFrame, inputs: DataFrame, foreign: str, key: str, own_parent: Column, input_parent: str, name: str = "verdict"
) -> DataFrame:
    """Adds ``missing`` where the input doesn't exist, ``mismatch`` where its parent isn't the link's own (two
    nulls agree), else ``ok``."""
    found = inputs.select(F.col(key).alias("__key"), F.col(input_parent).alias("__parent"))
    joined = links.withColumn("__own", own_parent).join(found, F.col(foreign) == F.col("__key"), "left")
    verdict = (
        F.when(F.col("__key").isNull(), "missing").when(~F.col("__own").eqNullSafe(F.col("__parent")), "mismatch").otherwise("ok")
    )
    return joined.withColumn(name, verdict).drop("__key", "__parent", "__own")


def prefix_usage(listing: DataFrame, prefixes: dict[str, str], key: str = "key", size: str = "size") -> DataFrame:
    """One row: per prefix name, ``<name>_count`` and ``<name>_bytes``; all prefixes in one pass."""
    out = []
    for name, prefix in prefixes.items():
        hit = F.col(key).startswith(prefix)
        out += [F.count_if(hit).alias(f"{name}_count"), F.coalesce(F.sum(F.when(hit, F.col(size))), F.lit(0)).alias(f"{name}_bytes")]
    return listing.agg(*out)


def status_rank(df: DataFrame, by: str, time: str, tie: str, name: str = "rank") -> DataFrame:
    """Ranks each group's run statuses: latest first, those that haven't started (null or empty) before all."""
    started = F.coalesce(F.nullif(F.col(time), F.lit("")), F.lit(NOT_STARTED))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(started.desc(), F.col(tie).asc())))


def latest(df: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    """The last row of each group, ties by the larger ``tie``; combined before the shuffle."""
    return last_writer(df, [by], [time, tie])


def processing_rank(links: DataFrame, by: str, order: list[str], name: str = "position") -> DataFrame:
    return links.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def role_changes(current: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``requested`` to add and of ``current`` to delete, as column action."""
    add = requested.select(*keys).exceptAll(current.select(*keys)).distinct().withColumn("action", F.lit("add"))
    delete = current.select(*keys).exceptAll(requested.select(*keys)).distinct().withColumn("action", F.lit("delete"))
    return add.unionByName(delete)


def kept_roles(current: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    return current.select(*keys).intersect(allowed.select(*keys))


def file_gate(listing: DataFrame, by: str, filename: str, needed: tuple[str, ...]) -> DataFrame:
    """(by, complete): whether all needed files are there."""
    every = F.lit(True)
    for name in needed:
        every = every & F.bool_or(F.col(filename) == name)
    return listing.groupBy(by).agg(every.alias("complete"))


def pods_of(pods: DataFrame, submissions: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Pods with the submission whose id their name holds: by the extracted id, hence an equi-join."""
    from ..functions.text import submission_id_of

    return pods.withColumn("__id", submission_id_of(F.col(name))).join(submissions, F.col("__id") == submissions[key]).drop("__id")


def containing(df: DataFrame, words: DataFrame, text: str, word: str) -> DataFrame:
    """Pairs of rows and words that a text holds literally; for word lists small enough to broadcast, which
    Spark decides by their size. ``substrings.texts_with_words`` is for two large sides."""
    return df.join(words, F.contains(F.col(text), F.col(word)))
