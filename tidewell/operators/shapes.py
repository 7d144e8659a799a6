"""What each read returns: a page of records with all their relationships nested.

Pages are bounded by their request. Children are cut to those of the page before they are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import line_ends
from .nest import attach_parent, nest_children, with_associations

_GEOJSON = "struct<type: string, coordinates: array<array<double>>>"
_PLACES = {"lat_start": "latitude_start", "lon_start": "longitude_start", "lat_end": "latitude_end", "lon_end": "longitude_end"}


def with_line(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Adds latitude and longitude of a line's start and end, and gives its geometry as GeoJSON text.

    Reads well-known binary, or GeoJSON as text. All are null for anything else.
    """
    if isinstance(df.schema[geom].dataType, T.BinaryType):
        ends = line_ends(F.col(geom))
        out = df.withColumn("__line", ends).withColumns({new: F.col(f"__line.{old}") for old, new in _PLACES.items()})
        return out.withColumn(geom, F.col("__line.geojson")).drop("__line")
    points = F.from_json(geom, _GEOJSON).getField("coordinates")
    end = lambda at, i: F.get(F.try_element_at(points, F.lit(at)), F.lit(i))
    places = {"latitude_start": end(1, 1), "longitude_start": end(1, 0), "latitude_end": end(-1, 1), "longitude_end": end(-1, 0)}
    return df.withColumns(places).withColumn(geom, F.when(points.isNotNull(), F.col(geom)))


def _of_page(children: DataFrame, page: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    keys = page.select(F.col(key).alias("__of")).distinct()
    return children.join(keys, children[foreign] == F.col("__of"), "left_semi")


def submissions_simple(submissions: DataFrame, statuses: DataFrame) -> DataFrame:
    """(id, name, time_added_utc, transect_id, run_status): submissions as a transect lists them."""
    plain = submissions.select("id", "name", "time_added_utc", "transect_id")
    return nest_children(plain, _of_page(statuses, plain, "submission_id"), "submission_id", "id", "run_status", ["id"])


def transect_read(page: DataFrame, inputs: DataFrame, submissions: DataFrame, statuses: DataFrame) -> DataFrame:
    """Transects with their line's ends, input objects and submissions, each with its run statuses."""
    own = _of_page(submissions, page, "transect_id")
    nested = nest_children(with_line(page) if "geom" in page.columns else page, _of_page(inputs, page, "transect_id"), "transect_id", "id", "inputs", ["id"])
    return nest_children(nested, submissions_simple(own, statuses), "transect_id", "id", "submissions", ["id"])


def input_read(page: DataFrame, links: DataFrame, transects: DataFrame) -> DataFrame:
    """Input objects with their links to submissions and their transect."""
    own = _of_page(links, page, "input_object_id")
    nested = nest_children(page, own, "input_object_id", "id", "input_associations", ["submission_id", "processing_order"])
    return attach_parent(nested, transects, "transect_id", "id", "transect")


def submission_read(
    page: DataFrame, statuses: DataFrame, links: DataFrame, inputs: DataFrame, transects: DataFrame, outputs: DataFrame
) -> DataFrame:
    """Submissions with run statuses, input objects in processing order, file outputs and transect."""
    nested = nest_children(page, _of_page(statuses, page, "submission_id"), "submission_id", "id", "run_status", ["id"])
    nested = with_associations(nested, _of_page(links, page, "submission_id"), inputs)
    nested = nest_children(nested, _of_page(outputs, page, "submission_id"), "submission_id", "id", "file_outputs", ["filename"])
    return attach_parent(nested, transects, "transect_id", "id", "transect")


def ordered_inputs(links: DataFrame) -> DataFrame:
    """(submission_id, input_object_ids): the ids of each submission's inputs in processing order, ties by id."""
    ordered = F.sort_array(F.collect_list(F.struct("processing_order", "input_object_id")))
    return links.groupBy("submission_id").agg(F.transform(ordered, lambda x: x["input_object_id"]).alias("input_object_ids"))


def job_log(statuses: DataFrame, pod: str) -> DataFrame:
    """(kubernetes_pod_name, logs) of a job by its pod's name: of its newest status. No row for an unknown pod;
    whose job it is isn't looked at."""
    found = statuses.where(F.col("kubernetes_pod_name") == F.lit(pod))
    return found.groupBy("kubernetes_pod_name").agg(F.max_by("logs", F.struct("last_updated", "id")).alias("logs"))
