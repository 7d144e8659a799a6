import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import constraints, dataflow, mutate, nest


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "transects": make([("t1", "reef"), ("t2", "bay")], "id string, name string"),
        "submissions": make([("s1", "t1"), ("s2", "t9"), ("s3", None)], "id string, transect_id string"),
        "inputs": make([("i1", "a.mp4", "t1"), ("i2", "b.mp4", "t2"), ("i3", "c.mp4", None)], "id string, filename string, transect_id string"),
        "links": make([("s1", "i2", 1), ("s1", "i1", 0), ("s2", "i3", 0), ("s2", "i8", 1)], "submission_id string, input_object_id string, processing_order int"),
    }


def test_parent_as_struct(tables):
    rows = {r.id: r.parent for r in nest.attach_parent(tables["submissions"], tables["transects"], "transect_id").collect()}
    assert rows["s1"].name == "reef" and rows["s2"] is None and rows["s3"] is None


def test_children_as_arrays(tables):
    rows = {r.id: r for r in nest.nest_children(tables["submissions"], tables["links"], "submission_id", order=["processing_order"]).collect()}
    assert [c.input_object_id for c in rows["s1"].children] == ["i1", "i2"] and rows["s3"].children == []
    full = {r.id: r.input_associations for r in nest.with_associations(tables["submissions"], tables["links"], tables["inputs"]).collect()}
    assert [(c.processing_order, c.input_object and c.input_object.filename) for c in full["s2"]] == [(0, "c.mp4"), (1, None)]


def test_two_nests_do_not_multiply(tables):
    both = nest.nest_children(tables["transects"], tables["inputs"], "transect_id", name="inputs")
    both = nest.nest_children(both, tables["submissions"], "transect_id", name="submissions")
    assert {r.id: (len(r.inputs), len(r.submissions)) for r in both.collect()} == {"t1": (1, 1), "t2": (1, 0)}


def test_many_to_many(tables):
    again = tables["links"].union(tables["links"])
    nested = nest.nest_linked(tables["submissions"], again, tables["inputs"], "id", "submission_id", "input_object_id", "id", "inputs")
    assert {r.id: [x.id for x in r.inputs] for r in nested.collect()} == {"s1": ["i1", "i2"], "s2": ["i3"], "s3": []}


def test_covers_with_colours(spark):
    df = spark.sql("select map('coral', 0.5D, 'sand', 0.25D) c, map('coral', '[1,2,3]') k")
    (row,) = df.select(dataflow.covers_with_colours(F.col("c"), F.col("k")).alias("x")).collect()
    assert sorted(map(tuple, row.x)) == [("coral", 0.5, "[1,2,3]"), ("sand", 0.25, None)]


def test_roles(spark):
    members = spark.createDataFrame([("a", "user"), ("a", "admin"), ("b", "user"), ("c", None)], "id string, role string")
    assert {r.id: r.is_admin for r in dataflow.merge_roles(members).collect()} == {"a": True, "b": False, "c": False}
    current, wanted = (spark.createDataFrame([(x,) for x in v], "role string") for v in (["user", "other"], ["user", "admin"]))
    assert sorted(map(tuple, dataflow.role_changes(current, wanted, ["role"]).collect())) == [("admin", "add"), ("other", "delete")]
    assert [r.role for r in dataflow.kept_roles(current, wanted, ["role"]).collect()] == ["user"]


def statuses(spark):
    rows = [("1", "job-1", "Running", True, True), ("2", "job-2", "Running", True, True), ("3", "job-3", "Succeeded", False, False), ("4", None, None, True, None)]
    return spark.createDataFrame(rows, "id string, kubernetes_pod_name string, status string, is_running boolean, is_still_kubernetes_resource boolean")


def test_reconciliation_needs_a_whole_snapshot(spark):
    pods = spark.createDataFrame([("job-1-0-0",)], "name string")
    found = {r.id: (r.status, r.is_running, r.is_still_kubernetes_resource) for r in dataflow.reconcile(statuses(spark), pods).collect()}
    assert found == {"1": ("Running", True, True), "2": ("Deleted", False, False), "3": ("Succeeded", False, False), "4": (None, True, None)}
    failed = dataflow.reconcile(statuses(spark), pods.limit(0), succeeded=False)
    assert sorted(map(tuple, failed.collect()), key=str) == sorted(map(tuple, statuses(spark).collect()), key=str)
    assert {r.status for r in dataflow.reconcile(statuses(spark), pods.limit(0)).where("id < '3'").collect()} == {"Deleted"}


def test_references_are_null_safe(spark, tables):
    links = spark.createDataFrame([("i1", "t1"), ("i1", "t2"), ("i3", None), ("i3", "t1"), ("i9", None)], "input string, transect string")
    found = dataflow.check_references(links, tables["inputs"], "input", "id", F.col("transect"), "transect_id").collect()
    assert {(r.input, r.transect): r.verdict for r in found} == {
        ("i1", "t1"): "ok", ("i1", "t2"): "mismatch", ("i3", None): "ok", ("i3", "t1"): "mismatch", ("i9", None): "missing",
    }


def test_usage_orders_and_gates(spark):
    listing = spark.createDataFrame([("p/inputs/a", 3), ("p/outputs/b", 4), ("p/x", 5), ("q", 9)], "key string, size long")
    assert dataflow.prefix_usage(listing, {"inputs": "p/inputs/", "outputs": "p/outputs/", "total": "p/"}).first().asDict() == {
        "inputs_count": 1, "inputs_bytes": 3, "outputs_count": 1, "outputs_bytes": 4, "total_count": 3, "total_bytes": 12,
    }
    assert dataflow.prefix_usage(listing.limit(0), {"a": "x"}).first() == (0, 0)
    runs = spark.createDataFrame([(1, "a", "2024-01-02T00:00:00Z"), (1, "b", None), (1, "c", ""), (1, "d", "2024-01-03T00:00:00Z")], "s int, id string, t string")
    assert [r.id for r in dataflow.status_rank(runs, "s", "t", "id").orderBy("rank").collect()] == ["b", "c", "d", "a"]
    assert dataflow.latest(runs.where("t > ''"), "s", "t", "id").first().id == "d"
    files = spark.createDataFrame([(1, "x.json"), (1, "y.json"), (2, "x.json")], "s int, f string")
    assert dict(map(tuple, dataflow.file_gate(files, "s", "f", ("x.json", "y.json")).collect())) == {1: True, 2: False}


def test_pods_by_the_id_in_their_name(spark):
    uuid = "0123abcd-0123-4567-89ab-0123456789ab"
    pods = spark.createDataFrame([(f"job-{uuid}-12345-0-0",), ("job-x",)], "name string")
    found = dataflow.pods_of(pods, spark.createDataFrame([(uuid,)], "id string")).collect()
    assert [(r.name, r.id) for r in found] == [(f"job-{uuid}-12345-0-0", uuid)]


def test_mutations(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, None, 3.5)], "id int, name string, x double")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    new = spark.createDataFrame([(4,)], "id int")
    assert rows(mutate.insert(df, new, {"name": F.lit("new")}))[-1] == (4, "new", None)
    assert rows(mutate.update_where(df, F.col("x") > 1, {"name": F.lit("z")})) == [(1, "z", 1.5), (2, "b", None), (3, "z", 3.5)]
    patches = spark.createDataFrame([(1, None, 9.0, ["name"]), (2, "q", 7.0, ["x"]), (3, "w", 0.0, [])], "id int, name string, x double, set_fields array<string>")
    assert rows(mutate.patch(df, patches, "id")) == [(1, None, 1.5), (2, "b", 7.0), (3, None, 3.5)]
    assert rows(mutate.delete_where(df, F.col("x") > 2)) == [(1, "a", 1.5), (2, "b", None)]
    assert rows(mutate.delete_keys(df, spark.createDataFrame([(1,), (1,), (None,)], "id int"), "id")) == [(2, "b", None), (3, None, 3.5)]
    assert rows(mutate.upsert(df, spark.createDataFrame([(2, "B", 0.0), (9, "n", 1.0)], df.schema), "id"))[1] == (2, "B", 0.0)
    assert mutate.change_type(df, "x", "int").orderBy("id").collect()[0].x == 2
    assert mutate.add_column(df, "fps", "int", 15).first().fps == 15 and mutate.add_column(df, "name", "int") is df
    cleared = mutate.clear_parent(df.withColumn("p", F.col("id")), spark.createDataFrame([(2,)], "id int"), "p")
    assert {r.id: r.p for r in cleared.collect()} == {1: 1, 2: None, 3: 3}


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", -1.0), (1, None, 0.0), (2, "b", None)], "k int, f string, x double")
    assert [tuple(r) for r in constraints.duplicate_keys(df, ["k", "f"]).collect()] == [(1, "a", 2)]
    assert [r.f for r in constraints.orphans(df, "f", spark.createDataFrame([("a",)], "id string"), "id").collect()] == ["b"]
    assert constraints.negative(df, ["x"]).count() == 1 and constraints.missing(df, ["f", "x"]).count() == 2


def test_schemas_name_the_identifiers():
    assert [f.name for f in schemas.SUBMISSION if f.metadata.get("uuid")] == ["id", "owner"]
    assert not schemas.LINK["processing_order"].nullable


def test_reconciliation_leaves_a_status_without_a_pod(spark):
    rows = [("1", None, "Running", True, True), ("2", "gone", "Running", True, True)]
    live = spark.createDataFrame(rows, "id string, kubernetes_pod_name string, status string, is_running boolean, is_still_kubernetes_resource boolean")
    pods = spark.createDataFrame([("job-x",)], "name string")
    assert {r.id: r.status for r in dataflow.reconcile(live, pods).collect()} == {"1": "Running", "2": "Deleted"}


def test_lines_of_either_geometry(spark):
    from tidewell.functions.geo import encode_line
    from tidewell.operators.shapes import with_line

    wkb = spark.createDataFrame([(1, encode_line([(5.0, 46.0), (6.0, 47.0), (7.5, 48.0)])), (2, b"no"), (3, None)], "id int, geom binary")
    text = with_line(wkb).select("id", "geom")
    for df in (with_line(wkb), with_line(text)):
        found = {r.id: (r.latitude_start, r.longitude_start, r.latitude_end, r.longitude_end, r.geom and r.geom[:21]) for r in df.collect()}
        assert found == {1: (46.0, 5.0, 48.0, 7.5, '{"type": "LineString"'), 2: (None,) * 5, 3: (None,) * 5}


def test_reads_of_records_without_relatives(spark):
    from tidewell import schemas as s
    from tidewell.operators import shapes

    empty = lambda schema: spark.createDataFrame([], schema)
    outputs = empty("submission_id string, filename string, size_bytes long, url string")
    page = spark.createDataFrame([("s1", "t1"), ("s2", None)], "id string, transect_id string")
    transects = spark.createDataFrame([("t1", "north")], "id string, name string")
    read = shapes.submission_read(page, empty(s.RUN_STATUS), empty(s.LINK), empty(s.INPUT_OBJECT), transects, outputs).orderBy("id").collect()
    assert [(r.id, r.run_status, r.input_associations, r.file_outputs, r.transect and r.transect.name) for r in read] == [("s1", [], [], [], "north"), ("s2", [], [], [], None)]
    line = transects.withColumn("geom", schemas_geom(spark))
    (t,) = shapes.transect_read(line, empty(s.INPUT_OBJECT), empty(s.SUBMISSION), empty(s.RUN_STATUS)).collect()
    assert (t.inputs, t.submissions, t.latitude_start) == ([], [], None)
    (i,) = shapes.input_read(page.limit(1), empty(s.LINK), transects).collect()
    assert i.input_associations == [] and i.transect.name == "north"


def test_children_with_maps(spark):
    rows = [("l", 1, {"n": "2"}), ("l", 0, {"n": "1"}), ("l", 1, None), ("m", 5, {})]
    children = spark.createDataFrame(rows, "parent string, at int, parts map<string,string>")
    nested = nest.nest_children(spark.createDataFrame([("l",), ("k",)], "id string"), children, "parent", order=["at"])
    found = {r.id: [x.at for x in r.children] for r in nested.collect()}
    assert found == {"l": [0, 1, 1], "k": []} and nested.schema["children"].dataType.elementType.names == children.columns


def schemas_geom(spark):
    from pyspark.sql import functions as F

    return F.lit(None).cast("binary")
