import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators.security import Principal, find_one, has_any_role, masked, roles_of_token, visible
from tidewell.plans.spec import CRUD, OBJECTS, SUBMISSIONS, ListSpec, Resource, content_range, count_rows, exact_fields, list_rows, predicate

ONE, TWO, ADMIN = Principal("u1", ("user",)), Principal("u2", ("user",)), Principal("u3", ("user", "admin"))


@pytest.fixture(scope="module")
def objects(spark):
    rows = [("o1", "u1", "a_b.mp4", "t1", True), ("o2", "u1", "aXb.mp4", None, False), ("o3", "u2", "100%.mov", "t2", False), ("o4", "u2", None, "t1", True)]
    df = spark.createDataFrame(rows, "id string, owner string, filename string, transect_id string, done boolean")
    return Resource("objects", df)


def ids(df):
    return [r.id for r in df.collect()]


def listed(resource, principal, dialect, filter=None, sort=None, range=None):  # noqa: A002
    return ids(list_rows(resource, ListSpec.parse(filter, sort, range), principal, dialect))


def test_owners_see_their_own_and_admins_all(objects):
    assert listed(objects, ONE, OBJECTS) == ["o1", "o2"]
    assert listed(objects, TWO, OBJECTS) == ["o3", "o4"]
    assert listed(objects, ADMIN, OBJECTS) == ["o1", "o2", "o3", "o4"]
    assert Principal("x").is_admin is False and ADMIN.is_admin
    with pytest.raises(PermissionError):
        ONE.require("admin")
    with pytest.raises(PermissionError):
        Principal("x").require("user", "admin")


def test_a_foreign_row_is_as_absent_as_none(objects):
    assert ids(find_one(objects.df, ONE, "id", "o1")) == ["o1"]
    assert ids(find_one(objects.df, TWO, "id", "o1")) == []
    assert ids(find_one(objects.df, ADMIN, "id", "o1")) == ["o1"]
    assert ids(find_one(objects.df, ADMIN, "id", "zz")) == []
    with pytest.raises(Exception, match="more than one id"):
        find_one(objects.df.union(objects.df), ADMIN, "id", "o1").collect()


def test_exact_fields_of_the_dialects(spark):
    transects = spark.createDataFrame([], schemas.TRANSECT)
    assert exact_fields(transects, CRUD) == {"id", "owner"}
    assert exact_fields(spark.createDataFrame([], schemas.INPUT_OBJECT), CRUD) == {"id", "owner"}
    assert "transect_id" in exact_fields(transects, OBJECTS)


def test_lists_mean_any_or_all_or_nothing(objects):
    assert listed(objects, ADMIN, OBJECTS, '{"id": ["o1", "o3"]}') == ["o1", "o3"]
    assert listed(objects, ADMIN, SUBMISSIONS, '{"id": ["o1", "o3"]}') == []
    assert listed(objects, ADMIN, SUBMISSIONS, '{"id": ["o1", "o1"]}') == ["o1"]
    assert listed(objects, ADMIN, OBJECTS, '{"id": []}') == []
    assert listed(objects, ADMIN, CRUD, '{"id": []}') == ["o1", "o2", "o3", "o4"]
    assert listed(objects, ADMIN, OBJECTS, '{"filename": ["mov", "aX"]}') == ["o2", "o3"]


def test_like_has_wildcards_and_minds_case(objects):
    assert listed(objects, ADMIN, OBJECTS, '{"filename": "a_b"}') == ["o1", "o2"]
    assert listed(objects, ADMIN, OBJECTS, '{"filename": "%"}') == ["o1", "o2", "o3"]
    assert listed(objects, ADMIN, OBJECTS, '{"filename": "MP4"}') == []
    assert listed(objects, ADMIN, OBJECTS, '{"transect_id": "t1", "filename": "a"}') == ["o1"]


def test_booleans_and_errors(objects):
    assert listed(objects, ADMIN, OBJECTS, '{"done": true}') == ["o1", "o4"]
    for bad in ('{"nope": "x"}', '{"nope": true}', '{"nope": ["x"]}'):
        with pytest.raises(ValueError, match="unknown field"):
            listed(objects, ADMIN, OBJECTS, bad)
    with pytest.raises(ValueError, match="unknown field"):
        listed(objects, ADMIN, CRUD, None, '["nope", "ASC"]')
    with pytest.raises(TypeError):
        predicate(objects.df, "done", "x", OBJECTS)
    for text in ("[1]", "[1, 2, 3]", "[-1, 2]"):
        with pytest.raises(ValueError):
            ListSpec.parse(None, None, text)
    with pytest.raises(ValueError):
        ListSpec.parse("[]x")
    assert ListSpec.parse(None, '["a"]', None) == ListSpec()


def test_orders_put_nulls_as_the_largest(objects):
    assert listed(objects, ADMIN, OBJECTS, None, '["filename", "ASC"]') == ["o3", "o2", "o1", "o4"]
    assert listed(objects, ADMIN, OBJECTS, None, '["filename", "DESC"]') == ["o4", "o1", "o2", "o3"]
    assert listed(objects, ADMIN, OBJECTS, None, '["filename", "asc"]') == ["o4", "o1", "o2", "o3"]
    assert listed(objects, ADMIN, OBJECTS, None, '["done", "ASC"]') == ["o2", "o3", "o1", "o4"]


def test_pages_and_counts(objects):
    spec = lambda r: ListSpec.parse(None, '["filename", "DESC"]', r)
    assert ids(list_rows(objects, spec("[1, 2]"), ADMIN, CRUD)) == ["o1"]
    assert ids(list_rows(objects, spec("[1, 2]"), ADMIN, OBJECTS)) == ["o1", "o2"]
    assert ids(list_rows(objects, spec("[9, 12]"), ADMIN, OBJECTS)) == []
    whole = ids(list_rows(objects, spec(None), ADMIN, OBJECTS))
    assert sum((ids(list_rows(objects, spec(f"[{i}, {i + 1}]"), ADMIN, CRUD)) for i in range(4)), []) == whole
    assert count_rows(objects, spec("[1, 2]"), ONE, OBJECTS).first().total == 2
    assert content_range(objects, spec("[1, 20]"), ADMIN, OBJECTS).first()[0] == "objects 1-20/4"
    assert content_range(objects, spec(None), ONE, OBJECTS).first()[0] == "objects 0-2/2"


def test_filters_on_children(spark, objects):
    links = spark.createDataFrame([("o1",), ("o1",), (None,)], "object string")
    resource = Resource("objects", objects.df, children={"links": (links, "object", "id")})
    assert listed(resource, ADMIN, CRUD, '{"links": true}') == ["o1"]
    assert listed(resource, ADMIN, CRUD, '{"links": false}') == ["o2", "o3", "o4"]


def test_masks_and_roles(spark, objects):
    assert {r.filename for r in masked(objects.df, ONE, {"filename": F.lit(None)}).collect()} == {None}
    assert masked(objects.df, ADMIN, {"filename": F.lit(None)}).columns == objects.df.columns
    assert visible(objects.df, ONE).count() == 2
    tokens = spark.createDataFrame(
        [(["admin"],), (None,), (["user"],)], "roles array<string>"
    ).select(F.struct("roles").alias("realm_access"), F.lit(None).cast("struct<roles:array<string>>").alias("client_access"))
    assert [(r.realm_roles, r.client_roles, r.is_admin) for r in roles_of_token(tokens).collect()] == [(["admin"], [], True), ([], [], False), (["user"], [], False)]
    assert [r[0] for r in roles_of_token(tokens).select(has_any_role(F.col("realm_roles"), "user", "admin")).collect()] == [True, False, True]
