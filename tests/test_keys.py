import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.sources.keys import Keys


@pytest.fixture()
def at(tmp_path):
    """A new table's name and place."""
    return {"name": f"k_{uuid.uuid4().hex}", "path": str(tmp_path)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "a long, b string, note string")


@pytest.mark.parametrize("bitmaps", [1, 64])
def test_against_plain_sets(spark, at, bitmaps):
    rnd = random.Random(bitmaps)
    some = lambda n: [(rnd.choice([None, *range(40)]), rnd.choice([None, "x", "y", ""]), str(i)) for i in range(n)]
    stored, batch = some(60), some(80) + [(1000, "new", "n"), (1000, "new", "m"), (1001, "new", "n")]
    keys = Keys.write(frame(spark, stored), keys=["a", "b"], **at, buckets=4, bitmaps=bitmaps)
    whole = lambda r: r[0] is not None and r[1] is not None
    known, new = {r[:2] for r in stored if whole(r)}, frame(spark, batch)
    assert sorted(map(tuple, keys.existing(new).collect()), key=str) == sorted((r for r in batch if r[:2] in known), key=str)
    assert sorted(map(tuple, keys.lacking(new).collect()), key=str) == sorted((r for r in batch if whole(r) and r[:2] not in known), key=str)
    counts = {k: sum(r[:2] == k for r in batch) for k in {r[:2] for r in batch if whole(r)}}
    expected = {(*k, n, k in known) for k, n in counts.items() if k in known or n > 1}
    assert set(map(tuple, keys.breaks(new).collect())) == expected
    assert keys.breaks(new.limit(0)).count() == 0


def test_no_keys_stored(spark, at):
    keys = Keys.write(frame(spark, [(None, "x", "")]), keys=["a", "b"], **at, buckets=2)
    new = frame(spark, [(1, "x", "n")])
    assert keys.existing(new).count() == 0 and keys.lacking(new).count() == 1 and keys.breaks(new).count() == 0


def test_the_large_side_is_not_shuffled(spark, at):
    large = spark.range(20_000).selectExpr("id as a", "cast(id % 7 as string) as b")
    keys = Keys.write(large, keys=["a", "b"], **at, buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.range(19_990, 20_050).selectExpr("id as a", "cast(id % 7 as string) as b")
        found = keys.existing(batch)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan
    scan = plan[: plan.index("Bucketed: true")].splitlines()
    # From the bucketed scan up to the join there is no exchange: only the batch's side has one.
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at, above = depth(scan[-1]), []
    for line in reversed(scan[:-1]):
        if depth(line) < at:
            at = depth(line)
            if "Join" in line:
                break
            above.append(line)
    assert not [x for x in above if "Exchange" in x] and "Exchange hashpartitioning" in plan


def test_new_keys_are_known_by_the_sketch(spark, at):
    keys = Keys.write(spark.range(1000).selectExpr("id as a", "'x' as b"), keys=["a", "b"], **at, buckets=4, bitmaps=64)
    maybe = keys.maybe(spark.range(5000, 15_000).selectExpr("id as a", "'x' as b")).where("__maybe").count()
    assert maybe < 30 and keys.maybe(spark.range(1000).selectExpr("id as a", "'x' as b")).where("__maybe").count() == 1000


def test_name_ids(spark):
    names = ["a", "é/ü", "", "x" * 500]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9, None)], "i long, n string")
    found = rows.select("i", text.name_id(str(uuid.NAMESPACE_URL), F.col("n"), F.col("i")).alias("u"), text.name_id(str(uuid.NAMESPACE_DNS), F.col("n")).alias("v"))
    for r in found.collect():
        n = names[r.i] if r.i < 9 else None
        assert r.u == (None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, f"{n}/{r.i}")))
        assert r.v == (None if n is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, n)))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
