import math

import duckdb
import numpy as np
import pytest

from tidewell.llm import queries, topk


def plain(rows, every=20, k=20, scale=64):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, u) in enumerate(good):
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for at, (i, v) in enumerate(good) if at != own)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_query_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view embeddings as from '{sf_dir}/embeddings.parquet'")
    expected = db.execute(queries.ORACLE_SQL["op7_top_k"]).fetchall()
    assert sorted(map(tuple, queries.op7_top_k(spark, sf_dir).collect())) == sorted(expected)


@pytest.mark.parametrize("n,kinds,blocks", [(700, 3, 7), (90, 1, 2048), (15, 4, 2048)])
def test_ties_tiles_and_blocks(spark, n, kinds, blocks):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.integers(-kinds, kinds + 1, 4) / 8]) for i in rng.permutation(n)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = topk.top_k(frame, query_rows=blocks, shard_rows=blocks * 3, piece=16, fan_in=2, k=6)
    assert sorted(map(tuple, found.collect())) == plain(rows, k=6)


def test_ids_and_rows_that_repeat(spark):
    three = [(20, [1.0, 2.0]), (20, [3.0, 1.0]), (1, [1.0, 1.0])]
    rng = np.random.default_rng(4)
    many = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in rng.integers(0, 60, 200)] + [(40, [2.0, 2.0, 2.0])] * 30
    for rows, shard in ((three, 16), (three, 1), (many, 7), (many, 1000)):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        found = sorted(map(tuple, topk.top_k(frame, k=5, query_rows=shard, shard_rows=shard, piece=4).collect()))
        assert found == plain(rows, k=5)
        db = duckdb.connect()
        db.execute("create table embeddings(vec_id bigint, embedding double[])")
        db.executemany("insert into embeddings values (?, ?)", rows)
        sql = queries.ORACLE_SQL["op7_top_k"].replace("rank <= 20", "rank <= 5")
        assert sorted(db.execute(sql).fetchall()) == found


def test_the_plan_does_not_grow_with_the_queries(spark):
    frame = spark.range(0, 4000, 20).selectExpr("id as vec_id", "array(double(id % 7), double(1)) as embedding")
    size = lambda rows: len(topk.top_k(frame, query_rows=rows, shard_rows=1000)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(10) == size(100) == size(1000)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, -0.5]), (None, [9.0, 9.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (3, [inf, 0.0]), (5, [-0.001, 0.1]), (5, [-0.001, 0.1]), (7, [1e6, 1e6]), (-20, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as query_id")
    assert sorted(map(tuple, topk.top_k(frame).collect())) == plain(rows)
    odd = frame.unionByName(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<double>"), allowMissingColumns=True)
    assert sorted(map(tuple, topk.top_k(odd).collect())) == plain(rows)
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id = 7")).count() == 0


def test_products_beyond_floating_point():
    a = np.array([[2**40, 1], [3, -(2**40)]])
    b = np.array([[2**21, 1], [5, 7]])
    assert topk._product(a, b).tolist() == [[2**61 + 1, 5 * 2**40 + 7], [3 * 2**21 - 2**40, 15 - 7 * 2**40]]
