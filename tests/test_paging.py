import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import paging
from tidewell.operators.paging import By, Order, locate, page
from tidewell.operators.security import Principal
from tidewell.plans import list_queries, spec


def ordered(rows, by):
    """Nulls are the largest value."""
    for at, falling in reversed(by):
        rows = sorted(rows, key=lambda r: (r[at] is None, 0 if r[at] is None else r[at]), reverse=falling)
    return rows


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([None, "a", "b", "c", "dd", "e" * rnd.randint(1, 5)]), rnd.choice([None, 1.5, 2.0, float(rnd.randint(0, 40))]), i) for i in range(n)]


@pytest.mark.parametrize("by", [[(0, False), (2, False)], [(1, True), (2, False)], [(0, True), (1, False), (2, True)], [(2, False)]])
def test_pages_against_a_sorted_list(spark, by):
    rows = rows_of(900)
    df = spark.createDataFrame(rows, "a string, b double, id long").repartition(5).cache()
    expected = ordered(rows, by)
    for start, count in [(431, 10), (893, 100), (300, 500)]:
        found = page(df, [By("a b id".split()[i], falling) for i, falling in by], start, count, total=900, small=60, fan=6)
        assert [tuple(r) for r in found.collect()] == expected[start : start + count]


def test_a_value_that_most_rows_have(spark):
    rows = [("same", 1)] * 700 + [("zz", i) for i in range(60)] + [(None, 5)] * 40
    df = spark.createDataFrame(rows, "a string, id long").repartition(6).cache()
    by, expected = [By("a"), By("id")], ordered(rows, [(0, False), (1, False)])
    for start, count in [(350, 400), (695, 10), (795, 30)]:
        found = page(df, by, start, count, total=800, small=20, fan=4)
        assert [tuple(r) for r in found.collect()] == expected[start : start + count]
    first = locate(Order(df, by), 350, 800, small=10, fan=3)
    assert (first.before, first.equal, first.key[:2]) == (0, 700, ("same", 1))


def test_pages_tile_where_the_order_has_ties(spark):
    df = spark.range(500).selectExpr("id % 3 as a", "id as b", "map('k', id) as m").repartition(4).cache()
    found = [r.b for start in range(0, 500, 125) for r in page(df, [By("a")], start, 125, small=15, fan=4).collect()]
    assert sorted(found) == list(range(500))


def test_only_the_page_is_sorted(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(spec, "DEEP", 100)
    lines = list_queries._lines(spark, sf_dir)[0].df
    n = lines.count()
    found = page(lines, [By("price"), By("id")], n * 9 // 10, 40, small=200, fan=8)
    plan = found._jdf.queryExecution()
    pushed = plan.executedPlan().toString().partition("PushedFilters: [")[2]
    assert "GreaterThanOrEqual(l_ext" in pushed and "LessThanOrEqual(l_ext" in pushed
    sort = plan.optimizedPlan().toString()
    assert "Limit" not in sort and "Offset" not in sort
    assert found.count() == 40
    resource = spec.Resource("lines", lines)
    shallow = lines.orderBy("shipped", "id").offset(n - 30).limit(30)
    deep = spec.list_rows(resource, spec.ListSpec.parse(None, '["shipped", "ASC"]', f"[{n - 30}, {n + 5}]"), Principal(0, ("admin",)), spec.CRUD)
    assert deep.collect() == shallow.collect()


def test_edges(spark):
    df = spark.createDataFrame([(1, None)], "id long, a double")
    assert page(df, [By("id")], 1, 5).count() == page(df, [By("id")], 0, 0).count() == 0
    assert page(df.limit(0), [By("id")], 0, 5).count() == 0
    assert page(df, [By("a"), By("id")], 0, 5).collect() == df.collect()
    nan = float("nan")
    rows = spark.createDataFrame([(i, nan if i % 2 else float(i)) for i in range(60)], "id long, a double")
    assert [r.id for r in page(rows, [By("a", True), By("id")], 0, 60, small=4, fan=3).collect()] == [*range(1, 60, 2), *range(58, -1, -2)]


def test_both_ends_are_found_in_the_same_few_passes(spark, monkeypatch):
    ranges, of = [], Order.rows
    monkeypatch.setattr(Order, "rows", lambda self, *a, **k: ranges.append(a) or of(self, *a, **k))
    df = spark.range(60_000).selectExpr("id", "hash(id) as a").repartition(4).cache()
    expected = sorted(((r.a, r.id) for r in df.collect()))[54_000:54_050]
    found = page(df, [By("a"), By("id")], 54_000, 50, small=60)
    assert [(r.a, r.id) for r in found.collect()] == expected
    assert len(ranges) <= 5  # the whole, at most three smaller ranges, and the page


def test_far_places_among_ties(spark):
    rows = [(i % 7, i // 3) for i in range(2000)] + [(3, 5)] * 500
    df = spark.createDataFrame(rows, "a long, b long").repartition(5).cache()
    order = Order(df, [By("a", True), By("b")])
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))
    places = [0, 1, 700, 1300, 1301, 2499]
    found = paging.locate_all(order, places, 2500, small=30, fan=5)
    assert [found[p].key[:2] for p in places] == [expected[p] for p in places]
    for p in places:
        same = [i for i, r in enumerate(expected) if r == expected[p]]
        assert (found[p].before, found[p].equal) == (same[0], len(same))


def test_a_page_of_whole_keys_is_one_scan(spark):
    df = spark.range(3000).selectExpr("id", "id % 4 as day").repartition(3).cache()
    found = page(df, [By("day"), By("id")], 2000, 400, small=50)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.day, r.id) for r in found.collect()] == sorted((i % 4, i) for i in range(3000))[2000:2400]


def test_a_row_meets_few_bounds_and_a_small_page_is_read_once(spark, monkeypatch):
    met, of = [], paging._range_of
    monkeypatch.setattr(paging, "_range_of", lambda order, bounds, low, high: met.append(len(bounds)) or of(order, bounds, low, high))
    df = spark.range(20_000).selectExpr("id", "hash(id) % 9 as day").repartition(4).cache()
    expected = sorted((r.day, r.id) for r in df.collect())
    for start, count in [(17_990, 30), (12_000, 7_000)]:
        found = page(df, [By("day"), By("id")], start, count, small=100, fan=4)
        assert [(r.day, r.id) for r in found.collect()] == expected[start : start + count]
    assert 0 < max(met) <= 7
    found = page(df, [By("day"), By("id")], 17_990, 30)
    assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString().lower()
