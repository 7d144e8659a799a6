import math

import duckdb
import numpy as np
import pytest

from tidewell.llm import covertree, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, cosine=0.93):
    """By all pairs."""
    good = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    units = [np.array(v) / max(map(abs, v)) if ok else None for ok, (_, v, _) in zip(good, rows, strict=True)]
    units = [u if u is None else u / np.linalg.norm(u) for u in units]
    n = len(rows)
    near = [[j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return sorted(out, key=str)


def families(rng, n, width, spread, labels=1):
    """Unit vectors about a few centres, by several spreads, beside others anywhere."""
    centres = rng.normal(size=(max(1, n // 40), width))
    at = rng.integers(0, len(centres), n)
    by = rng.choice([0.0, 0.3, 1, 2], n)[:, None] * spread / math.sqrt(width)
    v = centres[at] / np.linalg.norm(centres[at], axis=1)[:, None] + rng.normal(size=(n, width)) * by
    v[: n // 3] = rng.normal(size=(n // 3, width))
    return v, rng.integers(0, labels, n)


@pytest.mark.parametrize("n,width,spread,cosine", [(700, 8, 0.2, 0.93), (900, 64, 0.3, 0.93), (300, 2, 0.1, 0.999), (400, 3, 0.5, 0.5), (1, 4, 0.1, 0.9), (60, 5, 0.0, 0.93)])
def test_traversal_against_all_pairs(n, width, spread, cosine):
    rng = np.random.default_rng(n)
    v = covertree.unit_rows(families(rng, n, width, spread)[0])
    weight = rng.integers(1, 4, n)
    near = v @ v.T >= cosine
    for cut in (0, n // 2):
        mask = near.copy()
        if cut:  # only pairs of one part with the other
            mask[:cut, :cut] = mask[cut:, cut:] = False
            counts, root = covertree.traverse(v[:cut], weight[:cut], v[cut:], weight[cut:], cosine)
        else:
            counts, root = covertree.traverse(v, weight, None, None, cosine)
            np.fill_diagonal(mask, False)
        assert counts.tolist() == (mask @ weight).tolist()
        label = np.arange(n)
        for _ in range(n):
            new = np.array([min(label[i], label[mask[i]].min(initial=n)) for i in range(n)])
            if (new == label).all():
                break
            label = new
        groups = lambda x: sorted(sorted(np.flatnonzero(x == r).tolist()) for r in np.unique(x))
        assert groups(root) == groups(label)


def test_levels_nest_and_halve():
    rng = np.random.default_rng(5)
    points = covertree.unit_rows(families(rng, 500, 16, 0.3)[0])
    tree = covertree.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(500))
    for node, children in tree.children.items():
        own = points[tree.order[tree.lo[node] : tree.hi[node]]]
        assert np.linalg.norm(own - own[0], axis=1).max() <= tree.radius[node] + 1e-6
        assert tree.lo[children[0]] == tree.lo[node] and tree.hi[children[-1]] == tree.hi[node]
        assert (tree.lo[children[1:]] == tree.hi[children[:-1]]).all() and len(children) > 1
        assert (tree.radius[children] < tree.radius[node]).all()


def test_equal_groups_are_counted_not_listed():
    rng = np.random.default_rng(6)
    v = covertree.unit_rows(1 + 0.01 * rng.normal(size=(20_000, 16)))
    counts, root = covertree.traverse(v, np.full(len(v), 3), None, None, 0.93)
    assert (counts == 3 * (len(v) - 1)).all() and len(set(root.tolist())) == 1


@pytest.mark.parametrize("shard_rows,pivots,labels", [(2048, 256, 3), (40, 32, 2), (25, 4, 1), (7, 64, 5)])
def test_cells_and_pieces(spark, shard_rows, pivots, labels):
    rng = np.random.default_rng(shard_rows)
    v, label = families(rng, 400, 6, 0.25, labels)
    label[:180] = 0  # a hot label
    rows = [(int(i), [float(x) for x in v[i]], int(label[i])) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(60)]  # copies
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = covertree.near_vectors(frame, shard_rows=shard_rows, pivots=pivots)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_edges(spark):
    nan, inf, one = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (1, [2.0, 4.0, 6.0], 0), (2, one, 1), (3, one, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [0.0, 0.0, 0.0], 0),
        (7, [nan, 2.0, 3.0], 0), (8, [1.0, None, 3.0], 0), (9, [inf, 2.0, 3.0], 0), (None, one, 0), (None, [-1.0, 0.0, 0.0], 0), (10, [], 0), (11, [], 0),
        (12, [1e200, 2e200, 3e200], 0), (13, [1e-200, 2e-200, 3e-200], 0), (14, [1.0, 2.0], 0), (15, [1.0, 2.0], 0), (16, [-1.0, -2.0, -3.0], 0), (1, one, 0),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_links", "'x' as component_id", "2 as node", "3 as n")
    found = covertree.near_vectors(frame)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)
    assert covertree.near_vectors(frame.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view embeddings as from '{sf_dir}/embeddings.parquet'")
    rows = db.execute("select vec_id, embedding, label from embeddings").fetchall()
    result = db.execute(queries.ORACLE_SQL["op13_near_vectors"])
    names = [x[0] for x in result.description]
    expected = sorted(result.fetchall(), key=str)
    found = queries.op13_near_vectors(spark, sf_dir)
    assert found.columns == names and sorted(map(tuple, found.collect()), key=str) == expected == plain(rows)
