import random

import pytest

from tests.llm.helpers import SPACE
from tidewell.llm import mixing, queries


def expected_targets(sizes, cycle=(5, 2, 1), share=1.5, most=2.0):
    """By sharing the excess again until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


def check(rows, texts):
    """rows: (doc_id, size, source_size, target, taken); texts: {doc_id: (source, text)}."""
    sizes, taken = {}, {}
    for i, (source, text) in texts.items():
        sizes[source] = sizes.get(source, 0) + len(SPACE.findall(text or ""))
    targets = expected_targets(sizes)
    assert sorted(r[0] for r in rows) == sorted(texts)
    for i, size, source_size, target, n in rows:
        source, text = texts[i]
        assert size == len(SPACE.findall(text or "")) and source_size == sizes[source]
        assert target == pytest.approx(targets[source])
        assert 0 <= n <= 2 * size
        taken[source] = taken.get(source, 0) + n
    return sizes, targets, taken


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    rows = sorted(map(tuple, queries.op3_mix(spark, sf_dir).collect()))
    sizes, targets, taken = check(rows, texts)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 64
    again = mixing.mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, again.collect())) == rows


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, " x\ty\x0bz\n", None), (5, "w " * 50000, "b"), (6, "q " * 100, "é"), (7, "r " * 900, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as id")
    found = mixing.mix(docs, carry=["text"])
    assert found.columns == ["doc_id", "source", "text", "size", "source_size", "target", "taken"]
    out = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in found.collect()]
    check(out, {i: (s, t) for i, t, s in rows})
    assert mixing.mix(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs).withColumn("doc_id", docs.doc_id * 0)
    assert mixing.mix(twice).count() == 2 * len(rows)
    nothing = spark.createDataFrame([(1, None, "a"), (None, "", None)], docs.select("doc_id", "text", "source").schema)
    assert [r.taken for r in mixing.mix(nothing).collect()] == [0, 0]


def test_rows_without_ids_and_hot_copies(spark):
    docs = spark.range(60_000).selectExpr(
        "cast(null as long) doc_id", "case when id % 3 = 0 then 'a b c d e' else concat(id, ' of this size ', id % 7) end text", "'x' source"
    )
    small = spark.range(500).selectExpr("id doc_id", "repeat('w ', 40) text", "'y' source")
    out = []
    for parts in (3, 8):
        frame = docs.unionByName(small).repartition(parts)
        rows = mixing.mix(frame, carry=["text"]).cache()
        found = rows.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
        for r in found:
            assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"] + 64
        copies = sorted(r.taken for r in rows.where("text = 'a b c d e'").collect())
        assert len(copies) == 20_000 and copies[0] >= 0 and copies[-1] <= 10
        others = sum(r.taken for r in rows.where("source = 'x' and text <> 'a b c d e'").collect()) / 200_000
        assert abs(sum(copies) / 100_000 - others) < 0.05
        out.append(sorted((r.text, r.taken) for r in rows.collect()))
    assert out[0] == out[1]


def test_weights_of_ones_own(spark):
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1)], "source string, weight int")
    out = mixing.mix(docs, weights=weights, share=0.25).groupBy("source").sum("taken").collect()
    assert {r[0]: r[1] for r in out} == {"a": pytest.approx(2000, abs=200), "b": 0}


def plain_sainte_lague(claims, seats, most):
    won = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = min((k for k in claims if won[k] < most[k] and claims[k] > 0), key=lambda k: (-claims[k] / (2 * won[k] + 1), k), default=None)
        if best is None:
            break
        won[best] += 1
    return won


def test_quotas_by_highest_quotients(spark):
    rng = random.Random(5)
    for n, seats in ((1, 7), (6, 40), (25, 300), (30, 4)):
        claims = {f"k{i:02d}": rng.choice([0, 1, 5, 5, rng.randrange(1, 5000)]) for i in range(n)}
        if not any(claims.values()):
            claims["k00"] = 3
        rows = [("g", k, float(c), seats, 10**9) for k, c in claims.items()]
        frame = spark.createDataFrame(rows, "g string, k string, claim double, seats long, most long")
        found = {r.k: r.quota for r in mixing.sainte_lague(frame, ["g"], "k", "claim", "seats", "most").collect()}
        assert found == plain_sainte_lague(claims, seats, dict.fromkeys(claims, 10**9))
