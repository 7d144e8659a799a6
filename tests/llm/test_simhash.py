import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import components, fingerprint
from tidewell.llm import queries, simhash
from tidewell.llm.common import join_counted
from tidewell.llm.components import connected_components


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = [(i, fingerprint(t)) for i, t in texts.items()]
    expected = components(prints)
    found = queries.op2_simhash(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted(
        (i, f"{f:016x}", expected[i, f]) for i, f in prints
    )


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(st.sampled_from("aBc éÀ\t\n\x0b\xa0."), max_size=60)))
def test_fingerprint(text):
    assert simhash.simhash(text.encode() if text is not None else None) & (1 << 64) - 1 == fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    value = spark.sql("select xxhash64('ab c d') x").first().x
    assert simhash.simhash(b"AB  c\td") == value


def clustered(n, seed):
    """Fingerprints about few centres, so that shards, chains and boundaries matter."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n // 6 + 1, dtype=np.uint64)
    out = rng.choice(base, n)
    for _ in range(4):
        out ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return out


@pytest.mark.parametrize("shard_rows, sample_rows", [(8, 2000), (40, 2000), (100_000, 2000), (8, 30), (20, 1)])
def test_links_of_clusters(spark, shard_rows, sample_rows):
    prints = np.unique(clustered(3000, shard_rows)).view(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    links = simhash.hamming_links(frame, 3, shard_rows=shard_rows, sample_rows=sample_rows)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    found = {}
    for f in prints.tolist():
        found.setdefault(roots.get(f, f), set()).add(f & (1 << 64) - 1)
    expected = {}
    unsigned = [f & (1 << 64) - 1 for f in prints.tolist()]
    for (_, f), root in components([(f, f) for f in unsigned]).items():
        expected.setdefault(root, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))
    assert len(expected) < len(unsigned)


def test_large_shards_are_divided():
    prints = np.unique(clustered(4000, 3)).view(np.int64)
    parts = list(simhash._divided(prints, np.ones(len(prints), bool), 1, 1, 20, sample=500))
    assert len(parts) > 20 and max(own.sum() for _, own in parts) < len(prints) / 8
    assert len(np.unique(np.concatenate([at[own] for at, own in parts]))) == len(prints)
    alike = np.arange(500, dtype=np.int64)  # one upper half: no tree parts them
    assert [len(at) for at, _ in simhash._divided(alike, np.ones(500, bool), 1, 1, 20)] == [500]


@pytest.mark.parametrize("share", [1e-9, 0.1, 1.0])
def test_join_counted(spark, share):
    keys = [1] * 50 + [2] * 20 + list(range(3, 33)) + [None, 99]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, i int")
    counted = spark.createDataFrame([(k, k * 10, keys.count(k)) for k in range(1, 33)], "key long, value long, n long")
    found = sorted((r.key, r.i, r.value) for r in join_counted(rows, counted, "key", share=share).collect())
    assert found == sorted((k, i, k * 10) for i, k in enumerate(keys) if k not in (None, 99))


def test_edges(spark):
    text = "one two three four five six seven"
    rows = [(7, None), (5, ""), (9, " \n"), (None, text), (3, text), (3, text), (8, text.upper()), (None, "alone"), (2, "a b"), (1, "x y z " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    found = simhash.near_duplicates(docs).collect()
    prints = [(i, fingerprint(t)) for i, t in rows]
    expected = components(prints)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found), key=str) == sorted(
        ((i, f, expected[i, f]) for i, f in prints), key=str
    )
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 6)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
