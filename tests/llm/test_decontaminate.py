import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.helpers import contamination
from tidewell.llm import queries
from tidewell.llm.decontaminate import BlockIndex, _blocks, _pieces, _winnow, find_contamination
from tidewell.llm.common import alnum_words


def rows_of(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in found.collect()), key=str)


def test_query_against_every_place(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op1_decontaminate(spark, sf_dir).collect()
    assert len(found) == len(texts)
    hits = 0
    for r in found:
        n_words, n_hit, ids = contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(ids), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        hits += r.contaminated
    assert hits


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(
    st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=4),
    st.lists(st.sampled_from("abcd"), max_size=60),
)
def test_few_words_and_many_ties(items, doc):
    pairs = [(str(i), " ".join(x).encode()) for i, x in enumerate(items)]
    index = BlockIndex(pairs, 10, 5)
    hit, found = index.hits(alnum_words(" ".join(doc).encode()))
    _, n_hit, ids = contamination(" ".join(doc), [(i, t.decode()) for i, t in pairs])
    assert (int(hit.sum()), sorted(index.ids[x] for x in found)) == (n_hit, ids)


EDGE_DOCS = [
    (1, None),
    (2, ""),
    (3, "... --- !!"),
    (4, "One two THREE four five six seven eight nine ten eleven"),
    (4, "One two THREE four five six seven eight nine ten eleven"),
    (None, "x short item y"),
    (5, "filler " * 20000 + "one two three four five six seven eight nine ten"),
    (6, "Ünïcode wörds short item"),
]
EDGE_ITEMS = [
    (10, "one two three four five six seven eight nine ten"),
    (9, "zero one two three four five six seven eight nine ten eleven"),
    (9, "zero one two three four five six seven eight nine ten eleven"),
    (11, "Short, item!"),
    (None, "wörds"),
    (12, None),
    (13, ".."),
]


@pytest.mark.parametrize("block_words", [2_000_000, 8])
def test_edges_and_blocks(spark, block_words):
    docs = spark.createDataFrame(EDGE_DOCS, "doc_id long, text string").selectExpr("*", "'x' as N_HIT", "1 as spans")
    bench = spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")
    expected = [(i, *contamination(t, EDGE_ITEMS)) for i, t in EDGE_DOCS]
    found = find_contamination(docs, bench, block_words=block_words)
    assert found.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    assert rows_of(found) == sorted(expected, key=str)
    assert {tuple(map(tuple, r.spans)) for r in found.where("doc_id = 4").collect()} == {((0, 11),)}
    assert rows_of(find_contamination(docs, bench.limit(0))) == sorted([(i, n, 0, []) for i, n, *_ in expected], key=str)
    assert rows_of(find_contamination(docs.limit(0), bench)) == []


def test_winnowing_keeps_one_of_each_run():
    import numpy as np

    grams = np.array([5, 3, 3, 9, 1, 7, 8, 8, 8, 2], np.uint64)
    kept = _winnow(grams, 3).tolist()
    for i in range(len(grams) - 2):
        low = min(grams[i : i + 3])
        assert max(j for j in range(i, i + 3) if grams[j] == low) in kept


def test_items_that_repeat(spark):
    text = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([("a", text)] * 300 + [("b", "w3 w4 w5"), ("b", "w3 w4 w5"), (None, "x y")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {text}"), (2, "w3 w4 w5 x y"), (3, None)], "doc_id long, text string")
    for size in (20, 10**6):
        found = {r.doc_id: (r.n_hit, r.items) for r in find_contamination(docs, items, block_words=size).collect()}
        assert found == {1: (30, ["a", "b"]), 2: (5, ["b"]), 3: (0, [])}


def test_pieces_hold_each_window_and_blocks_are_bounded(spark):
    words = [f"w{i % 37}" for i in range(500)]
    rows = [("a", " ".join(words))] * 3 + [("b", "x y z"), ("c", None), ("d", "!"), (None, " ".join(words[7:17])), ("e", "v" * 4000)]
    items = spark.createDataFrame(rows, "id string, text string").selectExpr("id", "cast(text as binary) as text")
    pieces = _pieces(items, 10, 25)
    found = [(r.id, alnum_words(bytes(r.piece)), r.size) for r in pieces.collect()]
    of = lambda x, i: tuple(x[i : i + 10])
    for item, text in set(rows):
        own = alnum_words((text or "").encode())
        parts = [p for x, p, _ in found if x == item]
        windows = {of(own, i) for i in range(max(len(own) - 9, min(len(own), 1)))}
        assert {of(p, i) for p in parts for i in range(max(len(p) - 9, 1))} == windows
    assert max(len(p) for _, p, _ in found) == 25 and {n for x, _, n in found if x == "e"} == {500}
    blocks = list(_blocks(pieces, 60))
    assert sorted(x for b in blocks for x in b if x[0]) == sorted((x, b" ".join(p)) for x, p, _ in found if x)
    assert all(len(b) == 1 or sum(len(alnum_words(p)) for _, p in b) <= 60 for b in blocks) and len(blocks) > 4
    assert list(_blocks(pieces.limit(0), 60)) == [[]]


def test_a_long_item_in_many_blocks(spark):
    words = [f"u{i}" for i in range(300)]
    items = spark.createDataFrame([("long", " ".join(words)), ("other", "p q r")], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(["so", *words[20:200], "end"])), (2, "p q"), (3, "a p q r"), (4, None)], "doc_id long, text string")
    for size in (100, 10**6):
        found = {r.doc_id: (r.n_hit, r.items, [list(x) for x in r.spans]) for r in find_contamination(docs, items, block_words=size).collect()}
        assert found == {1: (180, ["long"], [[1, 181]]), 2: (0, [], []), 3: (3, ["other"], [[1, 4]]), 4: (0, [], [])}


def test_many_blocks_leave_no_copy_of_the_corpus(spark):
    from pathlib import Path

    from tidewell.llm.common import _shared_folder, checkpointed

    checkpointed(spark.range(1))
    items = [(str(i), " ".join(f"w{i}_{j}" for j in range(12))) for i in range(10)]
    docs = spark.createDataFrame([(i, f"text {i} " + items[i % 40][1] if i % 40 < 10 else f"no item in {i} " * 50) for i in range(400)], "doc_id long, text string")
    held = lambda: {p: p.stat().st_size for p in Path(_shared_folder(spark).removeprefix("file:")).rglob("*.parquet")}
    before = held()
    found = find_contamination(docs, spark.createDataFrame(items, "item_id string, text string"), block_words=12)
    assert {r.doc_id: r.items for r in found.where("n_hit > 0").collect()} == {i: [str(i % 40)] for i in range(400) if i % 40 < 10}
    new = [p for p in held() if p not in before]
    assert new and all("text" not in spark.read.parquet(str(p)).columns for p in new)
    assert {c for p in new for c in spark.read.parquet(str(p)).columns} == {"mark", "items", "spans"}
