from collections import Counter
from math import isclose, log10

import numpy as np
import pytest

from tests.llm.helpers import SPACE, fold, low
from tidewell.llm import lm, queries


def tokens(text):
    return [*SPACE.findall(low(text)), "\n"]


def plain(rows, prior=1000.0):
    """{(doc_id, text): (n_tokens, n_known, N, base, score)}, by all words and bigrams of the training texts."""
    train = [tokens(t) for i, t in rows if i is not None and fold(i, 5) != 1]
    c = Counter(w for t in train for w in t)
    pairs = Counter((a, b) for t in train for a, b in zip(["\n", *t], t))  # noqa: B905
    n, v = sum(c.values()), len(c)
    z = n + 0.5 * (v + 1)
    p1 = lambda w: (c[w] + 0.5) / z
    out = {}
    for i, text in rows:
        t, state, base, score = tokens(text), "\n", 0.0, 0.0
        for w in t:
            base += log10(p1(w))
            score += log10((pairs[state, w] + prior * p1(w)) / (c[state] + prior))
            state = w
        out[i, text] = (len(t), sum(c[w] > 0 for w in t), n, base, score)
    return out


def check(found, rows, texts):
    assert len(found) == len(rows)
    for r in found:
        for key in [(i, t) for i, t in rows if i == r.doc_id]:
            n_tokens, n_known, n, base, score = texts[key]
            if (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n):
                if isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9):
                    break
        else:
            raise AssertionError(r)


def test_query_and_held_out_gain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op8_lm_score(spark, sf_dir).collect()
    check(found, rows, plain(rows))
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 5) == 1) for r in found) and held
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    train = ["a b a c", "b a", "a b b", ""]
    texts = [f"{v} {w}" for v in "abc" for w in ["a", "b", "c", ""]]
    grams = lm.Grams([lm._Keys().of(x.encode()) for x in [*train, *texts, "zz", "a zz", "zz zz"]])
    counts = grams.counts(np.arange(len(grams.starts)) < len(train))
    n, v = sum(len(tokens(t)) for t in train), 4
    a = lm.Automaton(grams, counts, n + 0.5 * (v + 1), 2.0)
    arc = np.where(a.of_pair > 0, (a.of_pair + a.prior * a.word) / (a.of_state + a.prior), a.prior / (a.of_state + a.prior) * a.word)
    at = dict(zip([*train, *texts, "zz", "a zz", "zz zz"], grams.starts, strict=True))
    for state in "abc":
        # After the state: each word, the end (behind "state " alone) and an unknown word.
        p = [arc[at[f"{state} {w}"] + 1] for w in ["a", "b", "c", ""]]
        p.append(a.prior / (a.of_state[at[f"{state} a"] + 1] + a.prior) * a.word[at["zz"]])
        assert isclose(sum(p), 1, rel_tol=1e-12)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b a b"), (3, "a b a b"), (None, "a zz"), (4, "Ab\x0bC" + " long" * 30000), (11, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as n", "3 as key", "4 as block", "5 as id")
    found = lm.score_texts(docs).collect()
    check(found, rows, plain(rows))
    assert [r.held_out for r in found if r.doc_id is None] == [True]
    assert lm.score_texts(docs.limit(0)).count() == 0
    for lone in ([(None, "a b")], [(None, None)]):
        check(lm.score_texts(spark.createDataFrame(lone, "doc_id long, text string")).collect(), lone, plain(lone))
    named = spark.createDataFrame([("x", "a b"), ("y", "a b")], "name string, text string")
    assert {r.name for r in lm.score_texts(named, "name").collect()} == {"x", "y"}


def test_rare_words_and_bigrams_of_a_large_corpus(spark):
    rows = [(i, " ".join(f"w{j * j % (50 + i)} common" for j in range(5_000)) + " Deep Reef" + " odd pair odd pair") for i in (1, 2, 3, 4, 5)]
    rows += [(i, text + " common w1" * 150_000) for i, text in rows] + [(20, "deep reef once here"), (21, "a deep reef"), (23, "once here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if fold(i, 5) != 1]
    assert 1 <= sum(low(t).count("deep reef") for t in train) < 1e-5 * sum(len(tokens(t)) for t in train)
    found = lm.score_texts(docs).collect()
    check(found, rows, plain(rows))


@pytest.mark.parametrize("block_tokens", [1, 50, 700, 10**9])
def test_blocks_change_no_score(spark, block_tokens):
    rows = [(i, " ".join(f"w{j * j % (5 + i % 7)} Rare{i % 9} x" for j in range(40))) for i in range(40)] + [(50, "zz x rare1 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(lm.score_texts(docs, prior=3.0, block_tokens=block_tokens).collect(), rows, plain(rows, 3.0))


def test_packing():
    rng = np.random.default_rng(5)
    for x in (rng.integers(0, 2**63, 1000).astype(np.uint64), np.arange(7, dtype=np.uint64), np.array([2**64 - 1], np.uint64)):
        assert (lm.unpacked(lm.packed(x)) == x).all()
        assert (np.cumsum(lm.unpacked(lm.packed(np.diff(np.sort(x), prepend=np.uint64(0)))), dtype=np.uint64) == np.sort(x)).all()


@pytest.mark.parametrize("buckets", [7, 8, 50, 256, 1024])
def test_blocks_spread_over_buckets(buckets):
    """Tasks' blocks, of which each has a few, come evenly to the buckets, powers of two too."""
    numbers = [(task << 32) + i for task in range(40 * buckets // 10) for i in range(10)]
    counts = [0] * buckets
    for n in numbers:
        counts[lm.bucket_of(n, buckets)] += 1
    assert min(counts) > 0 and max(counts) < 2.2 * len(numbers) / buckets


def test_memory_of_a_block():
    """A block's grams take at most 40 bytes a gram on the way; an inverse by np.unique takes more."""
    import inspect
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50_000, 1000).astype(np.uint64) for _ in range(200)]
    tracemalloc.start()
    grams = lm.Grams(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(grams.at) and grams.at.itemsize == 4
    keys, at = np.unique(np.concatenate([np.concatenate(texts), *(lm.pair_keys(np.r_[lm.END, x[:-1]], x) for x in texts)]), return_inverse=True)
    assert (grams.keys == keys).all() and (grams.at == at).all()
    assert inspect.signature(lm.score_texts).parameters["block_tokens"].default <= 1_000_000
