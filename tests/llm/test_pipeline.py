import os

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.helpers import SPACE, contamination, low
from tidewell.llm import decontaminate, quality, queries, simhash, toxicity, verify

BIG = "/root/testdata/sf0.01"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text, n=5):
    words = SPACE.findall(low(text))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())


def near_duplicates(texts, similarity=0.8):
    """({id: least id reachable over pairs of that Jaccard similarity}, {id: least id of the same shingles}), of all pairs."""
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    label, of = {}, {}
    for i in sorted(sets):
        label[i] = i
        of.setdefault(sets[i], i)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and (x == y or x and y and min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y)):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: of[x] for i, x in sets.items()}


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").cache()
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "benchmark decontamination", "source mix"]
    kept = [docs]
    for _, stage in pipeline.STAGES:
        kept.append(stage(spark, kept[-1], BIG).cache())
    assert all(k.columns == docs.columns for k in kept[:-1])
    before = [rows(k) for k in kept]

    model = queries.quality_model(docs, labels)
    good = {r.doc_id for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    assert set(before[1]) == good and len(good) < len(before[0])

    model = queries.toxicity_model(kept[1], labels)
    clean = {r.doc_id for r in toxicity.score_toxicity(kept[1], model).where("predicted = 0").collect()}
    assert set(before[2]) == clean and len(clean) < len(good)

    least, copies = near_duplicates({i: r.text for i, r in before[2].items()})
    gone = set(before[2]) - set(before[3])
    assert all(least[i] < i for i in gone)  # none goes that isn't within 0.8 of a chain to a lesser one
    expected = {i for i, x in least.items() if x < i}
    assert {i for i in expected if copies[i] < i} <= gone and len(gone) >= 0.95 * len(expected) > 0

    items = [tuple(r) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(before[4]) == {i for i, r in before[3].items() if not contamination(r.text, items)[1]}
    assert len(before[4]) < len(before[3])

    mixed = before[5]
    assert kept[5].columns == [*docs.columns, "size", "source_size", "target", "taken"]
    for i, r in mixed.items():
        old = before[4][i]
        assert (r.text, r.source, r.size) == (old.text, old.source, len(SPACE.findall(old.text)))
        assert 0 < r.taken <= 2 * r.size
    taken, target = {}, {}
    for r in mixed.values():
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 200 for s in taken)


def test_odd_documents(spark):
    data = [(1, None, "en", "a", 0), (None, "some words here", None, None, None), (None, "some words here", "en", "b", 1), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' as SCORE", "1 as n_hit", "2 as fp", "3 as taken", "4 as c0")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, BIG)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), BIG).count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, BIG)
    assert [c.lower() for c in last.columns].count("taken") == 1
    assert last.where("text = ''").count() == 0


def test_run_keeps_only_the_last_input(spark, sf_dir):
    from tidewell.llm.common import _shared_folder, discard, written

    table = written(spark.range(3))
    folder = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    discard(spark.read.parquet(f"{sf_dir}/region.parquet"))
    discard(table)
    assert not os.path.exists(folder) and os.path.exists(f"{sf_dir}/region.parquet")
    held = lambda: {x for x in os.listdir(_shared_folder(spark).removeprefix("file:")) if x.startswith(spark.sparkContext.applicationId)}
    before = held()
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns[-4:] == ["size", "source_size", "target", "taken"]
    texts = [x for x in held() - before if "text" in spark.read.parquet(f"{_shared_folder(spark)}/{x}").columns]
    assert len(texts) <= 3  # the last stage's input and the samples of the two models


def test_registered(spark):
    assert pipeline.ORACLE_SQL is None and "pipeline" in entry.queries()
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert decontaminate.FIELDS


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(5000)]
    data, pairs = [], {0.98: [], 0.9: [], 0.82: [], 0.6: []}
    for i in range(400):
        text = list(rng.choice(words, int(rng.integers(60, 700))))
        kind = list(pairs)[i % 4]
        n = len(text) - 4
        # Words put on at the end: k new shingles of n + k.
        more = text + list(rng.choice(words, max(1, round(n / kind - n))))
        data += [(2 * i, " ".join(text), "en"), (2 * i + 1, " ".join(more).upper(), "en")]
        pairs[kind].append(2 * i + 1)
    # A chain: each is like the one before, the last not like the first; and thousands of near copies of one text.
    chain = list(rng.choice(words, 200))
    data += [(10_000 + i, " ".join(chain[5 * i : 5 * i + 100]), "en") for i in range(8)]
    common = " ".join(rng.choice(words, 100))
    data += [(20_000 + i, f"{common} x{i}", "en") for i in range(1500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    kept = {r.doc_id for r in dict(pipeline.STAGES)["near duplicates"](spark, docs, BIG).collect()}
    assert {2 * i for i in range(400)} <= kept and set(pairs[0.6]) <= kept
    caught = {k: 1 - len(kept & set(v)) / len(v) for k, v in pairs.items()}
    assert caught[0.98] == 1 and caught[0.9] >= 0.98 and caught[0.82] >= 0.9
    assert {i for i in kept if i >= 10_000} == {10_000, 20_000}


def test_stages_with_clashing_columns_and_repeated_ids(spark):
    rows = [r.text for r in spark.read.parquet(f"{BIG}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    data = [(i // 2, text, "en", "s") for i, text in enumerate([*rows, rows[0], rows[1], "long words " * 40_000])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "7 as id", "8 as label", "9 as class", "10 as fp", "11 as row", "12 as key", "13 as node", "14 as sample")
    for name, stage in pipeline.STAGES:
        once, again = (sorted(map(str, stage(spark, docs.repartition(n), BIG).collect())) for n in (2, 5))
        assert once == again and once, name
        assert set(docs.columns) <= set(stage(spark, docs, BIG).columns)


def test_near_duplicates_of_odd_ids(spark):
    a, b, c = ("one red fox ran over old hills", "salt and iron rust in deep water", "many quiet lamps burn along this shore")
    data = [(5, a), (3, a), (5, b), (7, b), (None, b), (None, c), (None, c)]
    stage = dict(pipeline.STAGES)["near duplicates"]
    for order in (data, data[::-1], [data[2], *data]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        found = [(r.doc_id, r.text) for r in stage(spark, docs, BIG).collect()]
        assert sorted(found, key=str) == sorted([(3, a), (5, b), (None, c)], key=str)


def family(rng, words, pairs, base_share, similarity, n=300):
    """Texts in similar pairs that share a template, and the pairs' places. A text is the template's words, then its own."""
    template = list(rng.choice(words, int(n * base_share)))
    texts, at = [], []
    for _ in range(pairs):
        one = template + list(rng.choice(words, n - len(template)))
        k = n - 4
        at.append((len(texts), len(texts) + 1))
        texts += [" ".join(one), " ".join(one + list(rng.choice(words, max(1, round(k / similarity - k)))))]
    return texts, at


@pytest.mark.parametrize("similarity,least", [(0.876, 393), (0.81, 361)])
@pytest.mark.parametrize("base", [0.8, 0.0])
def test_pairs_within_families(spark, base, similarity, least):
    """Candidates of a template's texts (about 0.66 alike) don't stand between similar ones: as many pairs of 400 are
    found as outside families."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(20_000)]
    texts, pairs = [], []
    for _ in range(20):
        own, at = family(rng, words, 20, base, similarity)
        pairs += [(a + len(texts), b + len(texts)) for a, b in at]
        texts += own
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(order[i]), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    of = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert sum(of[order[a]] == of[order[b]] for a, b in pairs) >= least
    assert len(set(of.values())) >= 400  # no two pairs are merged


def test_wide_groups_against_all_pairs(spark):
    """Groups of several blocks, of which some members aren't linked to the least one."""
    rng = np.random.default_rng(3)
    data, sets = [], {}
    for group, n in ((1, 60), (1000, 25), (2000, 2), (3000, 5)):
        base = rng.choice(10_000, 40, replace=False)
        for i in range(n):
            keep = base if i % 3 else base[: rng.integers(20, 40)]
            own = np.unique(np.r_[keep, rng.integers(10_000, 10**6, rng.integers(0, 14))]).astype(np.uint64)
            sets[group + i] = set(own.tolist())
            data.append((group, group + i, [0, 0], own.tobytes()))
    frame = spark.createDataFrame(data, "group long, node long, fps array<long>, text binary").repartition(5)

    def reached(links):
        label = {i: i for i in sets}
        for _ in range(len(sets)):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    expected = reached([(i, j) for i in sets for j in sets if i < j and j - i < 500 and alike(i, j)])
    for rows in (1000, 20, 7):
        links = [(r.a, r.b) for r in verify.similar_pairs(frame, lambda x: np.frombuffer(x, np.uint64), 0.8, 1.0, rows).collect()]
        assert all(alike(a, b) for a, b in links)
        assert reached(links) == expected


def test_a_hub_of_near_copies(spark):
    """Thousands of near copies of one text are one component, met by blocks."""
    common = " ".join(f"c{i}" for i in range(120))
    docs = spark.range(6000).selectExpr("id as doc_id", f"concat('{common} x', id) as text").repartition(8)
    found = simhash.similar_documents(docs, shard_rows=400, block_rows=300)
    assert [r.component_id for r in found.select("component_id").distinct().collect()] == [0]


@pytest.mark.parametrize("similarity,least", [(0.8, 0.9), (0.85, 0.98), (0.9, 0.995)])
def test_fingerprints_bring_pairs_together(similarity, least):
    """How many pairs meet by the bounds of halves and whole fingerprints alone, however small the shards are."""
    rng = np.random.default_rng(5)
    hashes = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    met = 0
    for _ in range(400):
        one, more = hashes(300), hashes(round(300 / similarity) - 300)
        x = np.bitwise_xor(*(simhash.fingerprints(np.unique(s), 10).view(np.uint64) for s in (one, np.r_[one, more])))
        halves = np.bitwise_count(x.view(np.uint32)).reshape(-1, 2).min(1)
        met += bool(((halves <= 2) & (np.bitwise_count(x) <= 13)).any())
    assert met >= least * 400


def owed(points, home, bits=13, both=33):
    """Pairs with a home point of which a half differs in 2 bits at most, by comparing all."""
    out = set()
    for i in np.flatnonzero(home):
        away = np.bitwise_count(points ^ points[i])
        half = np.bitwise_count((points[:, 0] ^ points[i, 0]).view(np.uint32)).reshape(-1, 2).min(1)
        near = (half <= 2) & (away[:, 0] <= bits) & (away.sum(1, dtype=int) <= both)
        out |= {(min(i, j), max(i, j)) for j in np.flatnonzero(near).tolist() if i != j}
    return out


@pytest.mark.parametrize("common", [300, 20])
def test_matched_pairs_are_those_owed(common):
    """Pairs of a large shard are found by equal pieces: with few near each all pairs, else what connects them."""
    rng = np.random.default_rng(2)
    flipped = lambda x, share: x ^ np.packbits(rng.random((len(x), 128)) < share, axis=1).view(np.uint64)
    base = rng.integers(0, 2**63, (3000, 2)).astype(np.uint64)
    hub = flipped(np.repeat(base[:1], 400, 0), 0.03)
    points = np.r_[base, flipped(base, 0.1), base[:50], hub]
    home = rng.random(len(points)) < 0.6
    found = simhash._Links(points, 13, 33)
    found.put_matched(home, 0, 2, 200, common)
    links = found.links()
    assert (home[links].any(1)).all() and (links[:, 0] < links[:, 1]).all()
    assert (np.bitwise_count(points[links[:, 0]] ^ points[links[:, 1]]).sum(1) <= 33).all()
    pairs = owed(points, home)
    single = {x for x in pairs if x[0] not in (0, 3000) and 0 < x[0] < 6000 and x[1] < 6000}
    assert len(single) > 1000 and single <= set(map(tuple, links.tolist()))
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links.tolist():
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    assert all(root(a) == root(b) for a, b in pairs)
    assert len(links) <= 4 * len(points)


def test_search_of_a_shard_compares_few_pairs(monkeypatch):
    """A point of a shard of 200,000 is compared with some dozens of others, not with thousands."""
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**63, (200_000, 2)).astype(np.uint64)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: compared.append(x.size) or count(x))
    found = simhash._Links(points, 13, 33)
    found.put_matched(np.ones(len(points), bool), 1, 2, 3200)
    assert sum(compared) <= 100 * len(points)


def test_documents_are_dealt_alike_however_many(spark, monkeypatch):
    """Trees have as many leaves in a larger table, so that no more copies of a document are dealt."""
    made, grow = [], simhash.VantageTree.__init__

    def counted(self, *args, **more):
        grow(self, *args, **more)
        made.append(self.n)

    monkeypatch.setattr(simhash.VantageTree, "__init__", counted)
    leaves = []
    for n in (2000, 8000):
        docs = spark.range(n).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 12), x -> sha2(concat(id, ' ', x), 256))) as text")
        found = simhash.similar_documents(docs.repartition(4), prints=2, shard_rows=50)
        assert found.where("doc_id = component_id").count() == found.count() == n
        leaves.append(sum(made) / len(made))
        made.clear()
    assert max(leaves) <= 40 and leaves[1] <= 1.3 * leaves[0]
