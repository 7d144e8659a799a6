"""SimHash near-duplicate detection: exact Hamming links through vantage-point trees.

Fingerprints of 64 bits spread so evenly that all lie about 32 bits from any vantage point; a tree
over whole fingerprints with radius 3 could hardly prune. But if two differ in ``bits`` at most, then
in one half of 32 bits they differ in ``bits // 2`` at most. So there is one tree a half, whose
triangle bounds are that much tighter, and every pair that meets is compared over all 64 bits.

A tree node holds a vantage point and a radius: points within it are dealt to the inner child, others
to the outer one. A fingerprint has one home leaf (its shard). Near a boundary it also visits the
shard beyond, where the triangle bound lets a partner be: visits only go from an inner to an outer
subtree, which meets each pair once. Trees are fitted on a bounded sample of fingerprints; that
sets how even the shards are, never which pairs are found: a shard that outgrew its leaf is dealt
again inside its task, by a tree fitted on a sample of itself. Shards are joined inside their tasks
by tiles; a shard yields a spanning forest of its links, never all pairs of a group.

``similar_documents`` finds texts of a Jaccard similarity of 0.8 or more, whose fingerprints differ in
about 10 of 64 bits, too many for triangle bounds. It gives each text several fingerprints, and a tree to
each half of each. Two texts meet if one half differs in ``reach`` bits at most; groups of texts that meet are then
compared by their exact similarity. A radius of 2 makes many visits at each level of a tree, so trees keep some
``shards`` leaves however many documents there are, and shards are searched by equal pieces of halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, pairwise, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, checkpointed, join_counted, space_words
from .components import connected_components
from .verify import similar_pairs

FINGERPRINT = T.StructField("fp", T.LongType())


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, as a signed 64-bit integer; zero without words."""
    words = space_words(text)
    if not words:
        return 0
    runs = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    n = len(runs[-1])
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    hashes = np.fromiter(map(digest, map(b" ".join, zip(*runs, strict=False))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_simhash(documents: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Adds fp: per bit, whether over half of the word shingles' XXH64 have it set. No shuffle."""

    def rows():
        return lambda texts: [[simhash(x, shingle) for x in texts]]

    return annotate(documents, rows, [FINGERPRINT], text, keep)


class VantageTree:
    """Vantage-point tree over the 32-bit halves of fingerprints."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        self.rng, self.leaf, self.n = np.random.default_rng(seed), leaf, 0
        self.root = self._grow(np.unique(sample))

    def _grow(self, points: np.ndarray):
        if len(points) > self.leaf:
            best = None
            for vantage in self.rng.choice(points, 4):
                away = np.bitwise_count(points ^ vantage)
                radius = int(np.median(away))
                inner = away <= radius
                if inner.all():
                    radius, inner = radius - 1, away <= radius - 1
                cost = abs(int(inner.sum()) * 2 - len(points)) + 2 * int((away == radius).sum())
                if 0 < inner.sum() and (best is None or cost < best[0]):
                    best = cost, vantage, radius, inner
            if best:
                _, vantage, radius, inner = best
                return int(vantage), radius, self._grow(points[inner]), self._grow(points[~inner])
        self.n += 1
        return self.n - 1

    def deal(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indices, whether it is their home) of all points; visitors reach that far."""
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at, home
                continue
            vantage, radius, inner, outer = node
            away = np.bitwise_count(points[at] ^ np.uint32(vantage)).astype(np.int16)
            into = np.where(home, away <= radius, away - reach <= radius)
            beyond = away + reach > radius
            stack.append((inner, at[into], home[into]))
            stack.append((outer, at[beyond], home[beyond] & (away[beyond] > radius)))


def _divided(
    points: np.ndarray, home: np.ndarray, half: int, reach: int, shard_rows: int, sample: int = 20_000
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, whether it is their home) of the shards that a shard of over 4 * ``shard_rows`` homes makes.

    Points whose halves are alike can't be parted; a shard that no tree divides stays whole.
    """
    stack = [(np.arange(len(points)), home)]
    while stack:
        at, own = stack.pop()
        parts = []
        if own.sum() > 4 * shard_rows:
            halves = np.ascontiguousarray(points[at].view(np.uint32).reshape(-1, 2)[:, half])
            picked = np.random.default_rng(len(at)).permutation(halves)[:sample]
            tree = VantageTree(picked, max(8, shard_rows * len(picked) // len(at)), seed=half)
            parts = [(at[i], is_home) for _, i, is_home in tree.deal(halves, reach)]
        if parts and max(len(i) for i, _ in parts) <= 0.75 * len(at):
            stack += parts
        else:
            yield at, own


def _shard_links(points: np.ndarray, home: np.ndarray, bits: int, cells: int = 1 << 21) -> np.ndarray:
    """(n, 2) indices: a spanning forest of the pairs that have a home point and differ in ``bits`` at most.

    A point is linked to the first one of each tree of the forest that it joins.
    """
    label = np.arange(len(points))
    homes, found = np.flatnonzero(home), []
    tile = max(1, min(512, cells // max(len(points), 1)))
    for at in range(0, len(homes), tile):
        rows = homes[at : at + tile]
        near = np.bitwise_count(points[rows, None] ^ points[None, :]) <= bits
        for i in np.flatnonzero(near.sum(1) > 1):
            others = np.flatnonzero(near[i])
            roots, first = np.unique(label[others], return_index=True)
            if len(roots) > 1:
                found += [(rows[i], j) for j in others[first[roots != label[rows[i]]]]]
                label[np.isin(label, roots[1:])] = roots[0]
    return np.array(found, np.int64).reshape(-1, 2)


def _masks(reach: int) -> list[int]:
    """Masks of 32 bits; two halves that differ in ``reach`` bits at most agree in all bits of one of them.

    Bits are cut into ``reach`` + 2 pieces, of which two make a mask.
    """
    edges = [32 * i // (reach + 2) for i in range(reach + 3)]
    return [sum((1 << j) - (1 << i) for i, j in two) for two in combinations(pairwise(edges), 2)]


class _Links:
    """Of pairs of ``points`` put in, a spanning forest, nearer pairs first, and each point's ``few`` nearest ones.

    Points have two fingerprints, pairs differ in ``bits`` of the first and ``both`` of both at most. Of a point that has
    over ``crowd`` partners, which many paths connect, the forest's pairs alone stay. Over ``held`` pairs
    are cut down to these, which loses nothing of those of all.
    """

    def __init__(self, points: np.ndarray, bits: int, both: int, few: int = 3, crowd: int = 64, held: int = 1 << 20):
        self.points, self.bits, self.both, self.few, self.crowd, self.held, self.n = points, bits, both, few, crowd, held, 0
        self.crowded = np.zeros(len(points), bool)
        self.pairs = [np.zeros((0, 2), np.int64)]

    def put(self, a: np.ndarray, b: np.ndarray) -> None:
        near = np.flatnonzero((self._away(a, b) <= self.both) & (a != b))
        self.pairs.append(np.c_[a[near], b[near]])
        self.n += len(near)
        if self.n > self.held:
            self.pairs = [self.links()]
            self.n = len(self.pairs[0])

    def _away(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.points[a] ^ self.points[b]).sum(1, dtype=np.uint8)

    def links(self) -> np.ndarray:
        """(n, 2) indices of the points."""
        pairs, n = np.concatenate(self.pairs), len(self.points)
        a, b = np.divmod(np.unique(pairs.min(1) * n + pairs.max(1)), max(n, 1))
        away = self._away(a, b)
        order = np.argsort(away, kind="stable")
        a, b, away = a[order], b[order], away[order]
        ends = np.c_[a, b].ravel()  # nearer pairs first, so that a point's nearest ones are its first
        order = np.argsort(ends, kind="stable")
        first = np.flatnonzero(np.diff(ends[order], prepend=-1))
        partners = np.diff(first, append=len(ends))
        self.crowded[ends[order[first[partners > self.crowd]]]] = True
        rank = np.arange(len(ends)) - np.repeat(first, partners)
        keep = np.zeros(len(a), bool)
        keep[order[rank < self.few] // 2] = True
        keep &= ~(self.crowded[a] | self.crowded[b])
        root, label = list(range(n)), np.arange(n)

        def of(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for at in np.split(np.arange(len(a)), np.flatnonzero(np.diff(away)) + 1):
            at = at[label[a[at]] != label[b[at]]]
            for k, i, j in zip(at.tolist(), a[at].tolist(), b[at].tolist(), strict=True):
                i, j = of(i), of(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
                    keep[k] = True
            if len(at):
                label = np.array(root)
                while (label != label[label]).any():
                    label = label[label]
        return np.c_[a, b][keep]

    def put_all(self, at: np.ndarray, home: np.ndarray, step: int = 4, kept: int = 1 << 26) -> None:
        """Of all pairs of these points that have a home point, puts in each home point's nearest ones and a spanning
        forest, nearer pairs first, by ``step`` bits.

        Distances are kept for all steps if there are ``kept`` at most, else computed at each.
        """
        points, label, homes = np.ascontiguousarray(self.points[at].T), np.arange(len(at)), np.flatnonzero(home)
        tile = max(1, min(512, (1 << 21) // max(len(at), 1)))
        tiles, partners = [homes[k : k + tile] for k in range(0, len(homes), tile)], np.zeros(len(at), np.int64)

        def away(rows: np.ndarray) -> np.ndarray:
            one, other = (np.bitwise_count(x[rows, None] ^ x[None, :]) for x in points)
            one[one > self.bits] = 255 - 64
            one += other
            one[np.arange(len(rows)), rows] = 255
            return one

        all_away = [away(rows) for rows in tiles] if len(homes) * len(at) <= kept else None
        for k, rows in enumerate(tiles):
            of = away(rows) if all_away is None else all_away[k]
            near = of <= self.both
            partners[rows] += near.sum(1)
            partners += np.where(home, 0, near.sum(0))
            few = np.argpartition(of, min(self.few, len(at)) - 1, 1)[:, : self.few]
            i, j = np.nonzero(np.take_along_axis(of, few, 1) <= self.both)
            self.put(at[rows[i]], at[few[i, j]])
        self.crowded[at[partners > self.crowd]] = True
        for most in [*range(self.both % step, self.both, step), self.both]:
            for k, rows in enumerate(tiles):
                near = (away(rows) if all_away is None else all_away[k]) <= most
                near &= label[rows, None] != label[None, :]
                for i in np.flatnonzero(near.any(1)):
                    others = np.flatnonzero(near[i])
                    others = np.r_[rows[i], others[label[others] != label[rows[i]]]]  # some may have been joined meanwhile
                    of = label[others]
                    if len(others) > 1:
                        roots, first = np.unique(of, return_index=True)
                        first = others[first[roots != label[rows[i]]]]
                        self.put(np.full(len(first), at[rows[i]]), at[first])
                        label[np.isin(label, roots[1:])] = roots[0]

    def put_matched(self, home: np.ndarray, half: int, reach: int, shard_rows: int, common: int = 300) -> None:
        """Puts in the pairs with a home point that in a half of the first fingerprint agree in one of ``_masks``.

        Those are all that differ in ``reach`` bits of a half at most, and more. Points that share a mask's value with
        over ``common`` are compared among themselves by tiles, in parts that ``_divided`` makes.
        """
        first = np.ascontiguousarray(self.points[:, 0])
        halves, often = first.view(np.uint32).reshape(-1, 2), np.zeros(len(first), bool)
        for i, mask in product((0, 1), _masks(reach)):
            key = halves[:, i] & np.uint32(mask)
            order = np.argsort(key)
            key, fps = key[order], first[order]
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            sizes = np.diff(edges)
            often[order[np.repeat(sizes > common, sizes)]] = True
            rows = np.flatnonzero(home[order] & np.repeat((sizes > 1) & (sizes <= common), sizes))
            starts = np.repeat(edges[:-1], sizes)[rows]
            sizes = np.repeat(sizes, sizes)[rows]
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(ends, np.arange(self.held, ends[-1], self.held)) if len(rows) else []
            for row, start, size in zip(*(np.split(x, cuts) for x in (rows, starts, sizes)), strict=True):
                x = np.repeat(row, size)
                y = np.arange(len(x)) + np.repeat(start - np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), size)
                near = np.flatnonzero(np.bitwise_count(fps[x] ^ fps[y]) <= self.bits)
                self.put(order[x[near]], order[y[near]])
        at = np.flatnonzero(often)
        for i, is_home in _divided(first[at], home[at], half, reach, shard_rows):
            self.put_all(at[i], is_home)


def hamming_links(fingerprints: DataFrame, bits: int = 3, shard_rows: int = 400, sample_rows: int = 100_000) -> DataFrame:
    """(a, b): a spanning forest of all pairs of distinct fingerprints that differ in ``bits`` at most.

    ``fingerprints`` has distinct values in column fp. At most ``sample_rows`` of them are collected
    to fit the trees, for shards of about ``shard_rows``; once the sample limits the leaves, these hold
    more and are divided in their tasks.
    """
    spark = fingerprints.sparkSession
    total = fingerprints.count()
    keep = min(1.0, 0.9 * sample_rows / max(total, 1))
    chosen = F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(1 << 30)) < int(keep * (1 << 30))
    sample = np.array([r.fp for r in fingerprints.where(chosen).limit(sample_rows).toLocalIterator()], np.int64)
    halves = sample.view(np.uint32).reshape(-1, 2)
    leaf = max(8, int(shard_rows * keep))
    trees = [VantageTree(halves[:, i], leaf, seed=i) for i in (0, 1)]
    shared, reach = spark.sparkContext.broadcast(trees), bits // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            base = 0
            for i, tree in enumerate(shared.value):
                found = list(tree.deal(np.ascontiguousarray(fps.view(np.uint32).reshape(-1, 2)[:, i]), reach))
                if found:
                    leaves = np.concatenate([np.full(len(at), base + leaf) for leaf, at, _ in found])
                    at, home = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaves.astype(np.int32)), pa.array(fps[at]), pa.array(home)], ["leaf", "fp", "home"]
                    )
                base += tree.n

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of_second = shared.value[0].n
        for leaf, fps, home in _by_leaf(batches):
            for at, own in _divided(fps, home, int(leaf >= first_of_second), reach, shard_rows):
                links = at[_shard_links(fps[at].view(np.uint64), own, bits)]
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[links[:, i]]) for i in (0, 1)], ["a", "b"])

    dealt = fingerprints.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean")
    return dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(join, "a long, b long")


def _by_leaf(batches: Iterator[pa.RecordBatch], columns: int = 3) -> Iterator[tuple]:
    """Each leaf with its points, from batches sorted by leaf."""
    rest = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        edges = np.flatnonzero(np.diff(rest[0])) + 1
        for i, j in zip(np.r_[0, edges], edges, strict=False):
            yield int(rest[0][i]), *(x[i:j] for x in rest[1:])
        if len(edges):
            rest = [x[edges[-1] :] for x in rest]
    if rest is not None and len(rest[0]):
        yield int(rest[0][0]), *rest[1:]


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, in order; none without words."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    runs = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*runs, strict=False))), np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` 64-bit fingerprints of a set of hashes: per bit, whether over half of the set's n-th mixes have it."""
    if not len(hashes):
        return np.zeros(n, np.int64)
    ones = np.zeros((n, 8, 8), np.int64)
    lanes = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        mixes = _mixed(part[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        runs = np.arange(0, len(part), 255)
        for bit in range(8):  # the same bit of all eight bytes is counted in eight lanes at once
            sums = np.add.reduceat((mixes >> np.uint64(bit)) & lanes, runs, axis=0)
            ones[:, :, bit] += sums.view(np.uint8).reshape(len(runs), n, 8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones.reshape(n, 64) > len(hashes), axis=1, bitorder="little").view(np.int64).ravel()


def similar_documents(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    prints: int = 10,
    reach: int = 2,
    bits: int = 13,
    both: int = 27,
    apart: float = 0.2,
    shard_rows: int = 3200,
    shards: int = 16,
    most_rows: int = 500_000,
    sample_rows: int = 100_000,
    hot_rows: int = 200_000,
    block_rows: int = 1000,
) -> DataFrame:
    """(id, component_id) of every document row.

    Documents are linked if the sets of their word shingles (of texts of fewer words: of the whole text)
    have a Jaccard similarity of ``similarity`` or more; component_id is the least id reachable over links.
    Texts of one set are one node of the graph, told by a 64-bit hash. Candidates are searched for by ``prints``
    fingerprints: pairs that meet in a shard and there differ in ``bits`` of 64 at most, and in ``both`` with a second
    fingerprint, of which a shard yields a spanning forest, nearer pairs first, and each text's nearest ones: two texts stay
    connected by pairs that are hardly farther apart. Trees have about ``shards`` leaves, and more only if these held over
    ``most_rows``. Those whose fingerprints
    differ in over ``apart`` of all bits (0.15 at similarity 0.8, give or take 0.014) are dropped. What the rest
    connects is a group, within which all pairs are compared exactly, see ``verify``. Over 90 % of pairs of similarity 0.8 meet, 98 % of 0.85 and all of 0.9, fewer if they have under some
    20 words; no pair that is less similar than asked for is linked. Ids must tell rows apart. Edge cases: texts without words are one node, linked to no
    other; a null id is the least where any is null, so give ids that aren't; repeated rows
    stay; an empty table gives none; other columns are not read.
    """
    spark = documents.sparkSession
    key = T.StructField("node", T.LongType())

    def rows():
        def of(texts):
            sets = [shingle_hashes(x, shingle) for x in texts]
            return [[xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets], [fingerprints(x, prints).tolist() for x in sets]]

        return of

    found = annotate(documents.select(id_col, text), rows, [key, T.StructField("fps", T.ArrayType(T.LongType()))], text, [id_col])
    found = checkpointed(found)
    nodes = checkpointed(found.groupBy("node").agg(F.min(id_col).alias("least"), F.count("*").alias("n"), F.any_value("fps").alias("fps")))
    total = nodes.count()
    keep = min(1.0, 0.9 * sample_rows / max(total, 1))
    chosen = F.pmod(F.xxhash64("node", F.lit("tree")), F.lit(1 << 30)) < int(keep * (1 << 30))
    sample = np.array([r.fps for r in nodes.where(chosen).select("fps").limit(sample_rows).toLocalIterator()], np.int64).reshape(-1, prints)
    halves = np.ascontiguousarray(sample).view(np.uint32)
    leaf_rows = min(max(shard_rows, total // shards), most_rows)
    trees = [VantageTree(halves[:, i], max(8, int(leaf_rows * keep)), seed=i) for i in range(2 * prints)]
    shared, firsts = spark.sparkContext.broadcast(trees), np.cumsum([0, *(t.n for t in trees)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            fps = batch.column(1).flatten().to_numpy().reshape(-1, prints)
            halves = np.ascontiguousarray(fps).view(np.uint32)
            for i, tree in enumerate(shared.value):
                dealt = list(tree.deal(np.ascontiguousarray(halves[:, i]), reach))
                at, home = np.concatenate([x[1] for x in dealt]), np.concatenate([x[2] for x in dealt])
                ends = pa.array(np.r_[0, np.cumsum([len(x[1]) for x in dealt])].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (fps[at, i // 2], fps[at, (i // 2 + 1 + i % 2) % prints], home, node[at])]
                yield pa.RecordBatch.from_arrays([pa.array(firsts[i] + np.array([x[0] for x in dealt], np.int32), pa.int32()), *lists], ["leaf", "fp", "other", "home", "node"])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.repeat(batch.column(0).to_numpy(), pa.compute.list_value_length(batch.column(1)).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(leaves), *(batch.column(i).flatten() for i in (1, 2, 3, 4))], ["leaf", "fp", "other", "home", "node"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf, fp, other, home, node in _by_leaf(points(batches), 5):
            order = np.argsort(node)
            node, home = node[order], home[order]
            found = _Links(np.c_[fp, other][order].view(np.uint64), bits, both)
            if home.sum() * len(node) <= 1 << 23:
                found.put_all(np.arange(len(node)), home)
            else:
                found.put_matched(home, (int(np.searchsorted(firsts, leaf, "right")) - 1) % 2, reach, shard_rows)
            links = node[found.links()]
            if len(links):
                pairs = [pa.array(links.min(1)), pa.array(links.max(1))]
                yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    dealt = nodes.select("node", "fps").mapInArrow(deal, "leaf int, fp array<long>, other array<long>, home array<boolean>, node array<long>")
    pairs = dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(join, "a long, b long")
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("fps").alias(f"fps_{c}"))
    differ = F.aggregate(F.zip_with("fps_a", "fps_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = pairs.where("a <> b").distinct().join(of("a"), "a").join(of("b"), "b").where(differ <= apart * 64 * prints)
    # What these reach, each from its least node, is a group.
    reached = connected_components(pairs.select("a", "b"))
    meant = checkpointed(reached.withColumnRenamed("root", "group").join(nodes.select("node", "least", "fps"), "node"))
    # Where they are few, documents stay where they are; else they are shuffled once.
    near = F.broadcast(meant) if meant.count() <= hot_rows else meant
    texts = near.join(documents.select(F.col(id_col).alias("least"), F.col(text).cast("binary").alias("text")), "least")
    links = similar_pairs(texts.select("group", "node", "fps", "text"), partial(shingle_hashes, shingle=shingle), similarity, apart, block_rows, meant)
    roots = connected_components(links)
    linked = checkpointed(nodes.join(roots, "node").select("node", "least", "n", "root"))
    groups = checkpointed(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")))
    alone = nodes.join(roots, "node", "left_anti").select("node", "n", F.col("least").alias("component_id"))
    grouped = join_counted(linked.select("node", "n", "root"), groups, "root", "prints").drop("root")
    of_node = checkpointed(alone.unionByName(grouped))
    return join_counted(found.select(id_col, "node"), of_node, "node").select(id_col, "component_id")


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3
) -> DataFrame:
    """(id, fp, component_id) of every document row.

    Documents are linked if their fingerprints differ in ``bits`` or fewer; component_id is the least
    id reachable over links. Copies share a fingerprint and are one node of the graph, whatever their
    number; neither they nor the fingerprints of one component make a hot task, see ``join_counted``. Edge cases: texts without words have fingerprint zero and are linked like any other; a row
    whose id is null gets a component too, whose id is null only if no member has one; repeated rows
    stay; an empty table gives none; other columns are not read.
    """
    prints = checkpointed(with_simhash(documents.select(id_col, text), text, shingle, keep=[id_col]))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    roots = connected_components(hamming_links(nodes, bits))
    linked = checkpointed(nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "n", "root"))
    groups = checkpointed(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")))
    alone = nodes.join(roots, nodes.fp == roots.node, "left_anti").withColumnRenamed("least", "component_id")
    grouped = join_counted(linked.select("fp", "n", "root"), groups, "root", "prints").drop("root")
    of_print = checkpointed(alone.unionByName(grouped))
    return join_counted(prints, of_print, "fp").select(id_col, "fp", "component_id")
