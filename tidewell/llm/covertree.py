"""Near-duplicate embeddings: all pairs of a label above a cosine, by cover trees traversed two at a time.

Unit vectors whose cosine is c lie sqrt(2 - 2c) apart, so that a cosine is a distance and triangle bounds hold.
A cover tree keeps nested levels of centres: each level's radius is half the one's above, each centre is its own
first child, and every node knows the distance of its farthest descendant. Two nodes are traversed together:

- if their centres are farther apart than both covering radii and the distance asked for, no pair links;
- if even their farthest members are within that distance, all pairs link, and are counted, not listed;
- else their children meet, in one matrix product.

Vectors are divided among tasks by label, then by the cells of a few pivots, the upper level of a tree that a
bounded sample fits, then by number; cells too far apart never meet. The sample sets how even the cells are and
how many of them meet, never which pairs are found. A task yields a row a vector: how many it links to here, and
the root of its links here. So a group of near copies never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sumprod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, join_counted
from .components import connected_components

#: Distances of unit vectors that a matrix product gives are off by less than this, however near they are.
SLACK = 1e-6
#: Cosines this near the one asked for are computed again, exactly rounded, so that no order of sums decides.
CLOSE = 1e-9


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; none is zero."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(points: np.ndarray, at: np.ndarray, away: np.ndarray, radius: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Divides ``at`` into (members, distances from their centre, which is the first), centres over ``radius`` apart.

    The first group's centre is ``at[0]``, from which ``away`` are the distances.
    """
    near = away <= radius
    yield at[near], away[near]
    at = at[~near]
    while len(at):
        distances = _apart(points[at[:block]], points[at])
        left = np.ones(len(at), bool)
        for i in range(min(block, len(at))):
            if left[i]:
                distances[i, i] = 0
                own = np.flatnonzero(left & (distances[i] <= radius))
                own = np.r_[i, own[own != i]]
                left[own] = False
                yield at[own], distances[i][own]
        at = at[left]


class CoverTree:
    """``order`` lists the points so that those below node i are ``order[lo[i]:hi[i]]``, its centre first."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.radius, self.children = [0], [len(points)], [0.0], {}
        away = _apart(points[:1], points)[0]
        away[0] = 0
        stack = [(0, away, 2.0)]
        while stack:
            node, away, level = stack.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo == 1:
                continue
            reach = float(away.max())
            self.radius[node] = max(reach, CLOSE)  # only single points have none
            while level >= reach and level > SLACK:
                level /= 2
            members = self.order[lo:hi].copy()
            # Points that can't be told apart are all children.
            parts = net(points, members, away, level) if reach > SLACK else (([m], [0.0]) for m in members)
            first, place = len(self.lo), lo
            for own, distances in parts:
                self.order[place : place + len(own)] = own
                self.lo.append(place)
                self.hi.append(place + len(own))
                self.radius.append(0.0)
                if len(own) > 1:
                    stack.append((len(self.lo) - 1, distances, level))
                place += len(own)
            self.children[node] = np.arange(first, len(self.lo))
        self.lo, self.hi, self.radius = np.array(self.lo), np.array(self.hi), np.array(self.radius)

    def below(self, node: int) -> np.ndarray:
        return self.children.get(node, np.array([node]))


class Links:
    """Links between points, as counts and as a graph of which only a spanning forest is kept."""

    def __init__(self, n: int, keep: int = 1 << 20):
        self.label, self.steps, self.a, self.b, self.n, self.keep = np.arange(n), np.zeros(n + 1), [], [], 0, keep

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > self.keep:
            self.roots()

    def count(self, lo: np.ndarray, hi: np.ndarray, by: np.ndarray) -> None:
        """All points of lo..hi link to ``by`` more."""
        np.add.at(self.steps, lo, by)
        np.subtract.at(self.steps, hi, by)

    def roots(self) -> np.ndarray:
        """The least point that each reaches."""
        label, a, b = self.label, np.concatenate([*self.a, []]).astype(np.int64), np.concatenate([*self.b, []]).astype(np.int64)
        self.a, self.b, self.n = [], [], 0
        while len(a):
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, up := label[label]):
                label = up
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]
        self.label = label
        return label

    def counts(self) -> np.ndarray:
        return np.rint(np.cumsum(self.steps)[:-1]).astype(np.int64)


def traverse(a: np.ndarray, weight_a: np.ndarray, b: np.ndarray | None, weight_b: np.ndarray | None, cosine: float, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row of ``a``, then of ``b``: how many rows it links to, each counted ``weight`` times, and
    the row that stands for all that these links reach. Without ``b``, rows of ``a`` meet each other.
    """
    reach = float(np.sqrt(max(2 - 2 * cosine, 0)))
    one = CoverTree(a)
    two = one if b is None else CoverTree(b)
    shift = 0 if b is None else len(a)
    points = [a[one.order], a[one.order] if b is None else b[two.order]]
    weights = [weight_a[one.order], weight_a[one.order] if b is None else weight_b[two.order]]
    sums = [np.r_[0, np.cumsum(w)].astype(float) for w in weights]
    links, whole = Links(len(a) + (0 if b is None else len(b))), set()

    def meet(xs: np.ndarray, ys: np.ndarray, same: bool) -> None:
        for at in range(0, len(xs), tile):
            rows = xs[at : at + tile]
            near = points[0][one.lo[rows]] @ points[1][two.lo[ys]].T
            radii = one.radius[rows][:, None] + two.radius[ys][None, :]
            apart = np.sqrt(np.maximum(2 - 2 * near, 0))
            open_ = apart <= reach + radii + SLACK
            if same:
                open_ &= (np.arange(len(rows)) + at)[:, None] < np.arange(len(ys))[None, :]
            i, j = np.nonzero(open_)
            near, apart, radii = near[i, j], apart[i, j], radii[i, j]
            single = radii == 0
            linked = single & (near >= cosine)
            for k in np.flatnonzero(single & (np.abs(near - cosine) <= CLOSE)):
                x, y = points[0][one.lo[rows[i[k]]]], points[1][two.lo[ys[j[k]]]]
                linked[k] = sumprod(x.tolist(), y.tolist()) >= cosine
            all_ = ~single & (apart + radii <= reach - SLACK)
            both = linked | all_
            x, y = rows[i[both]], ys[j[both]]
            links.count(one.lo[x], one.hi[x], sums[1][two.hi[y]] - sums[1][two.lo[y]])
            links.count(two.lo[y] + shift, two.hi[y] + shift, sums[0][one.hi[x]] - sums[0][one.lo[x]])
            links.add(one.lo[x], two.lo[y] + shift)
            x, y = rows[i[all_]], ys[j[all_]]
            whole.update(zip(one.lo[x].tolist(), one.hi[x].tolist(), strict=True))
            whole.update(zip((two.lo[y] + shift).tolist(), (two.hi[y] + shift).tolist(), strict=True))
            rest = ~(single | all_)
            x, y = rows[i[rest]], ys[j[rest]]
            # The wider node is opened, once for all that it meets; both, if they are about as wide.
            open_x, open_y = 2 * one.radius[x] >= two.radius[y], 2 * two.radius[y] >= one.radius[x]
            both = open_x & open_y
            stack.extend((one.below(p), two.below(q)) for p, q in zip(x[both].tolist(), y[both].tolist(), strict=True))
            stack.extend((one.below(p), y[~open_y & (x == p)]) for p in np.unique(x[~open_y]).tolist())
            stack.extend((x[~open_x & (y == q)], two.below(q)) for q in np.unique(y[~open_x]).tolist())

    stack: list[tuple] = [(0,) if b is None else (np.array([0]), np.array([0]))]
    while stack:
        x, *y = stack.pop()
        if not y:  # a node with itself
            if one.hi[x] - one.lo[x] == 1:
                continue
            if 2 * one.radius[x] <= reach - SLACK:
                lo, hi = one.lo[x : x + 1], one.hi[x : x + 1]
                links.count(lo, hi, sums[0][hi] - sums[0][lo])
                links.steps[lo[0] : hi[0]] -= weights[0][lo[0] : hi[0]]
                links.steps[lo[0] + 1 : hi[0] + 1] += weights[0][lo[0] : hi[0]]
                whole.add((int(lo[0]), int(hi[0])))
                continue
            stack.extend((int(c),) for c in one.below(x))
            meet(one.below(x), one.below(x), True)
        else:
            meet(x, y[0], False)
    for lo, hi in whole:
        links.add(np.arange(lo + 1, hi), np.full(hi - lo - 1, lo))
    order = one.order if b is None else np.r_[one.order, two.order + shift]
    counts, label = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    counts[order], label[order] = links.counts(), order[links.roots()]
    return counts, label


def _pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of the first level of a tree that has as many, or of the last."""
    level, centres = 2.0, sample[:1]
    while len(centres) < wanted and level > SLACK:
        level /= 2
        away = _apart(sample[:1], sample)[0]
        away[0] = 0
        centres = sample[[own[0] for own, _ in net(sample, np.arange(len(sample)), away, level)]]
    return centres[:wanted]


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(values.reshape(len(column), -1)) if len(column) else values.reshape(0, 1)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.93,
    shard_rows: int = 2048,
    pivots: int = 256,
    sample_values: int = 1 << 21,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row, exact.

    Rows of one label whose cosine, in double precision, is ``cosine`` or more are linked: n_links counts the
    others, component_id is the least id reachable, kept is whether that is the row's own. ``cosine`` is above 0.
    Copies are one node with a number, so that none make a hot group. A label with over 1 / ``pivots`` of all
    rows gets a share of that many pivots, fitted on a sample of at most ``sample_values`` numbers that passes the
    driver; cells hold about ``shard_rows`` vectors, larger ones are divided by number. A vector goes to each cell
    that its own may have links with, so that the work of a label grows with the square of what isn't pruned.
    Edge cases: a vector that is null, empty or zero, or holds null or non-finite components, and one without a label,
    links with nothing; so do vectors of other lengths among each other. Rows whose id repeats are rows of their
    own, each kept if its id is its component's; a null id counts as none where a component has another, and
    is kept where it hasn't. An empty table gives none; other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    doubles = F.transform(v, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    takes_part = v.isNotNull() & F.col(label).isNotNull() & ~F.exists(doubles, bad) & F.exists(doubles, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.when(takes_part, F.xxhash64(label, v)).alias("node"), F.col(label).alias("label"), v.alias("v")
    )
    known = rows.where("node is not null").withColumn("width", F.size("v"))
    nodes = known.groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("width").alias("width"), F.any_value("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("n")
    )
    nodes = checkpointed(nodes)
    cells, meets = _cells(nodes, cosine, shard_rows, pivots, sample_values)

    cell = F.struct("label", "width", "cell")
    sizes = cells.groupBy("label", "width", "cell").agg(F.count("*").alias("rows"))
    sizes = checkpointed(sizes.select(cell.alias("key"), "rows", F.ceil(F.col("rows") / shard_rows).cast("int").alias("pieces")))
    placed = join_counted(cells.withColumn("key", cell).drop("label", "width", "cell"), sizes, "key", "rows")
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("node", F.lit("piece")), "pieces").cast("int"))
    own = F.array(F.struct(F.col("key.cell").alias("cell"), F.col("pieces").alias("pieces")))
    if meets:
        partners = spark.createDataFrame(meets, T.StructType([T.StructField("key", sizes.schema["key"].dataType), T.StructField("other", T.IntegerType())]))
        partners = partners.join(sizes.select(F.struct("key.label", "key.width", F.col("key.cell").alias("other")).alias("far"), "pieces"), F.col("far") == F.struct("key.label", "key.width", "other"))
        # At most ``pivots`` rows, of as many partners: those of labels with pivots.
        partners = partners.groupBy("key").agg(F.collect_list(F.struct(F.col("other").alias("cell"), "pieces")).alias("partners"))
        placed = placed.join(F.broadcast(partners), "key", "left")
    else:
        placed = placed.withColumn("partners", F.lit(None).cast("array<struct<cell:int,pieces:int>>"))
    sent = placed.withColumn("to", F.explode(F.coalesce("partners", own)))
    sent = sent.withColumn("to_piece", F.explode(F.sequence(F.lit(0), F.col("to.pieces") - 1)))
    here, there = F.struct(F.col("key.cell").alias("cell"), F.col("piece").alias("piece")), F.struct(F.col("to.cell").alias("cell"), F.col("to_piece").alias("piece"))
    sent = sent.select(
        F.struct("key.label", "key.width", F.least(here, there).alias("a"), F.greatest(here, there).alias("b")).alias("pair"),
        (here <= there).alias("first"),
        (here == there).alias("alone"),
        "node", "v", "n",
    )

    def search(group: pa.Table) -> pa.Table:
        # Rows come in the order of their nodes, so that copies of a task give the same roots.
        group = group.sort_by("node")
        first = group["first"].to_numpy()
        sides = [group.filter(pa.array(x)) for x in (first, ~first)]
        if not sides[0].num_rows or not (sides[1].num_rows or group["alone"][0].as_py()):
            return _FOUND.empty_table()
        (a, wa), (b, wb) = ((_rows(s["v"]), s["n"].to_numpy()) for s in sides)
        counts, root = traverse(a, wa, b, wb, cosine) if len(b) else traverse(a, wa, None, None, cosine)
        node = np.concatenate([s["node"].to_numpy() for s in sides])
        there = counts > 0
        return pa.table([node[there], counts[there], node[root[there]]], schema=_FOUND)

    found = checkpointed(sent.groupBy("pair").applyInArrow(search, "node long, links long, root long"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = checkpointed(nodes.select("node", "least", "n").join(sums, "node", "left").join(roots, "node", "left"))
    groups = linked.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    grouped = join_counted(linked.where("root is not null"), checkpointed(groups), "root", "nodes").drop("root")
    alone = linked.where("root is null").drop("root").withColumn("component_id", F.col("least"))
    of_node = grouped.unionByName(alone).select("node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    met = join_counted(rows.select("id", "node").where("node is not null"), checkpointed(of_node), "node").select("id", "n_links", "component_id")
    others = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return met.unionByName(others).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _cells(nodes: DataFrame, cosine: float, shard_rows: int, pivots: int, sample_values: int) -> tuple[DataFrame, list]:
    """Nodes with their cell, and the pairs of cells of a label that may have links, as ((label, width, cell), other).

    Labels without pivots are one cell, which meets itself. What passes the driver is bounded: the sample, and as
    many cells as there are pivots.
    """
    spark = nodes.sparkSession
    total, width = nodes.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(1))).first()
    sizes = nodes.groupBy("label", "width").agg(F.count("*").alias("rows")).where((F.col("rows") > shard_rows) & (F.col("rows") * pivots > total))
    large = {(r.label, r.width): r.rows for r in sizes.collect()}  # fewer than ``pivots``
    fitted: dict[tuple, np.ndarray] = {}
    if large:
        n_sample = max(64, min(16 * pivots, sample_values // width))
        chosen = F.pmod(F.xxhash64("node", F.lit("pivots")), F.lit(1 << 30)) < int(min(1.0, 0.9 * n_sample / total) * (1 << 30))
        sample: dict[tuple, list] = {}
        for r in nodes.where(chosen).select("label", "width", "v").limit(n_sample).toLocalIterator():
            sample.setdefault((r.label, r.width), []).append(r.v)
        for key, rows in sample.items():
            if key in large:
                wanted = min(-(-large[key] // shard_rows), pivots * large[key] // total)
                fitted[key] = _pivots(unit_rows(np.array(rows, np.float64)), max(1, wanted))
    shared = spark.sparkContext.broadcast(fitted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            keys = list(zip(batch.column("label").to_pylist(), batch.column("width").to_pylist(), strict=True))
            for key in set(keys) & shared.value.keys():
                at = np.flatnonzero([k == key for k in keys])
                apart = _apart(_rows(batch.column("v").take(pa.array(at))), shared.value[key])
                cell[at], away[at] = apart.argmin(1), apart.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    source = nodes.select("node", "label", "width", "v", "n")
    cells = source.mapInArrow(deal, T.StructType([*source.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    if not fitted:
        return cells.drop("away"), []
    cells, meets, reach = checkpointed(cells), [], float(np.sqrt(2 - 2 * cosine))
    fit = F.broadcast(spark.createDataFrame([(*key,) for key in fitted], T.StructType([nodes.schema["label"], nodes.schema["width"]])))
    radii: dict[tuple, dict[int, float]] = {}
    for r in cells.join(fit, ["label", "width"]).groupBy("label", "width", "cell").agg(F.max("away").alias("radius")).collect():
        radii.setdefault((r.label, r.width), {})[r.cell] = r.radius
    for key, own in radii.items():
        apart = _apart(fitted[key], fitted[key])
        meets += [((*key, i), j) for i in own for j in own if i == j or apart[i, j] <= own[i] + own[j] + reach + 2 * SLACK]
    return cells.drop("away"), meets
