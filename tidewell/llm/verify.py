"""Exact similarity within groups of candidates, in blocks.

A group is what candidate links reach: it holds every pair of candidates, whichever of them the links themselves
were. So all its pairs are looked at, and none is lost because a third text stood between. A task gets two blocks
of a group's members, each with its fingerprints and its text, of which it makes a set of hashes, drops pairs whose fingerprints are
too far apart, skips those that links found before connect, and compares the rest exactly. In groups of more than a
block, members are first compared with the least one: those linked to it need no comparison with each other, so
that a large group of near copies is met by its few others only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_counted, written

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _root(label: list[int], i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = label[i]
    return i


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or small < similarity * large:
        return False
    both = int((np.take(b, np.searchsorted(b, a), mode="clip") == a).sum())
    return both >= similarity * (len(a) + len(b) - both)


def links_within(prints: np.ndarray, sets: list[np.ndarray], split: int, similarity: float, apart: float) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs: among all, or, if ``split`` is within, of one before it with one from
    it on. ``sets`` are distinct hashes in order; rows of ``prints`` that differ in over ``apart`` of their bits are no pair."""
    n = len(sets)
    label, out, limit = list(range(n)), [], apart * 64 * prints.shape[1]
    crosses = 0 < split < n
    for i in range(split if crosses else n):
        others = np.arange(split if crosses else i + 1, n)
        if not len(others):
            continue
        near = others[np.bitwise_count(prints[others] ^ prints[i]).sum(1, dtype=np.int64) <= limit]
        for j in near.tolist():
            x, y = _root(label, i), _root(label, j)
            if x != y and _similar(sets[i], sets[j], similarity):
                out.append((i, j))
                label[max(x, y)] = min(x, y)
    return out


def similar_pairs(
    members: DataFrame, of_text: Callable[[bytes], np.ndarray], similarity: float, apart: float, block_rows: int = 1000, groups: DataFrame | None = None
) -> DataFrame:
    """(a, b): links that connect what the similar pairs of each group connect, and no others.

    ``members`` has (group, node, fps, text), of which ``groups`` may have the first two at less cost: a group is named
    after its least node. ``of_text`` gives a text's distinct 64-bit hashes, in order.
    """
    sizes = (members if groups is None else groups).groupBy("group").agg(F.count("*").alias("rows"))
    wide = checkpointed(sizes.where(F.col("rows") > block_rows))
    some = wide.limit(1).count() > 0
    small = members.join(F.broadcast(wide), "group", "left_anti") if some else members
    whole = small.select(F.struct("group", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("pair"), F.lit(True).alias("first"), "node", "fps", "text")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "descending"), ("node", "ascending")])
        split = int(pa.compute.sum(table["first"]).as_py())
        if table.num_rows < 2 or not split:
            return _LINKS.empty_table()
        node = table["node"].to_numpy()
        prints = table["fps"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        sets = [of_text(x) for x in table["text"].to_pylist()]
        found = np.array(links_within(prints, sets, split, similarity, apart), np.int64).reshape(-1, 2)
        return pa.table([node[found[:, 0]], node[found[:, 1]]], schema=_LINKS)

    if not some:
        return whole.groupBy("pair").applyInArrow(search, "a long, b long")

    def compare(batches):
        for batch in batches:
            linked, seen, least = [], None, None
            for text, other in zip(batch.column("text").to_pylist(), batch.column("least").to_pylist(), strict=True):
                if other != seen:
                    seen, least = other, of_text(other)
                linked.append(_similar(of_text(text), least, similarity))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), pa.array(linked, pa.bool_())], ["group", "node", "linked"])

    # The least node of each wide group, with how many rows meet it.
    members = written(members.join(F.broadcast(wide.select("group")), "group"))
    least = members.where(F.col("node") == F.col("group")).select("group", F.col("text").alias("least")).join(F.broadcast(wide), "group")
    met = join_counted(members.select("group", "node", "text"), checkpointed(least), "group", "rows")
    met = checkpointed(met.mapInArrow(compare, "group long, node long, linked boolean"))
    ratio = lambda n: F.ceil(n / block_rows).cast("int")
    parts = met.groupBy("group").agg(F.count("*").alias("rows"), ratio(F.count_if(~F.col("linked"))).alias("others"), ratio(F.count_if("linked")).alias("own"))
    parts = checkpointed(parts.where("others > 0"))
    # Blocks 0 .. others - 1 of what isn't linked to the least, then those of what is: the first meet all, the second the first.
    dealt = join_counted(members.join(met.select("node", "linked"), "node"), parts, "group", "rows")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("own")).otherwise(F.col("others"))).cast("int") + F.when(F.col("linked"), F.col("others")).otherwise(0))
    last = F.when(F.col("linked"), F.col("others")).otherwise(F.col("others") + F.col("own"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), last - 1)))
    pair = F.struct("group", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"))
    dealt = dealt.select(pair.alias("pair"), (F.col("block") <= F.col("to")).alias("first"), "node", "fps", "text")
    found = whole.unionByName(dealt).groupBy("pair").applyInArrow(search, "a long, b long")
    return found.unionByName(met.where("linked and node <> group").select(F.col("group").alias("a"), F.col("node").alias("b")))
