"""Exact top-k search by integer inner product.

Queries are dealt to tiles and all rows to shards, by hashes, so that a tile and a shard have a bounded
number of rows. Each (tile, shard) pair is one group: its task multiplies them piece by piece, selects the
best of each query in the piece, and merges them into the list it holds, k a query. The lists of all
shards are then merged as a tree of ``fan_in`` lists a step. Nothing passes through the driver but counts.
Rows that are alike are one row with a number of copies, so that none make a hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: The score of no candidate; its negative is a long too.
_LEAST = -np.iinfo(np.int64).max
_FOUND = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component) as longs; rows with a null id, vector or component, or with a
    component that is not finite, take no part."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        vectors.where(F.col(id_col).isNotNull() & v.isNotNull())
        .where(~F.exists(v, bad))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()].to_numpy().reshape(-1, width)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores, ties to the smaller id; rows come with ids of their own."""
    if scores.shape[1] > k:
        floor = np.partition(scores, -k, axis=1)[:, -k]
        n_above = (scores >= floor[:, None]).sum(1)
        width = int(n_above.max())
        if width > 4 * k:  # many ties: only then sort whole rows
            order = np.lexsort((ids, -scores), axis=1)[:, :k]
            return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        at = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else None
        if at is not None:
            ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: by floating point if every sum stays below 2**53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    scale: int = 64,
    query_rows: int = 16_384,
    shard_rows: int = 16_384,
    piece: int = 512,
    fan_in: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, all if fewer.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own;
    ties go to the smaller id. A tile has about ``query_rows`` queries, a shard about ``shard_rows``
    candidates; each query is sent to all shards and each candidate to all tiles.
    Edge cases: see ``quantised`` for rows that take no part,
    as do vectors whose length isn't the one of the most rows (then of the longest); each row with an id
    that repeats is a query of its own, with a list of its own, and a candidate of its own; an empty table,
    or one without queries, gives none; other columns are not read.
    """
    rows = quantised(vectors, id_col, vector, scale)
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).take(1)
    width = sizes[0].width if sizes else 0
    mark = F.xxhash64("id", "v")
    rows = rows.where(F.size("v") == width).groupBy("id", "v").agg(F.count("*").alias("copies"))
    rows = checkpointed(rows.select("id", mark.alias("mark"), "v", "copies"))
    asks = F.col("id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(asks)).first()
    tiles, shards = max(1, -(-n_queries // query_rows)), max(1, -(-n // shard_rows))
    place = lambda n: F.pmod(F.xxhash64("mark", F.lit("place")), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(asks).select(place(tiles).alias("tile"), everywhere(shards).alias("shard"), "id", "mark", "v")
    others = rows.select(everywhere(tiles).alias("tile"), place(shards).alias("shard"), *(F.col(c).alias(f"held_{c}") for c in rows.columns))

    def search(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _FOUND.empty_table()
        names, marks, q = _columns(asked, "", width)
        ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0), np.int64)
        for at in range(0, held.num_rows, piece):
            own, own_marks, v = _columns(held.slice(at, piece), "held_", width)
            # No list needs more than k copies beside the query's own row.
            times = np.minimum(held["held_copies"].slice(at, piece).to_numpy(), k + 1)
            s = np.repeat(_product(q, v), times, axis=1)
            first = np.r_[0, np.cumsum(times)[:-1]]
            row, column = np.nonzero((marks[:, None] == own_marks[None, :]) & (names[:, None] == own[None, :]))
            s[row, first[column]] = _LEAST
            best = _top(np.broadcast_to(np.repeat(own, times), s.shape), s, k)
            ids, scores = _top(np.hstack([ids, best[0]]), np.hstack([scores, best[1]]), k)
        there = (scores != _LEAST).ravel()
        columns = [np.repeat(x, ids.shape[1])[there] for x in (names, marks)] + [ids.ravel()[there], scores.ravel()[there]]
        columns.insert(2, np.full(len(columns[0]), key[1].as_py(), np.int32))
        return pa.table([pa.array(x) for x in columns], schema=_FOUND)

    by = ["tile", "shard"]
    found = queries.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(
        search, "query_id long, mark long, part int, vec_id long, score long"
    )
    while shards > fan_in:
        found = _merged(found.withColumn("part", F.expr(f"part div {fan_in}")), ["query_id", "mark", "part"], k).drop("rank")
        shards = -(-shards // fan_in)
    found = _merged(found, ["query_id", "mark"], k)
    again = rows.where(asks & (F.col("copies") > 1)).select(F.col("id").alias("query_id"), "mark", "copies")
    found = found.join(again, ["query_id", "mark"], "left")
    times = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))).alias("copy")
    return found.select("query_id", "rank", "vec_id", "score", times).drop("copy")


def _columns(rows: pa.Table, prefix: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    id_, mark, v = (rows[f"{prefix}{c}"] for c in ("id", "mark", "v"))
    return id_.to_numpy(), mark.to_numpy(), _matrix(v.combine_chunks(), width)


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
