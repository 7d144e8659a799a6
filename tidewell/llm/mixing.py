"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

DataFrame functions only. Words of a source are split into shards (about the square root of its
documents many, so that neither a shard nor a source's list of shards is large for one task), the
words of a shard into blocks of ``block`` words along a seeded order of its documents. Block quotas go
to sources, then from each source to its shards, by highest quotients ``claim / (2 s + 1)``. Only
seats whose quotient may be near the last winning one are listed and ranked: with n claimants and m
blocks, round-half-down of claim * (m - n/2) / total is surely won, and at most about 2 n more seats
compete. Within a shard every block is taken ``quota div blocks`` times, and ``quota mod blocks`` of
them once more: those at a seeded, evenly spaced set of places in the seeded order of documents.
A row's shard and place go by a hash of its id, source and text. Copies in all of these of over
``copy_share`` of all rows (and of 1,000) are a shard of their own, in which a copy's place is its number: copies are
numbered within each partition of the input, which makes no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

_SPACE = r"[ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    parts = F.size(F.array_remove(F.split(text, _SPACE), ""))
    return F.coalesce(F.when(text.isNotNull(), parts), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target to (source, weight, source_size): ``share`` of all words by weight, capped.

    A target stops at ``most`` times its source's size; the excess is shared again by weight until
    none is above. Solved in one pass: in order of cap / weight the capped sources come first, and
    each place has the level (words a weight) at which all sources from there on would be filled. A source
    of weight 0 has target 0.
    """
    order = W.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.when(F.col("weight") > 0, F.col("source_size") * F.lit(float(most))).otherwise(0.0)
    capped = sources.withColumn("cap", cap).withColumn("full", F.coalesce(F.try_divide("cap", "weight"), F.lit(-1.0)))
    words = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    placed = capped.withColumn("level", F.try_divide(words, weights))
    # From the first source that its level doesn't fill, all get that level.
    first = F.min(F.when(F.col("full") > F.col("level"), F.struct("full", F.col("source").isNull(), "source", "level")))
    placed = placed.withColumn("first", first.over(everything))
    shared = F.when(F.col("full") >= F.col("first.full"), F.col("first.level") * F.col("weight"))
    return placed.withColumn("target", F.coalesce(F.least("cap", shared), "cap")).drop("cap", "full", "level", "first")


def sainte_lague(claims: DataFrame, by: list[str], key: str, claim: str, seats: str, most: str) -> DataFrame:
    """Adds quota: whole seats by highest quotients within each group ``by``.

    Columns: ``claim`` (0 or more), ``seats`` (of the whole group), ``most`` (bound of a quota).
    Equal quotients go in order of ``key``, which names a claimant within its group, nulls last.
    """
    group = W.partitionBy(*by)
    a = claims.withColumns({"__total": F.sum(claim).over(group), "__n": F.count("*").over(group)})
    rate = lambda m: F.coalesce(F.try_divide(m, F.col("__total")), F.lit(0.0)) * F.col(claim)
    sure = F.floor(rate(F.greatest(F.col(seats) - F.col("__n") / 2 - 1, F.lit(0.0))))
    last = F.when(F.col(claim) > 0, F.ceil(rate(F.col(seats) + F.col("__n") / 2 + 1)) + 1).otherwise(0)
    a = a.withColumns({"__sure": F.least(sure, most), "__last": F.least(last, most)})
    a = a.withColumn("__left", F.col(seats) - F.sum("__sure").over(group))
    # Seats from sure to last - 1 compete; a claimant without any keeps one row that can't win.
    compete = F.when(F.col("__last") > F.col("__sure"), F.sequence(F.col("__sure"), F.col("__last") - 1))
    a = a.withColumn("__seat", F.explode_outer(compete))
    quotient = F.col(claim) / (2 * F.col("__seat") + 1)
    place = F.row_number().over(group.orderBy(quotient.desc_nulls_last(), F.col(key).asc_nulls_last(), "__seat"))
    a = a.withColumn("__won", (F.col("__seat").isNotNull() & (place <= F.col("__left"))).cast("long"))
    won = a.groupBy(*claims.columns, "__sure").agg(F.sum("__won").alias("__won"))
    return won.withColumn("quota", F.col("__sure") + F.col("__won")).drop("__sure", "__won")


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: DataFrame | None = None,
    cycle: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = 32,
    seed: int = 17,
    carry: list[str] | None = None,
    copy_share: float = 1e-3,
) -> DataFrame:
    """(id, source, columns to carry, size, source_size, target, taken) of every document row.

    size counts words; target is what the document's source should give, taken what the mix takes of
    the document, repeats counted. Weights are (source, weight), 0 for sources not in it, or else
    ``cycle`` over the sources by code point, null last. Targets: see ``targets``. A block that begins
    or ends inside a document takes a part of it. Each source's taken words come within about half a
    block a shard of its target, no document is taken over ``most`` times, and the same rows give the
    same mix in any order. The input is read several times; if it has hot copies and columns to carry, it
    must deal its rows to the same partitions each time, as files do. Edge cases: null and wordless texts have size and taken 0; a null source is
    a source; null or repeated ids are rows like any other; an empty table gives an empty mix; columns
    that are not carried are not read.
    """
    carried = {f"__{c}": c for c in carry or []}
    whole = documents.select(
        F.col(id_col).alias("id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(source), F.col(text)).alias("row"),
        *(F.col(c).alias(new) for new, c in carried.items()),
    )
    sized = checkpointed(whole.select("id", "source", "size", "row"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    if weights is None:
        rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
        sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle)) + 1))
    else:
        named = weights.select(F.col("source").alias("__source"), "weight")
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        sources = sources.withColumn("weight", F.coalesce("weight", F.lit(0)))
    sources = targets(sources, share, most)
    words = F.sum("target").over(W.partitionBy())
    sources = sources.withColumns(
        {"blocks": F.round(words / block), "most": F.ceil(F.col("source_size") * most / block), "shards": F.ceil(F.sqrt("rows"))}
    )
    sources = checkpointed(sainte_lague(sources, [], "source", "target", "blocks", "most"))

    s = sources.select(F.col("source").alias("s"), "source_size", "target", "shards", F.col("quota").alias("source_quota"))
    total = sized.count()
    copies = sized.where("size > 0").groupBy("row").agg(F.count("*").alias("copies"))
    hot = checkpointed(copies.where(F.col("copies") > max(copy_share * total, 1000)))  # under 1 / copy_share rows
    shard = F.when(F.col("copies").isNotNull(), -1 - F.pmod("row", F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("row", F.lit("shard")), "shards"))

    def deal(rows: DataFrame) -> DataFrame:
        met = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s").join(F.broadcast(hot), "row", "left")
        return met.withColumn("shard", shard).drop("copies")

    shards = deal(sized).groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota")
    )
    n = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))
    shards = shards.withColumns({"n": n, "shard_most": F.ceil(F.col("shard_size") / block) * most})
    shards = sainte_lague(shards, ["source"], "shard", "shard_size", "source_quota", "shard_most").select(
        F.col("source").alias("s"), F.col("shard").alias("h"), "n", "quota"
    )
    dealt = deal(whole if carried else sized)
    order = W.partitionBy("source", "shard").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.where("shard >= 0").withColumn("end", F.sum("size").over(order))
    if hot.count():
        parted = deal((whole if carried else sized).withColumn("part", F.spark_partition_id())).where("shard < 0")
        held = parted.groupBy("row", "part").agg(F.count("*").alias("held"))
        before = W.partitionBy("row").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        held = held.select("row", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
        number = F.col("before") + F.row_number().over(W.partitionBy("row", "part").orderBy("size"))
        numbered = parted.join(held, ["row", "part"]).withColumn("end", number * F.col("size")).drop("part", "before")
        placed = placed.unionByName(numbered)
    dealt = placed.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).drop("s", "h")
    dealt = dealt.withColumns(
        {
            "every": F.expr("quota div n"),
            "extra": F.expr("quota % n"),
            "start": F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), "n"),
        }
    )
    dealt = dealt.withColumn("taken", F.col("every") * F.col("size") + _chosen("end", block) - _chosen("end - size", block))
    names = [F.col("id").alias(id_col), F.col("source").alias(source), *(F.col(new).alias(c) for new, c in carried.items())]
    return dealt.select(*names, "size", "source_size", "target", "taken")


def _chosen(place: str, block: int) -> Column:
    """Of a shard's first words, as many as ``place``: how many lie in blocks that are taken once more.

    Before block k are (k * extra + start) div n such blocks.
    """
    before = lambda k: f"((({k}) * extra + start) div n)"
    k = f"(({place}) div {block})"
    inside = f"({before(f'{k} + 1')} - {before(k)}) * (({place}) - {k} * {block})"
    return F.expr(f"{block} * {before(k)} + {inside}")
