"""Keys of a large table, kept so that a batch of new rows is checked without shuffling them.

The keys are a table bucketed and sorted by themselves: a join with them shuffles the batch to their buckets and
leaves them where they are. In front of it stands a sketch, one bit a key by its hash: a batch's key whose bit
isn't set is surely new, and only the others are looked up. A batch of new keys alone reads no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions.
BITS = 32_768


class Keys:
    """Keys in the table ``name`` of the session's catalog, with their sketch in the table ``name_sketch``."""

    def __init__(self, spark: SparkSession, name: str, keys: list[str]):
        self.spark, self.name, self.keys = spark, name, keys

    @classmethod
    def write(cls, df: DataFrame, name: str, keys: list[str], buckets: int = 64, bitmaps: int = 256, path: str | None = None) -> Keys:
        """Distinct keys without nulls, which break no constraint; in the warehouse, or below ``path``. The sketch has ``bitmaps`` * 32,768 bits (a megabyte
        at 256): a new key is looked up in vain with the share of bits that are set."""
        own = cls(df.sparkSession, name, keys)
        distinct = df.select(*keys).dropna().distinct()
        at = lambda part: {} if path is None else {"path": f"{path}/{part}"}
        distinct.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name, **at("keys"))
        bit = own._bit(bitmaps)
        sketch = own.table().select(bit.alias("bit")).groupBy(F.expr(f"bit div {BITS}").alias("bitmap")).agg(F.bitmap_construct_agg(F.col("bit") % BITS).alias("bits"))
        sketch.withColumn("bitmaps", F.lit(bitmaps)).coalesce(1).write.mode("overwrite").saveAsTable(f"{name}_sketch", **at("sketch"))
        return own

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def maybe(self, rows: DataFrame) -> DataFrame:
        """Adds __maybe: whether the row's key may be here. The sketch is as large as it was made, and broadcast."""
        sketch = self.spark.table(f"{self.name}_sketch")
        bitmaps = sketch.select("bitmaps").first()
        if bitmaps is None:
            return rows.withColumn("__maybe", F.lit(False))
        bit = self._bit(bitmaps[0])
        known = sketch.select(F.col("bitmap").alias("__bitmap"), F.col("bits").alias("__bits"))
        # A null key's bit is set or not, but it has a null.
        rows = rows.withColumn("__bit", bit).withColumn("__bitmap", F.expr(f"__bit div {BITS}")).join(F.broadcast(known), "__bitmap", "left")
        at = F.col("__bit") % BITS
        byte = F.conv(F.hex(F.substr("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        whole = F.lit(True)
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        is_set = F.expr("shiftleft(1, cast(__bit % 8 as int))").bitwiseAND(byte) != 0
        return rows.withColumn("__maybe", whole & F.coalesce(is_set, F.lit(False))).drop("__bit", "__bitmap", "__bits")

    def existing(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is here."""
        maybe = self.maybe(rows).where("__maybe").drop("__maybe")
        return maybe.join(self.table(), self.keys, "left_semi").select(*rows.columns)

    def lacking(self, rows: DataFrame) -> DataFrame:
        """Rows whose key, without nulls, isn't here: what refers to a parent that doesn't exist."""
        known = self.maybe(rows.dropna(subset=self.keys))
        lost = known.where("__maybe").join(self.table(), self.keys, "left_anti")
        return known.where("not __maybe").unionByName(lost).select(*rows.columns)

    def breaks(self, batch: DataFrame) -> DataFrame:
        """(keys, occurrences, stored): keys that an insert of the batch would repeat: those here already, and those that
        come more than once. A null makes a key unlike any other."""
        counted = batch.dropna(subset=self.keys).groupBy(*self.keys).agg(F.count(F.lit(1)).alias("occurrences"))
        known = self.maybe(counted)
        held = known.where("__maybe").join(self.table().withColumn("stored", F.lit(True)), self.keys, "left")
        rest = known.where("not __maybe").withColumn("stored", F.lit(False))
        both = held.withColumn("stored", F.coalesce("stored", F.lit(False))).unionByName(rest)
        return both.where("stored or occurrences > 1").select(*self.keys, "occurrences", "stored")

    def _bit(self, bitmaps: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(bitmaps * BITS))
