"""Which texts hold which words, literally, where both sides are large.

An inverted index of grams turns the substring test into an equi-join: a text that holds a word holds the word's
rarest gram of ``q`` characters. Words shorter than that are grams themselves. Grams that many texts hold are dealt
to several tasks, with a copy of their words for each. What meets by a gram is then tested exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text, each once; the empty run is in every text."""
    if n == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def texts_with_words(
    texts: DataFrame, words: DataFrame, key: str, text: str, word: str, q: int = 3, rows_per_task: int = 200_000
) -> DataFrame:
    """(key, word): each distinct word with each text that holds it; ``key`` tells the texts apart.

    The distinct lengths of words below ``q``, at most q of them, are looked up first. Texts are shuffled once by
    their key, their grams once by the gram. Null texts and null words meet nothing;
    the empty word is in every text. A word is tested only on texts that hold its rarest gram.
    """
    wanted = words.select(F.col(word).alias("word")).where("word is not null").distinct()
    wanted = wanted.withColumn("n", F.least(F.length("word"), F.lit(q)))
    lengths = sorted(r.n for r in wanted.select("n").distinct().collect())
    if not lengths:
        return texts.select(key, F.col(text).alias(word)).limit(0)
    of = lambda column: F.concat(*(F.when(F.col("n") == n, grams(column, n)).otherwise(F.array().cast("array<string>")) for n in lengths))
    asked = wanted.select("word", "n", F.explode(of(F.col("word"))).alias("gram"))

    source = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    per_length = F.array(*(F.struct(F.lit(n).alias("n"), grams(F.col("text"), n).alias("grams")) for n in lengths))
    held = source.select("key", F.explode(per_length).alias("x")).select("key", "x.n", F.explode("x.grams").alias("gram"))
    # Counted where they are made: a gram is a row a task, and no row of a text is shuffled for it.
    counts = held.groupBy("n", "gram").agg(F.count("*").alias("texts"))

    # A word of which a gram is in no text is in none: it counts zero, is chosen as the rarest, and meets nothing.
    rated = asked.join(counts, ["n", "gram"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = rated.groupBy("word", "n").agg(F.min(F.struct("texts", "gram")).alias("least")).select("word", "n", "least.gram", "least.texts").where("texts > 0")
    parts = F.ceil(F.col("texts") / rows_per_task).cast("int")
    copies = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # As many texts as hold the gram are dealt over its parts. There is one gram of several parts at most for each
    # rows_per_task grams of all texts.
    several = counts.where(F.col("texts") > rows_per_task).select("n", "gram", parts.alias("parts"))
    dealt = held.join(F.broadcast(several), ["n", "gram"], "left")
    dealt = dealt.select("key", "n", "gram", F.coalesce(F.pmod(F.xxhash64("key"), "parts"), F.lit(0)).cast("int").alias("part"))
    # Words are hashed and texts pass by: sorting a text's every gram would take memory that grows with the texts.
    meet = lambda kept, words: dealt.where(kept).join(copies.where(words).hint("shuffle_hash"), ["n", "gram", "part"]).select("key", "word")
    # Short words are their gram; the others, all of grams of q characters, are tested, each text's words beside it.
    exact = meet(F.lit(True), F.length("word") <= q)
    longer = meet(F.col("n") == q, F.length("word") > q).join(source, "key").where(F.contains("text", F.col("word"))).select("key", "word")
    return exact.unionByName(longer).select(F.col("key").alias(key), F.col("word").alias(word))
