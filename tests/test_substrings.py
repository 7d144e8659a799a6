import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.operators.substrings import texts_with_words
from tidewell.sources import sketches

TEXTS = ["the blue car", "a", "", None, "naïve 😀😀 blue", "line\nbreak%_", "aaaaaaaa", "xyz" * 50, "the blue car", "THE BLUE"]
WORDS = ["blue", "b", "", None, "lue c", "😀😀", "e\nb", "%_", "aaaa", "zx", "not there", "blue", "the blue car", "ï", "xyzxyzxyzxyz"]


@pytest.mark.parametrize("q,per_task", [(3, 200_000), (2, 1), (4, 2), (1, 3)])
def test_against_every_text_with_every_word(spark, q, per_task):
    rnd = random.Random(q)
    texts = TEXTS + ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30))) for _ in range(60)] + ["blue"] * 30
    words = WORDS + ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    left = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    right = spark.createDataFrame([(w,) for w in words], "w string")
    found = texts_with_words(left, right, "id", "t", "w", q=q, rows_per_task=per_task)
    expected = sorted((i, w) for i, t in enumerate(texts) for w in set(words) if t is not None and w is not None and w in t)
    assert sorted(map(tuple, found.collect())) == expected
    assert texts_with_words(left, right.limit(0), "id", "t", "w").count() == 0
    assert texts_with_words(left.limit(0), right, "id", "t", "w").count() == 0


def test_no_nested_loop_and_hot_grams_are_split(spark):
    texts = spark.range(3000).selectExpr("id", "concat('every text holds this ', id) as t")
    words = spark.createDataFrame([("holds",), ("text 1",), ("this 29",)], "w string")
    found = texts_with_words(texts, words, "id", "t", "w", rows_per_task=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()} == {"holds": 3000, "this 29": 111}


@pytest.fixture()
def files(spark, tmp_path):
    rows = [(i, f"file {i // 50:02d} says alpha{i // 50:02d}beta and 100%_sure {'x' * (i % 3)}") for i in range(500)]
    path = f"{tmp_path}/t"
    spark.createDataFrame(rows, "id long, t string").repartitionByRange(10, "id").write.parquet(path)
    return path, rows


def like(pattern, text):
    out, at = "", 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 1
            out += re.escape(pattern[at])
        else:
            out += {"%": ".*", "_": "."}.get(pattern[at], re.escape(pattern[at]))
        at += 1
    return re.fullmatch(out, text, re.DOTALL) is not None


PATTERNS = [["%alpha03beta%"], ["%alpha0_beta%"], ["%a%"], ["%ab%"], ["%100\\%\\_sure%"], ["%pha07be%", "%pha09be%"], ["nothing like it"], ["file 01%"], ["%pha07be%", "%a%"], [""], ["%alpha03beta%sure xx"]]


@pytest.mark.parametrize("patterns", PATTERNS)
def test_like_equals_a_whole_scan(spark, files, patterns):
    path, rows = files
    made = sketches.sketch(spark.read.parquet(path), "t")
    found = sketches.like_scan(spark, path, made, "t", patterns)
    assert sorted(r.id for r in found.collect()) == [i for i, t in rows if any(like(p, t) for p in patterns)]


def test_files_without_the_text_are_not_read(spark, files):
    path, rows = files
    made = sketches.sketch(spark.read.parquet(path), "t").cache()
    read = lambda *patterns: len(sketches.like_scan(spark, path, made, "t", list(patterns)).inputFiles())
    assert read("%alpha03beta%") == 1 and read("%pha07be%", "%pha09be%") == 2
    assert read("%a%") == read("%alpha__beta%") == 10
    assert read("%nowhere at all%") == 0
    # A file that was written since, and one that was replaced, are read whatever the sketches say.
    spark.createDataFrame([(900, "nowhere at all")], "id long, t string").coalesce(1).write.mode("append").parquet(path)
    assert [r.id for r in sketches.like_scan(spark, path, made, "t", ["%nowhere at all%"]).collect()] == [900]
    old = sketches.like_scan(spark, path, made, "t", ["%alpha03beta%"]).inputFiles()[0]
    os.utime(old.removeprefix("file:").replace("///", "/"), (1, 1))
    assert old in sketches.like_scan(spark, path, made, "t", ["%nowhere at all%"]).inputFiles()


def test_rows_without_trigrams(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string").coalesce(1).write.parquet(f"{tmp_path}/s")
    made = sketches.sketch(spark.read.parquet(f"{tmp_path}/s"), "t")
    assert sketches.like_scan(spark, f"{tmp_path}/s", made, "t", ["%b"]).first().id == 1
    assert sketches.like_scan(spark, f"{tmp_path}/s", made, "t", ["%abc%"]).count() == 0
    assert sketches.like_scan(spark, f"{tmp_path}/s", made, "t", []).count() == 0


def test_trigrams_of_patterns():
    assert sketches.trigrams_of("%abcd_ef%g") == {"abc", "bcd"} and sketches.trigrams_of("a\\%b\\_c") == {"a%b", "%b_", "b_c"}
    assert sketches.trigrams_of("ab%cd") == set()


def test_sketches_hold_the_very_trigrams(spark, tmp_path):
    rows = [(1, "naïve 😀😀 blue"), (2, None), (3, "ab"), (4, "cd中文字"), (5, "")]
    spark.createDataFrame(rows, "id long, t string").coalesce(1).write.parquet(f"{tmp_path}/s")
    made = sketches.sketch(spark.read.parquet(f"{tmp_path}/s"), "t", bitmaps=3)
    own = sorted({b for _, t in rows for i in range(len(t or "") - 2) for b in sketches._bits([t[i : i + 3]], 3).tolist()})
    held = [r.bitmap * sketches.BITS + 8 * at + i for r in made.collect() for at, byte in enumerate(r.bits) for i in range(8) if byte >> i & 1]
    assert sorted(held) == own and len(own) > 10  # none across two rows


def test_sketches_make_no_row_a_trigram(spark, files):
    made = sketches.sketch(spark.read.parquet(files[0]), "t")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert made.groupBy("path", "bitmap").count().where("count > 1").count() == 0


def test_grams_of_texts_are_not_sorted(spark):
    texts = spark.range(3000).selectExpr("id", "concat('every text holds this ', id) as t")
    words = spark.createDataFrame([("holds",), ("text 1",), ("is",)], "w string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if no side were small
    try:
        found = texts_with_words(texts, words, "id", "t", "w", rows_per_task=100)
        plan = found._jdf.queryExecution().executedPlan().toString()
        merges = [line for line in plan.splitlines() if "SortMergeJoin" in line and "gram" in line and "LeftOuter" not in line]
        assert not merges and "ShuffledHashJoin" in plan
        assert {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()} == {"holds": 3000, "is": 3000}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
