import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import fim, queries

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+|\s+", "space": r"\S*\s+|\S+", "char": r"[\s\S]"}
TEXTS = ["a\nb\n", "one", "\n", "\n\n\nx", "a b  c\n d", "é\n😀😀\nz", "x\r\ny z\n", " lead and trail ", "a<P>b\nc", "<M>", "1<\nS>\n<P", "", None, "l\n" * 5000]


def plain(doc_id, text, unit=UNITS["line"], percent=100, spm=50):
    text = text or ""
    own = re.findall(unit, text, re.ASCII)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(own), "plain", None, None, text
    at, to = sorted((h1 % (len(own) + 1), h2 % (len(own) + 1)))
    p, m, s = "".join(own[:at]), "".join(own[at:to]), "".join(own[to:])
    if h4 % 100 < spm:
        return len(own), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(own), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("grammar", list(UNITS))
@pytest.mark.parametrize("percent,spm", [(100, 50), (40, 100), (100, 0)])
def test_against_a_plain_reading(spark, grammar, percent, spm):
    rows = [(i * 10 + k if i else None, t) for i, t in enumerate(TEXTS) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.fill_in_middle(frame, grammar=grammar, percent=percent, spm_percent=spm)
    found = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    assert len(found) == len(rows)
    for r, (doc_id, text) in zip(sorted(found, key=key), sorted(rows, key=key), strict=True):
        lengths = (None, None) if r.prefix is None else (len(r.prefix), len(r.middle))
        assert (r.n, r.form, *lengths, r.output) == plain(doc_id, text, UNITS[grammar], percent, spm)
        assert r.back == (text or "")


def test_runs_of_classes(spark):
    text = "ab12 \n..é9x"
    grammar = fim.run_grammar(r"\p{L}", r"\p{N}", r"\s")
    assert spark.range(1).select(fim.units(F.lit(text), grammar).alias("u")).first().u == ["ab", "12", " \n", "..", "é", "9", "x"]


def test_query_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view documents as from '{sf_dir}/documents.parquet'")
    result = db.execute(queries.ORACLE_SQL["op11_fim"])
    names = [x[0] for x in result.description]
    found = queries.op11_fim(spark, sf_dir)
    assert found.columns == names and sorted(map(tuple, found.collect())) == sorted(result.fetchall())
    assert {r.form for r in found.collect()} >= {"psm", "spm"}
    assert found.where("n > 0 and output_sha256 = restored_sha256 and form <> 'plain'").count() <= 1


def test_edges(spark):
    frame = spark.createDataFrame([(1, "a\nb", 5, "x"), (1, "a\nb", 5, "x"), (2, None, 6, None)], "doc_id long, text string, N long, output string")
    made = fim.fill_in_middle(frame)
    assert made.columns == ["doc_id", "text", *fim.ADDED] and made.count() == 3
    assert fim.fill_in_middle(frame.limit(0)).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
