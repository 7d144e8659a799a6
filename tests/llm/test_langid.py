from collections import Counter

import numpy as np

from tests.llm.helpers import fold
from tidewell.llm import langid, queries


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    out = Counter()
    for w in words:
        padded = f"_{w}_"
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def test_grams_and_distance():
    texts = ["Über die Brücke, 12 go!", "a", "ab ab abc", "", "1234 !!", "İstanbul ñandú", None]
    for text in texts:
        keys, counts = langid.grams(text.encode() if text is not None else None)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in plain_grams(text).items()}
    top = 20
    known = {"x": "the cat and the hat", "y": "der hund und die katze"}
    ranked = {k: sorted(plain_grams(v), key=lambda g: (-plain_grams(v)[g], code(g)))[:top] for k, v in known.items()}
    profiles = langid.Profiles({k: [code(g) for g in v] for k, v in ranked.items()}, top)
    for text in ("the hat", "die und der", "zzz", "cat katze"):
        own = sorted(plain_grams(text), key=lambda g: (-plain_grams(text)[g], code(g)))[:top]
        away = {k: sum(abs(v.index(g) - i) if g in v else top for i, g in enumerate(own)) for k, v in ranked.items()}
        best = min(sorted(away), key=away.get)
        lang, score = profiles.predict(text.encode())
        assert lang == best and np.isclose(score, 1 - away[best] / (top * len(own)))


def test_query_on_held_out_documents(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op5_language(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(langs)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ?!", None), (4, "the and of the", "en"), (4, "the and of the", "en"), (None, "die und der", "de"), (6, "le et la " * 40000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "5 as SCORE")
    profiles = langid.fit_profiles(docs, by="text")
    out = langid.identify_language(docs, profiles)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert [(r.doc_id, r.lang_pred) for r in out.collect()] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, "fr")]
    assert langid.identify_language(docs.limit(0), profiles).count() == 0
    nothing = langid.fit_profiles(docs.limit(0), by="doc_id")
    assert {r.lang_pred for r in langid.identify_language(docs, nothing).collect()} == {"und"}


def test_query_by_a_plain_reading(spark, sf_dir):
    """Profiles counted anew from the rows that may be learned from, and each distance by its definition."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if fold(r.doc_id, 3) != 1 and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    order = lambda c: sorted(c, key=lambda g: (-c[g], code(g)))[:400]
    ranks = {k: {g: i for i, g in enumerate(order(c))} for k, c in counts.items()}
    found = {r.doc_id: r for r in queries.op5_language(spark, sf_dir).collect()}
    for r in docs[::3]:
        own = order(plain_grams(r.text))
        away = {k: sum(abs(v[g] - i) if g in v else 400 for i, g in enumerate(own)) for k, v in ranks.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        assert found[r.doc_id].lang_pred == best
        assert np.isclose(found[r.doc_id].score, 1 - away[best] / (400 * len(own)) if own else 0.0)
