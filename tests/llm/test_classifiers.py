import re

import numpy as np
import zstandard

from tests.llm.helpers import ALNUM, fold, low
from tidewell.llm import quality, queries, toxicity

BIG = "/root/testdata/sf0.01"


def held_out(spark, found, label, folds, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert all(r.held_out == (fold(r.doc_id, folds) == rest) and 0 <= r.score <= 1 for r in found)
    pairs = [(r.score, r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good = [s for s, _, y in pairs if y == 1]
    bad = [s for s, _, y in pairs if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    return auc, np.mean([p == y for _, p, y in pairs])


def test_toxicity_on_held_out_documents(spark):
    found = queries.op9_toxicity(spark, BIG).collect()
    auc, accuracy = held_out(spark, found, "toxic", 5, 0)
    assert auc > 0.8 and accuracy > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in found)


def test_toxic_documents_are_found(spark):
    """Most held-out toxic documents are caught, and nearly all that are said to be toxic are."""
    large = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    pairs = [(r.predicted, labels[r.doc_id]) for r in queries.op9_toxicity(spark, large).collect() if r.held_out and r.doc_id in labels]
    caught, toxic, said = sum(p and y for p, y in pairs), sum(y for _, y in pairs), sum(p for p, _ in pairs)
    assert caught >= 0.85 * toxic > 0 and caught >= 0.95 * said


def test_settings_by_cross_validation(spark):
    """Texts are scored by models that haven't seen them, and the better setting comes first."""
    rows = [(f"word{i} and badword{i % 3} here. so it goes {i}", 1) for i in range(60)] + [(f"word{i} and fine{i % 7} here. so it goes {i}", 0) for i in range(240)]
    labelled = spark.createDataFrame([*rows, ("null label", None), (None, 1)], "text string, toxic int")
    tried = toxicity.cross_validated(labelled, [{"least": 500}, {"least": 5}], folds=3)
    assert [s for s, *_ in tried] == [{"least": 5}, {"least": 500}]
    assert tried[0][1:] == (60, 60, 60) and tried[1][1] == 0 and tried[1][2] == 60


def test_toxicity_scores_by_a_plain_reading(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.toxicity_model(docs, labels)
    assert model.weights
    for r in toxicity.score_toxicity(docs, model, keep=["doc_id", "text"]).collect():
        miss = 1 - model.rest
        for sentence in re.findall(r"[^.!?\n]+[.!?\n]*", r.text or ""):
            found = set()
            for w in ALNUM.findall(low(sentence)):
                w = w.encode()
                found |= {f for f in (w, w[:4] + b"-" if len(w) > 4 else w, w[:7] + b"-" if len(w) > 7 else w) if f in model.weights}
            if found:
                miss *= 1 - 1 / (1 + np.exp(-(model.offset + sum(model.weights[f] for f in found))))
        assert abs(r.score - (1 - miss)) < 1e-9


def test_toxicity_of_unmarked_texts_follows_the_labels(spark):
    rows = [(i, f"Day {i * i} was number {i * 7}.", int(i % 5 > 0)) for i in range(200)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    odd = spark.createDataFrame([(1, "Qxy zz."), (2, None)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score_toxicity(odd, model).collect()] == [1, 1] and 0.7 < model.rest < 0.9


def test_quality_on_held_out_documents(spark):
    found = queries.op10_quality(spark, BIG).collect()
    auc, accuracy = held_out(spark, found, "quality", 4, 2)
    assert auc > 0.9 and accuracy > 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in found)


def test_quality_scores_by_a_plain_reading(spark, sf_dir):
    """Each whole text compressed piece by piece with either dictionary, and the curve by its formula."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.quality_model(docs.select("doc_id", "text"), labels)
    kinds = [zstandard.ZstdCompressionDict(x) for x in (model.good, model.bad)]
    plain = [zstandard.ZstdCompressor(level=model.level, dict_data=k, write_content_size=False, write_dict_id=False) for k in kinds]
    found = {r.doc_id: r for r in queries.op10_quality(spark, sf_dir).collect()}
    for r in docs.collect():
        text = (r.text or "").encode()
        sizes = [sum(len(c.compress(text[i : i + model.piece])) for i in range(0, len(text), model.piece)) for c in plain]
        told = len(text) / (len(text) + 256)
        level = model.offset + (model.slope * ((sizes[1] - sizes[0]) / len(text) if text else 0.0) + model.length) * told
        assert abs(found[r.doc_id].score - 1 / (1 + np.exp(-np.clip(level, -40, 40)))) < 1e-9
        assert found[r.doc_id].predicted == (found[r.doc_id].score >= 0.7)


def toxic_rows():
    clean = "The weather of day {i} is fine. We walk along river {j} and talk. Nothing else happens here."
    rows = []
    for i in range(300):
        text = clean.format(i=i, j=i % 37)
        if i % 6 == 0:
            text += f" You are a blorgface number {i}! Good bye {i % 11}."
        rows.append((i, text, int(i % 6 == 0)))
    return rows


def test_offending_sentences(spark):
    frame = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame)
    assert b"blorgface" in model.weights and b"weather" not in model.weights
    extra = [(1000, None), (1001, ""), (1002, "Ünd so. What a BLORGFACE, they said. Fine."), (1003, "fine. " * 100_000), (None, "You are a blorgface number 9")]
    docs = spark.createDataFrame(extra, "doc_id long, text string").selectExpr("*", "1 as Score", "2 as offending")
    out = toxicity.score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted", "offending"]
    found = {r.doc_id: r for r in out.collect()}
    assert [found[i].predicted for i in (1000, 1001, 1002, 1003, None)] == [0, 0, 1, 0, 1]
    (s,) = found[1002].offending
    assert extra[2][1].encode()[s.begin : s.end].decode().strip() == "What a BLORGFACE, they said."
    assert found[1000].score == found[1001].score == found[1003].score
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    for labelled in (frame.limit(0), frame.selectExpr("doc_id", "text", "cast(null as int) toxic"), frame.where("toxic = 0")):
        model = toxicity.fit_toxicity(labelled)
        assert {r.predicted for r in toxicity.score_toxicity(frame, model).collect()} == {0}


def test_noisy_or_learns_from_document_labels_alone():
    bags = [[[0, 1], [1]], [[1]], [[0]], [], [[1], [1]]] * 30
    y = np.array([1, 0, 1, 0, 0] * 30, float)
    w, b, rest = toxicity.noisy_or_fit(bags, y, 2, np.zeros(2))
    p = lambda s: 1 / (1 + np.exp(-(b + sum(w[f] for f in s))))
    assert p([0]) > 0.8 and p([1]) < 0.1 and rest < 0.1


def test_quality_edges(spark):
    rng = np.random.default_rng(3)
    words = ["stone", "river", "garden", "window", "silver", "morning", "letter", "under", "green", "quiet"]
    rows = [(i, " ".join(rng.choice(words, 60)) if i % 3 else "$$$ ### " * 40 + str(i), int(i % 3 > 0)) for i in range(300)]
    rows += [(1000, None, 1), (1001, "", 0), (1002, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit_quality(frame)
    extra = [(1, None), (2, ""), (3, " ".join(rng.choice(words, 20000))), (4, "### $$$ " * 30), (4, "### $$$ " * 30), (None, "green stone garden letter morning quiet")]
    docs = spark.createDataFrame(extra, "doc_id long, text string").selectExpr("*", "1 as SCORE", "2 as difference", "3 as predicted")
    out = quality.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    found = [(r.doc_id, r.predicted) for r in out.collect()]
    assert found[2:] == [(3, 1), (4, 0), (4, 0), (None, 1)]
    assert quality.score_quality(docs.limit(0), model).count() == 0
    for labelled in (frame.limit(0), frame.where("quality = 1")):
        scores = {r.score for r in quality.score_quality(docs, quality.fit_quality(labelled)).collect()}
        assert len(scores) == 1
    few = frame.where("doc_id < 8")
    assert quality.fit_quality(few).good is not None


def test_logistic_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20000, 2))
    y = (rng.random(20000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.allclose(quality.fit_logistic(x, y, np.ones(len(y))), [1, 2, -1], atol=0.15)
    assert quality.fit_logistic(x, y, np.where(y == 1, 3.0, 1.0))[0] > 1.8
    assert quality.fit_logistic(x[:0], y[:0], y[:0]) == [0.0, 0.0, 0.0]
