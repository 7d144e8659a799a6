"""The thin queries over the test tables, one an operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, covertree, decontaminate, fim, html_text, langid, lm, mixing, quality, simhash, topk, toxicity, url_rules
from .common import class_sample, is_held_out, read, written


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, by_class: bool) -> DataFrame:
    """(text, label) of a bounded sample of the labelled documents that may be learned from.

    About ``bound`` labelled ids (a class, or in all) are chosen first; being bounded, they can be
    broadcast, and no text is shuffled. Of labels that repeat the highest counts; null ones don't.
    """
    ids = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = ids.where(~is_held_out("doc_id", folds, held_out))
    ids = class_sample(ids.withColumn("class", F.col("label") if by_class else F.lit(0)), "class", "doc_id", bound)
    sample = F.broadcast(ids.select("doc_id", "label"))
    return written(documents.select("doc_id", "text").join(sample, "doc_id").select("text", "label"))


def quality_model(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> quality.QualityModel:
    """Fitted on labelled texts outside the held-out fold.

    Null labels, null ids and labels without a document teach nothing; of an id's labels the highest counts; null and
    empty texts are texts without content; without labels of both kinds all texts score alike; empty tables too.
    """
    labelled = labelled_texts(documents, labels, "quality", 4, 2, sample_rows, by_class=True)
    known = labels.where(~is_held_out("doc_id", 4, 2) & F.col("quality").isin(0, 1))
    share = known.agg(F.avg("quality")).first()[0]
    return quality.fit_quality(labelled, "text", "label", share, sample_rows)


def toxicity_model(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> toxicity.ToxicityModel:
    """Fitted on labelled texts outside the held-out fold.

    Null labels, null ids and labels without a document teach nothing; of an id's labels the highest counts; null and
    empty texts have no sentences; without labels the chance that remains is small; empty tables too.
    """
    labelled = labelled_texts(documents, labels, "toxic", 5, 0, sample_rows, by_class=False)
    return toxicity.fit_toxicity(labelled, "text", "label", sample_rows)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, rows that repeat and null ids too: null and wordless texts have no words and no hits. Items with a
    null id hit but aren't listed; empty benchmarks hit nothing."""
    documents, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(documents.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: null and wordless texts have fingerprint zero, linked like any other; a null id has the least id
    of its component; rows that repeat stay; an empty table gives none."""
    groups = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: null texts and those without words have size 0 and give nothing; a null source is one, the last;
    rows that repeat count each; an empty table gives none."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: a null URL, or one without ``://``, has an empty host and path and is allowed; rows that repeat are judged
    alike; an empty table gives none."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: null texts and those without a letter are ``und``; null ids count as held out; rows with a null
    lang teach nothing; ties go to the lesser name; an empty table gives none."""
    documents = read(spark, sf_dir, "documents")
    profiles = langid.fit_profiles(documents.where(~is_held_out("doc_id", 3, 1)), by="doc_id")
    found = langid.identify_language(documents.select("doc_id", "text"), profiles, keep=["doc_id"])
    return found.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: null and empty html have an empty text; rows that repeat stay; an empty table gives none."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages, keep=["page_id", "url"])


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, hold null or non-finite components or another number of them than most take no part; each
    row of an id that repeats has a list of its own; an empty table gives none."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: a null text is the empty one, an end alone; null ids are held out; rows that repeat are learned
    from, and scored, each; an empty table gives none."""
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: null and empty texts score as texts without a marked word; null ids count as held out; rows that
    repeat score alike; an empty table gives none."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(documents, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, model, keep=["doc_id"])
    return scored.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: null and empty texts score the share of good labels; null ids count as held out; rows that repeat
    score alike; an empty table gives none."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(documents, quality_model(documents, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of any id and text; a null id or text is an empty one, rows that repeat are rows of their own."""
    made = fim.fill_in_middle(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are null, empty, or not given back by their tokens have zeros; rows that repeat count as often."""
    aligned = align.align_tokens(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    return aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256")


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a label or a finite, non-zero value link with nothing; rows that repeat are rows of their own."""
    return covertree.near_vectors(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_mix": op3_mix,
    "op4_url_rules": op4_url_rules,
    "op5_language": op5_language,
    "op6_html_text": op6_html_text,
    "op7_top_k": op7_top_k,
    "op8_lm_score": op8_lm_score,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_fim": op11_fim,
    "op12_align": op12_align,
    "op13_near_vectors": op13_near_vectors,
    "pipeline": pipeline,
}

#: DuckDB SQL of the queries whose rows SQL determines on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op7_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.own <> b.own WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_fim": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', doc_id)) AS h FROM documents
), d AS (
  SELECT *, len(u) AS n, list_transform([0, 1, 2, 3], lambda i: ('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT) AS r FROM t
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS f, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS e,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
      WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, coalesce(array_to_string(u[1 : f], ''), '') AS a, coalesce(array_to_string(u[f + 1 : e], ''), '') AS m, coalesce(array_to_string(u[e + 1 : n], ''), '') AS b FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', a, '<S>', b, '<M>', m) ELSE concat('<S>', b, '<P>', a, '<M>', m) END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM p
""",
    "op13_near_vectors": """
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS own, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), v AS (
  SELECT * FROM r WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.own AS x, b.own AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.own <> b.own
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), t AS (
  SELECT own AS x, own AS y FROM r UNION SELECT t.x, l.y FROM t JOIN l ON t.y = l.x
), c AS (
  SELECT t.x, min(r.vec_id) AS component_id FROM t JOIN r ON r.own = t.y GROUP BY t.x
)
SELECT r.vec_id, count(l.y) AS n_links, any_value(c.component_id) AS component_id, r.vec_id IS NOT DISTINCT FROM any_value(c.component_id) AS kept
FROM r JOIN c ON c.x = r.own LEFT JOIN l ON l.x = r.own GROUP BY r.own, r.vec_id
""",
}
