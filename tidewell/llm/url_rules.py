"""URL filter by association rules.

Explicit host and path rules judge the URLs that they fit, and label them. FP-growth mines from these
labels which combinations of URL tokens go with ``block``; tokens are the labels of the whole host and
the segments of the whole path. Rules of enough support and confidence, of
which no part is a rule as confident, are kept in an inverted index by their rarest token, and judge
the other URLs. DataFrame functions and Spark's own FP-growth only; no Python in any task.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, join_counted

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_BLOCKED = "=block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(host: Column, path: Column) -> Column:
    """All labels of the host, counted from its end, and all path segments, each with and without its place."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    placed = lambda kind: lambda x, i: F.concat(F.lit(kind), (i + 1).cast("string"), F.lit(":"), x)
    free = lambda kind: lambda x: F.concat(F.lit(kind), F.lit(":"), x)
    found = (F.transform(labels, placed("host")), F.transform(parts, placed("path")), F.transform(labels, free("host")), F.transform(parts, free("path")))
    return F.array_distinct(F.concat(*found))


def token_classes(urls: DataFrame, min_support: float) -> DataFrame:
    """(token, class) of the tokens in at least ``min_support`` of all rows of (key, tokens, n), n rows a key.

    Tokens that are in the very same URLs are one class, named after the least of them: a rule gains
    nothing from a second one, so that no rule is lost by mining classes. The URLs of a token are told
    by the 128 bits of their keys. Rarer tokens are in no rule.
    """
    total = urls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hashed = urls.select(F.explode("tokens").alias("token"), "n", "key.h0", "key.h1")
    of_token = hashed.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))
    frequent = checkpointed(of_token.where(F.col("n") >= min_support * total))
    alike = ["n", "keys", "h0", "h1"]
    return checkpointed(frequent.join(frequent.groupBy(alike).agg(F.min("token").alias("class")), alike).select("token", "class"))


def as_classes(urls: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, tokens) with the classes of each key's tokens; keys without any are left out."""
    met = urls.select("key", F.explode("tokens").alias("token")).join(F.broadcast(classes), "token")
    return met.groupBy("key").agg(F.collect_set("class").alias("tokens"))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(antecedent, anchor, support, confidence) of the rules for block in (tokens, blocked).

    A combination is frequent if at least ``min_support`` of all URLs hold it. Tokens of fewer blocked URLs
    are in no rule, and those all of whose URLs are blocked are rules alone; with m others in a URL, at
    most 2^m / min_support combinations are frequent, whatever the number of URLs.
    """
    total = labelled.count()
    counts = labelled.select(F.explode("tokens").alias("token"), "blocked").groupBy("token")
    counts = counts.agg(F.count("*").alias("freq"), F.count_if("blocked").alias("n")).where((F.col("n") >= min_support * total) & (F.col("n") > 0))
    counts = checkpointed(counts)
    # A token that decides alone makes all other rules that hold it needless. As many tokens as below are left.
    sure = counts.where("n = freq")
    sure = sure.select(F.array("token").alias("antecedent"), F.col("token").alias("anchor"), (F.col("n") / total).alias("support"), F.lit(1.0).alias("confidence"))
    left = [r.token for r in counts.where("n < freq").collect()]
    if not left:
        return sure
    items = F.array_intersect("tokens", F.array(*map(F.lit, left)))
    marked = labelled.select(F.when(F.col("blocked"), F.concat(items, F.array(F.lit(_BLOCKED)))).otherwise(items).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(marked)
    frequent = checkpointed(model.freqItemsets)
    rules = checkpointed(
        model.associationRules.where(F.col("consequent")[0] == _BLOCKED).select(
            F.array_sort("antecedent").alias("antecedent"), "support", "confidence"
        )
    )
    # Its parts are the subsets of the tokens by the bits of 1 .. 2^n - 2.
    n = F.size("antecedent")
    subset = lambda m: F.filter("antecedent", lambda x, i: F.getbit(m, i) == 1)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 2)
    parts = rules.where(n > 1).select("antecedent", "confidence", F.explode(F.transform(masks, subset)).alias("part"))
    as_good = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    needless = parts.join(as_good, "part").where("part_confidence >= confidence").select("antecedent").distinct()
    kept = rules.join(needless, "antecedent", "left_anti")
    tokens = frequent.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    by_token = kept.withColumn("token", F.explode("antecedent")).join(tokens, "token")
    anchors = by_token.groupBy("antecedent", "support", "confidence").agg(F.min(F.struct("freq", "token")).alias("rarest"))
    return sure.unionByName(anchors.select("antecedent", F.col("rarest.token").alias("anchor"), "support", "confidence"))


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    min_support: float = 0.005,
    min_confidence: float = 0.9,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    The longest explicit rule that fits decides; without one, the URL is blocked if a mined rule's
    tokens are all in it, else allowed. Edge cases: a null URL, or one without ``://``, has an empty
    host and path, no tokens, and is allowed; repeated rows are judged alike; an empty table gives
    none; without any URL that a rule labels nothing is mined; input columns named like an added
    one, in any case, give way to it. Rows come in no order. A column ``n`` of the pages stays.
    """
    added = {"host", "path", "rule", "verdict"}
    names = [c for c in pages.columns if c.lower() not in added]
    judged = pages.select(*(F.col(f"`{c}`") for c in names), F.col(url).alias("__url"))
    judged = judged.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    judged = judged.withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    # 128 bits stand for a host and path, so that long ones aren't carried along with their tokens.
    judged = judged.withColumn("__key", F.struct(*(F.xxhash64(F.lit(i), "host", "path").alias(f"h{i}") for i in (0, 1))))
    tokens = url_tokens(F.col("host"), F.col("path"))
    urls = judged.select(F.col("__key").alias("key"), tokens.alias("tokens"), (F.col("__fit.verdict") == "block").alias("blocked"), F.col("__fit").isNull().alias("open"))
    labelled = urls.where("not open").select("key", "blocked")
    # Each host and path is mined and matched once, however many pages have it.
    counted = checkpointed(urls.where("not open").groupBy("key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")))
    classes = token_classes(counted, min_support)
    known = as_classes(counted, classes).join(counted.select("key", "n"), "key", "right")
    none = F.array().cast("array<string>")
    known = checkpointed(known.select("key", F.coalesce("tokens", none).alias("tokens"), "n"))
    mined = mine_rules(join_counted(labelled, known, "key").select("tokens", "blocked"), min_support, min_confidence)
    opened = urls.where("open").groupBy("key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    open_urls = as_classes(opened.select("key", "tokens"), classes)
    met = open_urls.withColumn("anchor", F.explode("tokens")).join(mined.select("anchor", "antecedent"), "anchor")
    blocked = met.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("key").distinct()
    verdicts = opened.select("key", "n").join(blocked.withColumn("mined", F.lit("block")), "key", "left")
    verdicts = checkpointed(verdicts.select(F.col("key").alias("__key"), "n", F.coalesce("mined", F.lit("allow")).alias("__mined")))
    # Rows that a rule fits stay where they are, and so do those of a URL that many share.
    ruled = judged.where("__fit is not null").withColumn("__mined", F.col("__fit.verdict"))
    rest = join_counted(judged.where("__fit is null"), verdicts, "__key")
    shown = ruled.unionByName(rest.select(*ruled.columns))
    return shown.select(*(F.col(f"`{c}`") for c in names), "host", "path", F.col("__fit.rule").alias("rule"), F.col("__mined").alias("verdict"))
