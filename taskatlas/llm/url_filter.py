"""URL verdicts: fixed rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.llm.words import ascii_lower
from taskatlas.sources.storage import stored

# Fixed values of the query's contract: rule and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

FEATURES = (
    "length", "host_length", "host_labels", "hyphens", "depth", "digit_ratio", "entropy", "parameters", "query_length", "fragment",
    "suffix_rate", "suffix_seen", "domain_rate", "domain_seen",
)
SUFFIX_PRIOR = 20.0  # rows that an unseen suffix counts as having at the mean rate


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case, and the path; both empty without ``://`` or url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # later ones replace shorter ones
        rule_host, _, tail = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.length(text)
    each = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    shares = F.transform(each, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    bits = F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """``url, host, path`` with the features that need nothing but the url itself."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.filter(F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\."), lambda x: x != "")
    n = F.size(labels)
    return urls.withColumns({
        "length": F.length(text).cast("double"), "host_length": F.length(host).cast("double"), "host_labels": n.cast("double"),
        "hyphens": (F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit("")))).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.when(text == "", F.lit(0.0)).otherwise((F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))) / F.length(text)),
        "entropy": entropy(text),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "query_length": F.length(query).cast("double"),
        "fragment": text.contains("#").cast("double"),
        "suffix": F.coalesce(F.get(labels, n - 1), F.lit("")),
        "domain": F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), "."),
    })


def suffix_table(labelled: DataFrame, col: str) -> DataFrame:
    """Labelled rows and blocked rows per suffix, over all labelled rows."""
    return stored(labelled.groupBy(col).agg(F.count("*").alias(f"{col}_n"), F.sum("label").alias(f"{col}_blocked")), "url-suffixes")


def training_sample(source: DataFrame, max_urls: int) -> DataFrame:
    """``url, label, copies``: the different labelled urls with the smallest hash of the url, and how many rows each has."""
    counted = source.groupBy("url", "label").agg(F.count("*").cast("double").alias("copies"))
    return counted.orderBy(F.xxhash64("url"), "url", "label").limit(max_urls)


def with_suffixes(rows: DataFrame, tables: dict[str, DataFrame], mean: float, own: bool) -> DataFrame:
    """Smoothed block rate and frequency of each suffix; ``own`` leaves the ``copies`` of the row out of its counts."""
    for col, counts in tables.items():
        rows = rows.join(counts, col, "left")
        less = F.col("copies") if own else F.lit(0.0)
        n = F.greatest(F.coalesce(F.col(f"{col}_n"), F.lit(0)) - less, F.lit(0.0))
        blocked = F.coalesce(F.col(f"{col}_blocked"), F.lit(0.0)) - (F.col("label") * less if own else F.lit(0.0))
        rows = rows.withColumns({f"{col}_rate": (blocked + SUFFIX_PRIOR * mean) / (n + SUFFIX_PRIOR), f"{col}_seen": F.log1p(n)}).drop(f"{col}_n", f"{col}_blocked")
    return rows


def judge_urls(
    pages: DataFrame, id_col: str, url_col: str, *, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None,
    max_training_rows: int = 20_000, trees: int = 12, depth: int = 4, threshold: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row.

    The longest fitting rule decides; without one, boosted trees do, trained on
    ``labelled`` (``url, label`` with 1 for block) or, without that, on the urls
    that a rule decides. Training uses at most ``max_training_rows`` different labelled
    urls, those with the smallest hash, each weighted by its rows; the suffix tables
    count all labelled rows. With labels of only one kind that kind is the verdict;
    with none it is allow.

    Null and malformed urls have an empty host and path and are judged like any
    other; repeated rows stay; an empty table gives no rows; other columns are
    ignored. Trains while the plan is built.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = urls.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        source = ruled.filter("rule IS NOT NULL").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        source = labelled.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).dropna(subset=["label"])
    n, blocked = source.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("b")).first()
    if not 0 < blocked < n:
        says = F.lit(1.0 if n and blocked == n else 0.0)
        scored = ruled.withColumn("score", says)
    else:
        featured = lexical(source)
        tables = {"suffix": suffix_table(featured, "suffix"), "domain": suffix_table(featured, "domain")}
        sample = stored(lexical(training_sample(source, max_training_rows).withColumns({"host": host, "path": path})), "url-sample")
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        ready = assembled.transform(with_suffixes(sample, tables, blocked / n, own=True)).select("label", "copies", "features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, weightCol="copies").fit(ready)
        rows = assembled.transform(with_suffixes(lexical(ruled), tables, blocked / n, own=False))
        scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), 1))
    says = F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", says.alias("verdict"), F.round("score", 6).alias("score"))
