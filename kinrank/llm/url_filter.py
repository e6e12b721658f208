"""URL filters: host and path rules, and boosted trees on lexical features.

A url that a rule fits gets the rule's verdict (the longest rule that fits).
All others are judged by gradient-boosted trees (Spark ML) on features of the
url alone: lengths, depth, digit ratio, entropy, counts of parameters, hyphens
and labels, and statistics of the host's suffix (its last two labels): how
often it occurs over all urls and its smoothed rate of blocked labels over
all labelled urls.  Fitted rows get the rate of the folds they are not in, so
that no label is in its own feature.

The trees are fitted on at most about ``TRAIN_ROWS`` labelled urls, picked by
a hash of the url; scoring covers every url.  Everything runs as DataFrame
functions and Spark ML in the JVM.  The rule list is a parameter and becomes
one expression.

Defined results: a null url, or one without ``://``, has empty host and path
and is judged by its (empty) features; repeated rows are judged alike; with no
labelled urls, or only one label among them, the score is the share of blocked
labels (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.llm.common import ascii_lower
from kinrank.plans.context import materialize

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
TRAIN_ROWS = 20_000
TREES = 10
DEPTH = 4
THRESHOLD = 0.5
SEED = 7
#: Folds of the labelled urls for the rates of fitted rows, and labels' weight of the overall share.
FOLDS = 5
SMOOTH = 10
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens",
            "n_labels", "secure", "suffix_log", "suffix_rate")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits; the longest rule first."""
    name, verdict = None, None
    for decision, rule_host, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name = F.when(fits, rule_host + prefix) if name is None else name.when(fits, rule_host + prefix)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path and others) plus the features of the url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    count = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")
    letters = F.split(url, "")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length
    shares = F.transform(F.filter(F.array_distinct(letters), lambda c: c != ""), share)
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"), count(F.col("path"), "/").alias("depth"),
        ((F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))) / length).alias("digit_ratio"),
        entropy.alias("entropy"),
        (count(url, "&") + F.when(F.contains(url, F.lit("?")), 1).otherwise(0)).cast("double").alias("n_params"),
        count(F.col("host"), "-").alias("n_hyphens"), (count(F.col("host"), ".") + 1).alias("n_labels"),
        F.startswith(url, F.lit("https")).cast("double").alias("secure"),
        F.substring_index("host", ".", -2).alias("suffix"),
    )


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), url), F.lit(FOLDS)).cast("int")


def _suffixes(pages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(suffix, suffix_log) over all ``pages``; (suffix, fold, blocked, urls) counts of
    all labelled urls ``known``; and their share of blocked labels."""
    counts = pages.groupBy("suffix").agg(F.log2(1.0 + F.count(F.lit(1))).alias("suffix_log"))
    share = known.agg(F.avg("label")).first()[0] or 0.0
    each = known.select("label", F.substring_index(host_of(F.col("url")), ".", -2).alias("suffix"), _fold(F.col("url")).alias("fold"))
    labels = each.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("urls"))
    return counts, materialize(labels), share


def _with_suffixes(features: DataFrame, counts: DataFrame, labels: DataFrame, share: float,
                   out_of_fold: bool = False) -> DataFrame:
    """``features`` plus the statistics of their suffixes: ``suffix_rate``, the share
    of blocked labels, smoothed by the overall one.

    ``out_of_fold``: for the rows that are fitted, the rate of the other folds, so
    that no row's own label (nor that of an equal url) is in its feature."""
    totals = labels.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("urls").alias("urls"))
    found = features.join(counts, "suffix", "left").join(totals, "suffix", "left")
    blocked, urls = F.coalesce("blocked", F.lit(0.0)), F.coalesce("urls", F.lit(0))
    if out_of_fold:
        own = labels.withColumnsRenamed({"blocked": "own_blocked", "urls": "own_urls"})
        found = found.withColumn("fold", _fold(F.col("url"))).join(own, ["suffix", "fold"], "left")
        blocked, urls = blocked - F.coalesce("own_blocked", F.lit(0.0)), urls - F.coalesce("own_urls", F.lit(0))
    rate = (blocked + SMOOTH * share) / (urls + SMOOTH)
    return found.withColumn("suffix_rate", rate).fillna({"suffix_log": 0.0})


def judge(urls: DataFrame, labelled: DataFrame, rules: Sequence[Rule], key: str = "page_id",
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row of ``urls``.

    ``labelled``: (url, label), label 1 for block.  Runs jobs when called.
    """
    split = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    known = labelled.select("url", F.col("label").cast("double").alias("label")).filter("label is not null")
    pages = materialize(lexical(split(urls.select(F.col(key).alias("_key"), "url"))))
    suffixes = _suffixes(pages, known)
    size = known.count()
    fitted = known
    if size > train_rows:
        fitted = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(size)) < train_rows)
    training = materialize(_with_suffixes(lexical(split(fitted)), *suffixes, out_of_fold=True))
    scored = _score(_with_suffixes(pages, *suffixes), training, suffixes[2])
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(
        F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "score")


def _score(pages: DataFrame, training: DataFrame, share: float) -> DataFrame:
    """``pages`` plus ``score``, the probability of block; ``share`` where there is nothing to learn."""
    if training.select("label").distinct().count() < 2:
        return pages.withColumn("score", F.lit(float(share)))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    model = trees.fit(materialize(assembler.transform(training).select("features", "label")))
    return model.transform(assembler.transform(pages)).withColumn(
        "score", F.get(vector_to_array("probability"), F.lit(1)))
