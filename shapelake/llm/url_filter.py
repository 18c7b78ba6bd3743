"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features are DataFrame expressions and the trees are Spark's own, so no
Python runs on the executors.

Defined results: a null url, or one without ``://``, has an empty host and
path, no rule, and the trees' verdict on its features (all zero); repeated
rows are judged alike; where the labelled urls lack one of the two classes no
trees are fitted and every url takes the class that is there, or ``allow``;
an empty table gives an empty result; extra columns of any name pass through,
but columns named host, path, rule, verdict or p_block give way to those added.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params",
    "f_query_length", "f_hyphens", "f_last_length", "f_suffix_block", "f_suffix_seen",
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits; a rule fits its host, all subdomains, and paths that start with its own."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def lexical_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix and the features that need no training data."""
    text = F.coalesce(F.col(url), F.lit(""))
    df = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    n = F.length(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / (n * F.length(c))
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    return df.withColumns(
        {
            "suffix": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1),
            "f_length": n.cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_path_length": F.length("path").cast("double"),
            "f_depth": count(F.col("path"), "/[^/]"),
            "f_labels": count(F.col("host"), r"[^.]+"),
            "f_digits": F.when(n > 0, count(text, "[0-9]") / n).otherwise(0.0),
            "f_entropy": F.when(n > 0, entropy).otherwise(0.0),
            "f_params": count(query, "[^&=]+="),
            "f_query_length": F.length(query).cast("double"),
            "f_hyphens": count(F.col("host"), "-"),
            "f_last_length": F.length(F.regexp_extract("path", r"([^/]*)/*$", 1)).cast("double"),
        }
    )


#: Labelled urls are dealt into so many folds by hash; a url's suffix statistics in training come from the other folds.
FOLDS = 5


def with_suffix_statistics(df: DataFrame, known: DataFrame, every: float, prior: float = 10.0, own: str | None = None) -> DataFrame:
    """Adds the smoothed share of blocked urls and the number of labelled urls of each host suffix.

    ``known`` holds suffix, fold, s (blocked weight) and n (weight); ``own``
    names a column of ``df`` with the fold to leave out. ``every`` is the share
    over all.
    """
    total = known.groupBy("suffix").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    # Never more rows than the labelled sample, whose size is a parameter.
    df = df.join(F.broadcast(total), "suffix", "left")
    if own:
        part = known.select("suffix", F.col("fold").alias(own), F.col("s").alias("_fs"), F.col("n").alias("_fn"))
        df = df.join(F.broadcast(part), ["suffix", own], "left")
        df = df.withColumns({"_s": F.col("_s") - F.coalesce("_fs", F.lit(0.0)), "_n": F.col("_n") - F.coalesce("_fn", F.lit(0.0))}).drop("_fs", "_fn")
    s, n = F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0.0))
    return df.withColumns({"f_suffix_block": (s + prior * every) / (n + prior), "f_suffix_seen": F.log1p(n)}).drop("_s", "_n")


def labelled_sample(labels: DataFrame, url: str, max_labelled: int, seed: int) -> DataFrame:
    """At most ``max_labelled`` distinct labelled urls, those with the smallest hashes: url, label (the more frequent one; 1 at a tie) and weight."""
    one = labels.where("label is not null").groupBy(F.col(url).alias("_url")).agg(F.avg("label").alias("share"), F.count("*").alias("weight"))
    one = one.select("_url", (F.col("share") >= 0.5).cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    return one.orderBy(F.xxhash64(F.lit(seed), "_url"), "_url").limit(max_labelled)


def judge(
    urls: DataFrame,
    rules: list[Rule],
    labels: DataFrame | None = None,
    url: str = "url",
    max_labelled: int = 20_000,
    max_iter: int = 15,
    max_depth: int = 4,
    seed: int = 11,
) -> DataFrame:
    """Adds host, path, rule, verdict (``allow`` or ``block``) and p_block.

    Trees are trained on ``labels`` (url, label 1 = block); without them, on
    the urls that a rule decides. At most ``max_labelled`` distinct labelled
    urls are used, each weighing as much as it has rows.
    """
    df = lexical_features(urls.select(F.struct("*").alias("_row"), F.col(url).alias("_url")), "_url")
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(F.col("rule") == r.text, r.verdict).otherwise(verdict)
    df = df.withColumn("_decided", verdict)
    if labels is None:
        known = df.where("_decided is not null").select(F.col("_url").alias(url), (F.col("_decided") == "block").cast("double").alias("label"))
    else:
        known = labels.select(url, F.col("label").cast("double").alias("label"))
    known = lexical_features(labelled_sample(known, url, max_labelled, seed), "_url")
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "_url"), F.lit(FOLDS))).drop("_url", "host", "path").persist()
    try:
        classes = {r.label: r.weight for r in known.groupBy("label").agg(F.sum("weight").alias("weight")).collect()}
        if len(classes) == 2:
            every = classes[1.0] / sum(classes.values())
            # The statistics travel as a literal table of at most FOLDS * max_labelled suffixes.
            counts = known.groupBy("suffix", "fold").agg(F.sum(F.col("label") * F.col("weight")).alias("s"), F.sum("weight").alias("n"))
            counts = urls.sparkSession.createDataFrame(counts.collect(), "suffix string, fold long, s double, n double")
            into = VectorAssembler(inputCols=FEATURES, outputCol="_x")
            trees = GBTClassifier(labelCol="label", featuresCol="_x", weightCol="weight", maxIter=max_iter, maxDepth=max_depth, seed=seed)
            trees = trees.setPredictionCol("_prediction").setRawPredictionCol("_raw").setProbabilityCol("_p")
            model = trees.fit(into.transform(with_suffix_statistics(known, counts, every, own="fold")))
            df = model.transform(into.transform(with_suffix_statistics(df, counts, every)))
            df = df.withColumn("p_block", vector_to_array("_p")[1])
        else:
            df = df.withColumn("p_block", F.lit(float(*classes) if classes else 0.0))
    finally:
        known.unpersist()
    df = df.withColumn("verdict", F.coalesce("_decided", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")))
    added = ["host", "path", "rule", "verdict", "p_block"]
    return df.select(*[F.col("_row")[c].alias(c) for c in urls.columns if c not in added], *added)
