"""URL filters: host and path rules, and gradient-boosted trees for the rest.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and the longest fitting rule decides. URLs without a rule get the
verdict of boosted trees on lexical features: lengths, depth, share of digits
and hyphens, character entropy of the host, parameter counts, and the block rate
of the URL's suffix among all labelled URLs. Everything is DataFrame functions
and Spark ML; no Python runs on executors.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule, and is judged by its features like any other. A path is empty, not ``/``,
where the URL has none. Empty texts and repeated rows are judged row by row; a
labelled sample with one class or none gives that class (allow without any).
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Words of hosts that label a URL as unwanted; the trees see lexical features only, never these words.
UNWANTED = ("casino", "bets", "pills", "adult", "ads", "spam", "porn", "warez")
MAX_ROWS = 4000
TREES, DEPTH, RATE = 10, 3, 0.3
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_hyphens", "f_longest", "f_entropy", "f_params", "f_query", "f_suffix"]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def with_features(df: DataFrame) -> DataFrame:
    """Add host, path, suffix and the lexical features of ``url``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = lambda c: F.length(c).cast("double")
    df = df.withColumns({"host": host_of(url), "path": path_of(url)})
    letters = F.filter(F.split("host", ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(letters), lambda c: (size(F.col("host")) - size(F.replace(F.col("host"), c, F.lit("")))) / F.greatest(size(F.col("host")), F.lit(1.0)))
    entropy = F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    ratio = lambda text, drop: (size(text) - size(F.regexp_replace(text, drop, ""))) / F.greatest(size(text), F.lit(1.0))
    return df.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "f_length": size(url),
            "f_host": size(F.col("host")),
            "f_path": size(F.col("path")),
            "f_depth": F.size(F.filter(F.split("path", "/"), lambda part: part != "")).cast("double"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "f_digits": ratio(url, "[0-9]"),
            "f_hyphens": size(F.col("host")) - size(F.regexp_replace("host", "-", "")),
            "f_longest": F.aggregate(F.transform(F.split("host", r"[.-]"), lambda part: size(part)), F.lit(0.0), lambda a, b: F.greatest(a, b)),
            "f_entropy": F.coalesce(entropy, F.lit(0.0)),
            "f_params": F.size(F.filter(F.split(query, "&"), lambda part: part != "")).cast("double"),
            "f_query": size(query),
        }
    )


def weak_labels(pages: DataFrame) -> DataFrame:
    """``url``, ``label``: 1 where a label of the host holds an unwanted word, else 0."""
    words = F.split(host_of(F.col("url")), r"[^a-z]+")
    return pages.where(F.locate("://", F.col("url")) > 0).select("url", F.arrays_overlap(words, F.array(*map(F.lit, UNWANTED))).cast("int").alias("label"))


def judged(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_rows: int = MAX_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the trees) of every page.

    ``labelled`` has (url, label 0/1); up to ``max_rows`` distinct rows of each
    label, of least url hash, are trained on.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    parts = [labelled.where(F.col("label") == k).select("url", F.col("label").cast("double").alias("label")).distinct().orderBy(F.xxhash64("url"), "url").limit(max_rows) for k in (0, 1)]
    sample = scratch.store(with_features(parts[0].union(parts[1]).coalesce(1)), "sample")
    known = labelled.where(F.col("label").isin(0, 1)).select("url", F.col("label").cast("double").alias("label")).distinct()
    known = known.withColumn("suffix", F.substring_index(host_of(F.coalesce(F.col("url"), F.lit(""))), ".", -1))
    rates = scratch.store(known.groupBy("suffix").agg(((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias("f_suffix")), "suffixes")
    rated = lambda df: df.join(rates, "suffix", "left").fillna(0.5, ["f_suffix"])
    classes = [r["label"] for r in sample.select("label").distinct().collect()]
    rows = rated(with_features(pages.select("page_id", "url")))
    if len(classes) == 2:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=5, featuresCol="features", labelCol="label")
        # Both classes weigh alike.
        share = sample.agg(F.avg("label")).first()[0]
        weighed = assemble.transform(rated(sample).coalesce(1).sortWithinPartitions(F.xxhash64("url"), "url")).withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        model = trees.setWeightCol("weight").fit(weighed)
        rows = model.transform(assemble.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("score", F.lit(float(classes[0]) if classes else 0.0))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, F.lit(what)).otherwise(verdict)
    return rows.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
