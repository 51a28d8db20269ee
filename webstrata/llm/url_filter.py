"""URL filters: rules by host and path, and a logistic regression for what no rule decides.

Features are hashed character n-grams of host and path, each marked with its part. The labelled
URL table is small: at most ``max_labelled`` distinct URLs, the lowest by hash, so that it fits
one task, where the fit does not depend on how tasks are scheduled. Everything else is a
projection of the scanned row: no shuffle, whatever the number of URLs.

Defined results: a NULL URL, or one without ``://``, has an empty host and path and is judged by
the model on no features, that is by its intercept. With labels of one kind only, that kind is
the verdict; without any labelled URL every URL is allowed. Other columns are kept; names that
start with an underscore are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MAX_RULES = 10_000
MAX_LABELLED = 8192
GRAMS = (3, 4, 5)
BUCKETS = 1 << 14


def with_parts(df: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` of ``url``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    return (
        df.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("_rest", "^([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``rule`` and ``_ruled`` (its verdict): the longest rule that fits, else NULL.

    Rules are literals of the plan, at most ``MAX_RULES``; the first that fits in order of
    falling length wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    cases: Column | None = None
    for host, path, verdict in longest_first:
        inside = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = inside & F.startswith(F.col("path"), F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return (
        df.withColumn("_found", found if cases is None else cases.otherwise(found))
        .withColumn("rule", F.col("_found.rule"))
        .withColumn("_ruled", F.col("_found.verdict"))
        .drop("_found")
    )


def _grams(part: str) -> Column:
    """Character n-grams of a column between bounds, each with the part's name before it."""
    text = F.concat(F.lit("^"), F.col(part), F.lit("$"))
    runs = [
        F.when(
            F.length(text) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                lambda i, n=n: F.concat(F.lit(part[0]), F.substring(text, i, F.lit(n))),
            ),
        ).otherwise(F.array().cast("array<string>"))
        for n in GRAMS
    ]
    empty = F.array().cast("array<string>")
    return F.when(F.col(part) == "", empty).otherwise(F.concat(*runs))


def with_features(df: DataFrame) -> DataFrame:
    """Add ``_features``: hashed counts of the n-grams of host and path."""
    grams = df.withColumn("_grams", F.concat(_grams("host"), _grams("path")))
    hashed = HashingTF(numFeatures=BUCKETS, inputCol="_grams", outputCol="_features", binary=True)
    return hashed.transform(grams).drop("_grams")


def labelled_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``url, label`` (1 is block) of the URLs that rules decide: the table to learn from."""
    ruled = with_rule(with_parts(df.select("url")), rules).filter(F.col("_ruled").isNotNull())
    return ruled.select("url", (F.col("_ruled") == "block").cast("double").alias("label"))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED):
    """A model of ``url, label``, or the one label there is, or None.

    Learns from the ``max_labelled`` distinct (url, label) of lowest hash.
    """
    chosen = (
        labelled.filter(F.col("label").isNotNull())
        .select("url", "label")
        .distinct()
        .withColumn("_hash", F.xxhash64("url", "label"))
        .orderBy("_hash", "url", "label")
        .limit(max_labelled)
        .drop("_hash")
    )
    small = with_features(with_parts(chosen)).select("label", "_features").persist()
    labels = {row[0] for row in small.select("label").distinct().collect()}
    try:
        if len(labels) < 2:
            return labels.pop() if labels else None
        learner = LogisticRegression(
            featuresCol="_features", labelCol="label", regParam=0.001, maxIter=60,
            probabilityCol="_chance", rawPredictionCol="_raw", predictionCol="_predicted",
        )
        return learner.fit(small)
    finally:
        small.unpersist()


def judge(df: DataFrame, model, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``host, path, rule, verdict, block_score`` to every URL."""
    ruled = with_rule(with_parts(df), rules)
    if model is None or isinstance(model, float):
        scored = ruled.withColumn("block_score", F.lit(float(model or 0.0)))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(with_features(ruled)).withColumn(
            "block_score", F.get(vector_to_array("_chance"), F.lit(1))
        )
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("_ruled", learned)).drop(
        "_ruled", "_features", "_chance", "_raw", "_predicted"
    )


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = fit(labelled_urls(pages))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "block_score")
