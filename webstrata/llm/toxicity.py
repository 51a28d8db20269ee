"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text, toxic or not, is unlabelled. Linear
classifiers on hashed words and character n-grams minimise the class-prior-corrected risk
``p E+[l(g)] + max(0, E[l(-g)] - p E+[l(-g)])`` with logistic loss; where the second part turns
negative, which is overfitting, the step goes back up. ``MODELS`` classifiers learn in as many
Spark tasks, each from all positives and its own hash part of the other text, and the mean of
their chances is the score.

The fit is bounded: at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` documents of any
kind, the lowest by hash and of any length; rows of one id and text are one. Only their distinct words
move, which is all that the features depend on. The class prior is the share of toxic ones among the
labels that may be learned from; where these confirm toxic documents only, it is ``PRIOR`` unless given.
Only features more frequent among the positives have a weight: what speaks for a clean text is the bias.
Every whole text is scored where it lies, without a shuffle.

Defined results: a NULL or empty text is scored by the bias alone; without any usable positive
every score is 0; a NULL ``doc_id`` is not held out and has no label; repeated rows are scored
each; a document with several labels is positive if any of them is; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = 3
MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
BUCKETS = 1 << 20
GRAMS = (4, 5)
MIN_Z = 6.0
STEPS, RATE, DECAY = 600, 0.05, 1e-3
#: A bucket is a feature of its own for each of these numbers of distinct words that hold it.
LEVELS = (1, 2, 4)
THRESHOLD = 0.3
#: Class prior where the labels do not tell it.
PRIOR = 0.1
_WORD = re.compile(r"\w+")


def features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its character n-grams."""
    bounded = f"^{word}$"
    grams = {bounded[i : i + n] for n in GRAMS for i in range(len(bounded) - n + 1)}
    return tuple({zlib.crc32(g.encode()) % BUCKETS for g in {*grams, bounded}})


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def buckets_of(text: str | None) -> np.ndarray:
    """Features of a text: (bucket, level) pairs as numbers, for the levels its count reaches."""
    grams = [f for w in words_of(text) for f in features(w)]
    names, count = np.unique(np.array(grams, np.int64), return_counts=True)
    return np.concatenate([names[count >= n] * len(LEVELS) + i for i, n in enumerate(LEVELS)])


def risk(score: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of positives as positive, and of the rest as negative."""
    as_negative = np.logaddexp(0, score)
    rest = as_negative[~positive].mean() - prior * as_negative[positive].mean()
    return float(prior * np.logaddexp(0, -score[positive]).mean()), float(rest)


def slopes(score: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Derivative by each score of the risk or, if its second part is negative, of minus that part."""
    chance = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    n_p, n_u = positive.sum(), (~positive).sum()
    if risk(score, positive, prior)[1] >= 0:
        return np.where(positive, -prior / n_p, chance / n_u)
    return np.where(positive, prior * chance / n_p, -chance / n_u)


def learn(
    texts: list[str | None], positive: np.ndarray, prior: float
) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights and the bias of one classifier.

    Only buckets whose share differs between positives and the rest by ``MIN_Z`` standard errors
    are features. Gradient steps minimise the non-negative risk over the whole sample.
    """
    found = [buckets_of(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    column = np.concatenate([np.zeros(0, np.int64), *found])
    n_p, n_u = positive.sum(), (~positive).sum()
    in_p = np.bincount(column[positive[row]], minlength=BUCKETS * len(LEVELS))
    in_u = np.bincount(column[~positive[row]], minlength=BUCKETS * len(LEVELS))
    pooled = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    differs = in_p / n_p - in_u / n_u >= MIN_Z * np.maximum(error, 1e-9)
    names = np.flatnonzero(differs & (in_p + in_u > 0))
    place = np.full(BUCKETS * len(LEVELS), -1, np.int32)
    place[names] = np.arange(len(names))
    keep = place[column] >= 0
    row, column = row[keep], place[column[keep]]
    weight, bias = np.zeros(len(names)), np.log(prior / (1 - prior))
    moments = np.zeros((2, len(names) + 1))
    for step in range(1, STEPS + 1):
        score = np.bincount(row, weight[column], len(texts)) + bias
        slope = slopes(score, positive, prior)
        grad = np.append(np.bincount(column, slope[row], len(names)) + DECAY * weight, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        change = moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - RATE * change[:-1], bias - RATE * change[-1]
    return names, weight, float(bias)


class Scorer:
    """Mean chance of several classifiers; the features of a word are looked up once."""

    def __init__(self, models: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        self.bias = np.array([m[2] for m in models])
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *[m[0] for m in models]]))
        self.weights = np.zeros((len(every), len(models)))
        for i, (names, weight, _) in enumerate(models):
            self.weights[np.searchsorted(every, names), i] = weight
        self.place: dict[int, list[tuple[int, int]]] = {}
        for at, name in enumerate(every.tolist()):
            bucket, level = divmod(name, len(LEVELS))
            self.place.setdefault(bucket, []).append((LEVELS[level], at))
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in features(word) if f in self.place)
        if len(self.known) > 1_000_000:
            self.known.clear()
        self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        known, count = self.known, {}
        for word in words_of(text):
            found = known.get(word)
            for f in self.word(word) if found is None else found:
                count[f] = count.get(f, 0) + 1
        held = [at for f, n in count.items() for level, at in self.place[f] if n >= level]
        sums = self.weights[sorted(held)].sum(axis=0) + self.bias
        return float((1 / (1 + np.exp(-np.clip(sums, -40, 40)))).mean())



def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit: CRC-32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learn_group(prior: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["positive", "hash", "text"], kind="stable")
        positive = group["positive"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"names": [], "weights": [], "bias": []})
        names, weights, bias = learn(group["text"].tolist(), positive, prior)
        return pd.DataFrame({"names": [names], "weights": [weights], "bias": [bias]})

    return run


def fit(
    docs: DataFrame, labels: DataFrame, prior: float | None = None,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Classifiers learned from rows that are not held out; none without a usable positive."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    if not share:
        return []
    prior = prior if prior is not None else share if share < 1 else PRIOR
    by_hash = F.xxhash64("doc_id").alias("hash")
    learnable = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", "text", F.xxhash64("text").alias("copy")
    )
    narrow = learnable.select("doc_id", "copy").distinct()
    positives = (
        narrow.join(known.filter("toxic > 0"), "doc_id", "left_semi")
        .select("doc_id", "copy", by_hash, F.lit(True).alias("positive"))
        .orderBy("hash", "doc_id", "copy").limit(max_positive)
    )
    others = (
        narrow.select("doc_id", "copy", by_hash, F.lit(False).alias("positive"))
        .orderBy("hash", "doc_id", "copy").limit(max_unlabelled)
    )
    # At most max_positive + max_unlabelled narrow rows.
    chosen = F.broadcast(positives.union(others))

    @F.pandas_udf("string")
    def distinct_words(texts: pd.Series) -> pd.Series:
        """A text's distinct words as a text: of the same features, and short for a long one."""
        return pd.Series([" ".join(sorted(words_of(t))) for t in texts], dtype=object)

    every = F.array(*[F.lit(i).cast("long") for i in range(MODELS)])
    sample = (
        learnable.join(chosen, ["doc_id", "copy"])
        .withColumn("text", distinct_words("text"))
        .groupBy("doc_id", "copy", "hash", "positive").agg(F.first("text").alias("text"))
        .withColumn("part", F.pmod(F.col("hash"), F.lit(MODELS)))
        .withColumn("parts", F.when(F.col("positive"), every).otherwise(F.array("part")))
        .select("text", "positive", "hash", F.explode("parts").alias("model"))
    )
    learned = sample.groupBy("model").applyInPandas(
        _learn_group(prior), "names array<long>, weights array<double>, bias double"
    )
    return sorted(
        [(np.array(r[0], np.int64), np.array(r[1], np.float64), r[2]) for r in learned.collect()],
        key=lambda m: m[2],
    )


def score(docs: DataFrame, models: list[tuple[np.ndarray, np.ndarray, float]]) -> DataFrame:
    """Add ``score``: the chance that a text is toxic."""
    if not models:
        return docs.withColumn("score", F.lit(0.0))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(models)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    return docs.withColumn("score", scored("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
