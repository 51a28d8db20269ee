"""Language identification by hierarchical discrimination: the family first, then its languages.

A text is the counts of its words' character n-grams, hashed, over their number. Languages whose mean
counts are alike form families (average linkage of cosines, as many families as the root of the number
of languages). Linear support vector machines with squared hinge loss, in numpy, one task each, tell
one family from the rest, and within a family each pair of languages apart (one versus one). A
prediction takes the family of the largest margin, then the language that wins most of its pairs.

The fit is bounded: of each language at most ``MAX_A_LANGUAGE`` labelled texts, the lowest by hash and
of any length, each whole and as ``SNIPPET`` of its words, so that short texts are known too; a family's
machine takes at most ``MAX_A_FAMILY`` of them, as many of each language. The scores of words add up
to those of a text, so every whole text is scored where it lies, each distinct word of a batch once.

Defined results: ``und`` and score 0 for a text that is NULL or has no letter, and for every text if no
row can be learned from; a NULL ``doc_id`` is not held out and is learned from; a language is a value
of ``lang``, whatever it is; with one language every text with a letter has it, with score 1;
repeated rows are predicted each; an empty table gives an empty result. Input columns named like an
added one give way to it, others are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import stored
from webstrata.llm.substrings import mixed, powers
from webstrata.llm.toxicity import held_out

MAX_A_LANGUAGE = 800
MAX_A_FAMILY = 8000
SNIPPET = 8
BITS = 14
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)
STEPS, RATE, DECAY = 150, 0.05, 1e-4
MIN_ROWS = 3
UNKNOWN = "und"
_STEP = 0x9E3779B97F4A7C15
#: Texts of so many bytes are scored at once.
SLICE_BYTES = 8 << 20


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: the word and the bucket of every character n-gram, borders marked.

    A bucket is the upper bits of a polynomial over code points, mixed.
    """
    joined = "".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    for n in GRAMS:
        count = max(len(points) - n + 1, 0)
        sums = np.full(count, n, np.uint64)
        for i, power in enumerate(powers(_STEP, n)):
            sums += points[i : count + i] * power
        inside = np.flatnonzero(owner[:count] == owner[n - 1 :])
        yield owner[inside], (mixed(sums[inside]) >> np.uint64(64 - BITS)).astype(np.int64)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Lower-case runs of letters of each text; an empty one may stand at either end."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.split_pattern_regex(lower, r"[^\p{L}]+")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in runs of about ``limit`` bytes, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(False).astype(np.int64) + 64)
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, done + limit, "right")), at + 1)
        yield texts.slice(at, to - at)
        at = to


def vector(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its n-grams in each."""
    times = Counter(w for w in words if w)
    counts = np.fromiter(times.values(), np.float64, len(times))
    total = np.zeros(BUCKETS)
    for word, bucket in grams(list(times)):
        total += np.bincount(bucket, counts[word], BUCKETS)
    held = np.flatnonzero(total)
    return held, total[held] / max(total.sum(), 1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for each text: the whole one, and a snippet from a place that its hash tells."""
    for batch in batches:
        out = {"lang": [], "place": [], "at": [], "share": []}
        columns = (batch.column(c).to_pylist() for c in ("lang", "place", "hash"))
        for words, lang, place, number in zip(word_lists(batch.column("text")).to_pylist(), *columns, strict=True):
            words = [w for w in words if w]
            start = number % max(len(words) - SNIPPET + 1, 1)
            for part in (words, words[start : start + SNIPPET]) if words else ():
                at, share = vector(part)
                for key, value in zip(out, (lang, place, at, share), strict=True):
                    out[key].append(value)
        yield pa.RecordBatch.from_pydict(
            out, pa.schema({"lang": pa.string(), "place": pa.int32(), "at": pa.list_(pa.int64()), "share": pa.list_(pa.float64())})
        )


def families(profiles: dict[str, np.ndarray]) -> list[list[str]]:
    """Groups of languages with similar profiles, by average linkage of cosines."""
    names = sorted(profiles)
    unit = np.array([profiles[n] / max(np.linalg.norm(profiles[n]), 1e-12) for n in names])
    alike = unit @ unit.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > int(np.ceil(np.sqrt(len(names)))):
        pairs = [(-alike[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return sorted(sorted(names[i] for i in g) for g in groups)


def separate(at: list[np.ndarray], share: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias of a machine that is positive for the rows marked ``first``.

    Minimises the mean squared hinge loss, both sides weighing the same, and the decay of weights.
    """
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    column, value = np.concatenate(at).astype(np.int64), np.concatenate(share)
    known = np.bincount(column, minlength=BUCKETS) >= MIN_ROWS
    # Frequent n-grams would else drown the rest.
    scale = np.where(known, 1 / np.sqrt(np.bincount(column, value, BUCKETS) / len(at) + 1e-5), 0.0)
    value = value * scale[column]
    side = np.where(first, 1.0, -1.0)
    weigh = np.where(first, 0.5 / max(first.sum(), 1), 0.5 / max((~first).sum(), 1))
    weight, bias = np.zeros(BUCKETS), 0.0
    moments = np.zeros((2, BUCKETS + 1))
    for step in range(1, STEPS + 1):
        margin = side * (np.bincount(row, weight[column] * value, len(at)) + bias)
        slope = -2 * weigh * side * np.maximum(1 - margin, 0)
        grad = np.append(np.bincount(column, slope[row] * value, BUCKETS) + DECAY * weight, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        change = moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        rate = RATE * (1 - step / (STEPS + 1))
        weight, bias = weight - rate * change[:-1], bias - rate * change[-1]
    return weight * scale, float(bias)


@dataclass
class Model:
    """Families of languages and the machines: for each family, then for each pair within one."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # buckets by machines
    biases: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """For each word the sums of the machines' weights over its n-grams, and the number of these."""
        sums = np.zeros((len(words), len(self.biases) + 1))
        for owner, bucket in grams(words):
            for i in range(len(self.biases)):
                sums[:, i] += np.bincount(owner, self.weights[bucket, i], len(words))
            sums[:, -1] += np.bincount(owner, minlength=len(words))
        sums[[not w for w in words]] = 0  # what stands at the ends of a text
        return sums

    def margins(self, lists: pa.ListArray) -> np.ndarray:
        """Margin of every machine for every text of a batch."""
        words = lists.flatten().dictionary_encode()
        table = self.words(words.dictionary.to_pylist())
        place = words.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(False).astype(np.int64))
        sums = np.zeros((len(lists), table.shape[1]))
        for i in range(table.shape[1]):
            upto = np.concatenate([[0.0], np.cumsum(table[place, i])])
            sums[:, i] = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.biases

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the logistic of the least margin on the way."""
        found = self.margins(word_lists(texts))
        family = found[:, : len(self.families)].argmax(axis=1)
        least = found[np.arange(len(found)), family] if len(self.families) > 1 else np.full(len(found), np.inf)
        out = np.full(len(found), UNKNOWN, object)
        for number, names in enumerate(self.families):
            rows = np.flatnonzero(family == number)
            wins, total = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            own = [(i, p) for i, p in enumerate(self.pairs) if p[0] in names]
            closest = np.full((len(rows), len(names)), np.inf)
            for i, (a, b) in own:
                margin = found[rows, len(self.families) + i]
                for name, sign in ((a, 1), (b, -1)):
                    at = names.index(name)
                    wins[:, at] += sign * margin > 0
                    total[:, at] += sign * margin
                    closest[:, at] = np.minimum(closest[:, at], sign * margin)
            # Most wins, then the larger sum of margins, then the first name.
            rank = wins + np.tanh(total / max(len(names), 1)) / 4
            best = rank.argmax(axis=1)
            out[rows] = np.array(names, object)[best]
            least[rows] = np.minimum(least[rows], closest[np.arange(len(rows)), best])
        spoken = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(False)
        out[~spoken] = UNKNOWN
        return out.tolist(), np.where(spoken, 1 / (1 + np.exp(-2 * np.clip(least, -20, 20))), 0.0)


def sample(docs: DataFrame, limit: int = MAX_A_LANGUAGE) -> DataFrame:
    """``lang, place, at, share``: vectors of the lowest labelled texts of each language by hash."""
    order = Window.partitionBy("lang").orderBy("hash", "_id", "_text")
    chosen = (
        docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
        .select("lang", "text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
        .withColumn("hash", F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 40)))
    )
    # The places of narrow rows first, so that only texts of the sample move.
    low = (
        chosen.select("lang", "hash", "_id", "_text")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .groupBy("lang")
        .agg(F.max("hash").alias("_last"))
    )
    taken = chosen.join(F.broadcast(low), "lang").filter(F.col("hash") <= F.col("_last"))
    # Rows of one hash, copies for the most part, may pass the last place.
    taken = taken.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return stored(
        taken.select("lang", "place", "hash", "text").mapInArrow(
            _vectors, "lang string, place int, at array<long>, share array<double>"
        ),
        "language-sample",
    )


def fit(docs: DataFrame, limit: int = MAX_A_LANGUAGE) -> Model | None:
    """Families and machines learned from labelled rows that are not held out; None without any."""
    rows = sample(docs, limit)

    def profile(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS)
        for at, share in zip(group["at"], group["share"], strict=True):
            total[at] += share
        held = np.flatnonzero(total)
        return pd.DataFrame({"lang": [key[0]], "at": [held], "share": [total[held] / len(group)]})

    # One row a language.
    profiles = {}
    for r in rows.groupBy("lang").applyInPandas(profile, "lang string, at array<long>, share array<double>").collect():
        profiles[r["lang"]] = np.zeros(BUCKETS)
        profiles[r["lang"]][r["at"]] = r["share"]
    if not profiles:
        return None
    groups = families(profiles)
    pairs = [(a, b) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]]
    jobs = [(lang, j, lang in g, max(MAX_A_FAMILY // len(profiles), 1)) for j, g in enumerate(groups) if len(groups) > 1 for lang in profiles]
    jobs += [(lang, len(groups) + j, lang == p[0], limit) for j, p in enumerate(pairs) for lang in p]
    weights, biases = np.zeros((BUCKETS, len(groups) + len(pairs))), np.zeros(len(groups) + len(pairs))

    def machine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "place"], kind="stable")
        weight, bias = separate(list(group["at"]), list(group["share"]), group["first"].to_numpy(bool))
        held = np.flatnonzero(weight)
        return pd.DataFrame({"job": [key[0]], "at": [held], "weight": [weight[held]], "bias": [bias]})

    if jobs:
        schema = "lang string, job long, first boolean, upto long"
        todo = F.broadcast(docs.sparkSession.createDataFrame(jobs, schema))
        dealt = rows.join(todo, "lang").filter("place <= upto").drop("upto")
        learned = dealt.groupBy("job").applyInPandas(machine, "job long, at array<long>, weight array<double>, bias double")
        for r in learned.collect():
            weights[r["at"], r["job"]] = r["weight"]
            biases[r["job"]] = r["bias"]
    return Model(groups, pairs, weights, biases)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every document."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.predict(part) for part in slices(texts)]
            names = pa.array([n for part, _ in found for n in part], pa.string())
            score = pa.array(np.concatenate([np.zeros(0), *[s for _, s in found]]))
            yield pa.StructArray.from_arrays([names, score], ["lang_pred", "score"])

    return (
        docs.withColumn("_predicted", predicted("text"))
        .withColumns({"lang_pred": F.col("_predicted.lang_pred"), "score": F.col("_predicted.score")})
        .drop("_predicted")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    told = identify(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
