"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur. For each of ``SAMPLES``
positions every term draws two Gamma(2, 1) values and a uniform one from its hash, quantizes the
logarithm of its weight with them and gets a rank; the term and quantized weight of least rank are
the sample. Two texts agree in a position with the probability of their generalised Jaccard
similarity (sum of least weights over sum of largest). The rank is a continuous function of term
and quantized weight, so its bits stand for the sample; sixteen of them are kept, and texts that do
not share a sample agree by chance once in 65,536.

Weights are counted inside the row. Terms and groups of positions are exploded into rows that a
hash aggregate folds in the same task by plain minima: texts move once, into ranges of ``doc_id``
where each meets its next document, and nothing else of their size moves.

Defined results: a NULL text is an empty one; texts without words have the fingerprint of zeros, and
two of them have likeness 1; documents are ordered by descending ``doc_id`` (NULL last), rows of
equal ``doc_id`` by a hash of their text; a single document is its own next one; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import stored, word_array

GROUPS = 8
IN_GROUP = 8
SAMPLES = GROUPS * IN_GROUP
LEVELS = 1024
NEVER = "0000"


def gamma_quantiles(levels: int = LEVELS) -> np.ndarray:
    """Gamma(2, 1) at the middles of ``levels`` equal parts of (0, 1): 1 - (1 + x) exp(-x)."""
    wanted = (np.arange(levels) + 0.5) / levels
    low, high = np.zeros(levels), np.full(levels, 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def rank(term: Column, log_weight: Column, position: Column, steps: Column, logs: Column) -> Column:
    """Rank of a term of a given weight in a position: the logarithm of its sampling value.

    Of the 64 bits of a hash, ten pick the step r, ten the logarithm of c, and the rest are the
    uniform shift b: with t = floor(ln w / r + b), the rank is ln c - r (t - b + 1).
    """
    bits = F.xxhash64(term, position)
    mask = F.lit(LEVELS - 1)
    step = F.get(steps, bits.bitwiseAND(mask).cast("int"))
    log_c = F.get(logs, F.shiftrightunsigned(bits, 10).bitwiseAND(mask).cast("int"))
    shift = F.shiftrightunsigned(bits, 20) / F.lit(float(1 << 44))
    # A weight of one has t = 0.
    above = F.when(log_weight == 0, 1 - shift).otherwise(F.floor(log_weight / step + shift) - shift + 1)
    return log_c - step * above


def weighted_terms(words: Column) -> tuple[Column, Column]:
    """Ascending hashes of the words, and (in terms of ``_sorted``) each one with its count."""
    ascending = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)),
    )
    return ascending, F.when(F.size("_sorted") > 0, starts)


def sample(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key, fingerprint`` of every row; ``key`` is unique and partitions ``rows`` already."""
    quantiles = gamma_quantiles()
    steps, logs = F.lit(quantiles), F.lit(np.log(quantiles))
    ascending, starts = weighted_terms(word_array(F.col(text)))
    counted = F.transform(
        "_starts",
        lambda p, j: F.struct(
            F.get("_sorted", p).alias("h"),
            (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - p).alias("w"),
        ),
    )
    terms = (
        rows.withColumn("_sorted", ascending)
        .withColumn("_starts", starts)
        .withColumn("_terms", counted)
        .select(*key, F.explode_outer("_terms").alias("_t"))
        .select(*key, F.col("_t.h").alias("_h"), F.log(F.col("_t.w").cast("double")).alias("_w"))
        .select(*key, "_h", "_w", F.explode(F.array(*map(F.lit, range(GROUPS)))).alias("_g"))
    )
    # Without a term the weight, and so the rank, is NULL. No condition stands around a rank, or Spark
    # would compute its hash and step anew wherever the rank names them.
    ranks = [
        rank(F.col("_h"), F.col("_w"), F.col("_g") * IN_GROUP + i, steps, logs) for i in range(IN_GROUP)
    ]
    least = terms.groupBy(*key, "_g").agg(*[F.min(r).alias(f"_{i}") for i, r in enumerate(ranks)])
    digits = [
        F.coalesce(
            F.lpad(F.lower(F.hex(F.xxhash64(f"_{i}").bitwiseAND(F.lit(0xFFFF)))), 4, "0"), F.lit(NEVER)
        )
        for i in range(IN_GROUP)
    ]
    digits = [F.when(F.col(f"_{i}").isNull(), NEVER).otherwise(d) for i, d in enumerate(digits)]
    parts = least.select(*key, F.struct("_g", F.concat(*digits).alias("d")).alias("_part"))
    whole = parts.groupBy(*key).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return whole.select(*key, F.array_join("_parts.d", "").alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Share of positions in which two fingerprints agree: estimates generalised Jaccard."""
    same = F.filter(
        F.sequence(F.lit(0), F.lit(SAMPLES - 1)),
        lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)),
    )
    return F.size(same) / F.lit(float(SAMPLES))


def ranges(docs: DataFrame) -> list[float]:
    """Bounds of about equally many ``doc_id``, as many as there are shuffle partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares)).first()[0]
    return [-math.inf, *sorted(set(found or [0.0])), math.inf]


def with_range(docs: DataFrame, bounds: list[float]) -> DataFrame:
    """Add ``_range``: descending ``doc_id`` has ascending ranges; NULL is in the last one."""
    value = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308))
    cut = Bucketizer(splits=bounds, inputCol="_value", outputCol="_bucket")
    cut_docs = cut.transform(docs.withColumn("_value", value))
    return cut_docs.withColumn("_range", (F.lit(len(bounds)) - F.col("_bucket")).cast("int")).drop(
        "_value", "_bucket"
    )


def _following(heads: DataFrame, names: list[str]) -> DataFrame:
    """``_range`` and, as ``_head_...``, the first row of the next range; the last has the first's.

    One row for each range: no more than there are shuffle partitions.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return heads.select(
        "_range",
        *[F.coalesce(F.lead(n).over(order), F.first(n).over(everything)).alias(f"_head_{n}") for n in names],
    )


def with_next_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _range, _place`` and ``next_text``, the text of the next document."""
    bounds = ranges(docs)
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = with_range(whole, bounds).withColumn("_tie", F.xxhash64("text"))
    top = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    same = (ranged["_range"] == top["_range"]) & ranged["doc_id"].eqNullSafe(top["_top"])
    heads = stored(
        ranged.join(F.broadcast(top), same, "left_semi")  # a row for each range
        .groupBy("_range")
        .agg(F.min_by("text", "_tie").alias("text")),
        "heads",
    )
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last("doc_id"), "_tie")
    return (
        ranged.withColumn("_place", F.row_number().over(order))
        .withColumn("_next", F.lead("text").over(order))
        .join(_following(heads, ["text"]).hint("merge"), "_range", "left")
        .withColumn("next_text", F.coalesce("_next", "_head_text"))
        .drop("_tie", "_next", "_head_text")
    )


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, its edited text and their likeness to its neighbours."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_half")),
        F.substring("next_text", F.lit(1), F.col("_half")),
    )
    key = ["doc_id", "n_chars", "_sha", "_range", "_place", "_side"]
    sides = (
        with_next_text(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("_half", half)
        .withColumn("_edited", edited)
        .withColumn("_sha", F.unhex(F.sha2(F.col("_edited"), 256)))
        .select(
            "doc_id", "n_chars", "_sha", "_range", "_place",
            F.explode(F.array(
                F.struct(F.lit(0).alias("s"), F.col("text").alias("t")),
                F.struct(F.lit(1).alias("s"), F.col("_edited").alias("t")),
            )).alias("_both"),
        )
        .select(*key[:-1], F.col("_both.s").alias("_side"), F.col("_both.t").alias("_text"))
    )
    sampled = sample(sides, key, "_text")
    own = F.max(F.when(F.col("_side") == 0, F.col("fingerprint"))).alias("fingerprint")
    other = F.max(F.when(F.col("_side") == 1, F.col("fingerprint"))).alias("edited_fingerprint")
    prints = stored(sampled.groupBy(*key[:-1]).agg(own, other), "fingerprints")
    heads = prints.filter("_place = 1").select("_range", "fingerprint")
    order = Window.partitionBy("_range").orderBy("_place")
    joined = (
        prints.withColumn("_next", F.lead("fingerprint").over(order))
        .join(_following(heads, ["fingerprint"]).hint("merge"), "_range", "left")
        .withColumn("_next", F.coalesce("_next", "_head_fingerprint"))
    )
    return joined.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("_sha")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "_next").alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
