"""From documents to token ids: quality, near copies, repeated passages, mix, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that ``run`` writes as Parquet and
reads again for the next one. All but the last return the columns of documents. Rows that a
stage does not judge keep their text byte for byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.llm import bpe, mixing, ngram_join, quality, substrings
from webstrata.operators.checkpoints import fresh_folder


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, source`` and the other columns as one, safe from an operator's own names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", "source", F.struct(*others).alias("row"))


def _unpacked(rows: DataFrame, columns: list[str], cut: bool = True) -> DataFrame:
    """The columns that were packed; where texts were cut, with ``n_chars`` of what they are now."""
    now = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if cut else {})
    return rows.select(*[now.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return _unpacked(quality.judge(_packed(docs)).filter("kept"), docs.columns, cut=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the row of least ``doc_id``, NULL last, stays.

    A row is known by its ``doc_id`` and the hash of its text, so rows of one ``doc_id`` with texts of
    different components all stay, and of copies without any one does. Rows without a word have no
    copies and stay.
    """
    spoken = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.filter(spoken).withColumns(
        {"_n": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_h": F.xxhash64("text")}
    )
    joined = ngram_join.join(named.select(F.struct("_n", "_id", "_h").alias("doc_id"), "text"))
    kept = joined.filter("component_id = doc_id").select("doc_id.*").distinct()
    key = ["_n", "_id", "_h"]
    # Rows of one key are copies but for their other columns: one of them in the order of these.
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map" not in kind]
    first = Window.partitionBy(*key).orderBy(F.xxhash64(*others) if others else F.lit(0))
    one = named.withColumn("_row", F.row_number().over(first)).filter("_row = 1").join(kept, key)
    return one.select(*docs.columns).unionByName(docs.filter(~spoken))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go, and documents of which none are left."""
    found = substrings.dedup(_packed(docs)).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _unpacked(found.withColumn("text", text), docs.columns)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time a document is taken, with the words taken that time."""
    return _unpacked(mixing.taken_text(mixing.mix(_packed(docs))), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, number of tokens and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", target_mix),
    ("BPE encoding and decoding", token_ids),
]

#: The last stage is beyond SQL; the stages before it are checked one by one in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        folder = fresh_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
