"""Helpers the operators share: words, stored intermediates, lookups of any size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators.checkpoints import fresh_folder

#: Words are runs of characters outside this class.
BLANK = r"\x20\x09-\x0D"
#: A lookup of at most so many bytes is broadcast, a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Parts that the rows of one key are dealt to where a lookup is joined by shuffle.
SALTS = 64


def word_array(text: Column) -> Column:
    """Words of a text in order; an empty array for NULL or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+")
    head = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+")
    head = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - head - tail, F.lit(0)).cast("long")


def admitted(docs: DataFrame, added: Iterable[str]) -> DataFrame:
    """``docs`` without the columns that an operator would mix up with its own: those named like one
    it adds, which give way to it, and those whose names start with an underscore."""
    own = {name.lower() for name in added}
    return docs.drop(*[c for c in docs.columns if c.startswith("_") or c.lower() in own])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Cuts the lineage: what reads it later needs no executor that made it.
    """
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lookup_bytes(lookup: DataFrame) -> int:
    """Size of a lookup's rows: their values as text, and 16 bytes a row and value."""
    texts = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16 for c in lookup.columns]
    return lookup.agg(F.sum(sum(texts, F.lit(16)).cast("long"))).first()[0] or 0


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Left join of many rows to a stored lookup with one row per key; NULL meets NULL.

    Up to ``BROADCAST_BYTES``, measured, the lookup is broadcast. Beyond that every lookup row is
    repeated for each of ``SALTS`` salts and the rows of a key are dealt over the salts, so that
    a key with a third of all rows meets in as many tasks; the result is the same.
    """
    right = lookup.withColumnRenamed(key, "_key")
    if lookup_bytes(lookup) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(right), rows[key].eqNullSafe(right["_key"]), "left").drop("_key")
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS).cast("long")))
    right = right.withColumn("_s", F.explode(salts))
    same = left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_s"])
    return left.join(right, same, "left").drop("_key", "_salt", "_s")
