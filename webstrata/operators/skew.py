"""Per-key limits and joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_per_key(
    df: DataFrame, key: str, order: list[str], limit: int | Column, bound: int, salts: int = 64
) -> DataFrame:
    """The first ``limit`` rows of every key, in the given total order.

    Two rounds: first within (key, salt), then within the key on what is left, at most
    ``salts * bound`` rows per key. Both rounds are ``row_number`` filters, which Spark also
    applies before the shuffle. The salt mixes the order columns with the input partition,
    so that even very many equal rows are spread; the result does not depend on it. ``bound`` is the largest value ``limit`` can take. With one
    salt there is one round, for input that is known to hold few rows per key.
    """
    kept = df
    if salts > 1:
        local = Window.partitionBy(key, "_salt").orderBy(*order)
        kept = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)) + F.spark_partition_id())
            .withColumn("_salt", F.pmod("_salt", F.lit(salts)))
            .withColumn("_rank", F.row_number().over(local))
            .filter(F.col("_rank") <= bound)
            .drop("_salt")
        )
    whole = Window.partitionBy(key).orderBy(*order)
    return (
        kept.withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= bound)
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )


def hot_keys(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """Keys that hold more than one part in ``parts`` of all rows: fewer than ``parts`` keys."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n"))
    return counts.filter(F.col("_n") * parts > total.scalar()).select(key)


def join_spread(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "inner",
    parts: int = 64,
) -> DataFrame:
    """Join many rows to a lookup with one row per key, spreading the rows of hot keys.

    A row of a hot key gets one of ``parts`` salts from its ``spread_by`` columns, and the
    lookup row of that key is repeated for each salt; all other keys keep salt 0. There are
    fewer than ``parts`` hot keys, so only their list is broadcast. ``rows`` is read twice:
    pass a stored table. ``how`` is inner, left, left_semi or left_anti.
    """
    hot = F.broadcast(hot_keys(rows, key, parts).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")
    # NULL keys match nothing, but would all meet in one task.
    salted = F.when(F.col("_hot") | F.col(key).isNull(), spread).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(
        F.array(F.lit(0))
    )
    left = rows.join(hot, key, "left").withColumn("_salt", salted).drop("_hot")
    right = lookup.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
