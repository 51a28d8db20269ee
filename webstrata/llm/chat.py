"""Chat formatting: keep the conversations that no longer one continues, then render them.

A log often holds snapshots of one conversation as it grew. The running hash of a
conversation's first turns (an exclusive or over the turns' hashes, each taken with its place)
names that prefix; a conversation whose full hash is the prefix hash of a longer one goes. All
comparisons are on narrow rows of hashes that are made distinct before they move, so a first turn
or a conversation that a third of the log shares is one row for each task.

Defined results: turns are ordered by (turn, role, text), NULL first, and a turn logged twice
counts once; NULL role or text are values of their own and render as an empty string; rows of NULL
``conv_id`` are one conversation; of equal conversations the least ``conv_id`` stays (NULL
last); an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_i", "role", F.col("role").isNull(), "text", F.col("text").isNull())


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns``: the distinct turns in order, each with the hashes of the
    prefix that ends there. One shuffle, by conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    own = F.struct("turn", "role", "text")
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("_new", ~own.eqNullSafe(F.lag(own).over(order)))
        .withColumn("_i", F.sum(F.col("_new").cast("long")).over(running))
        .filter("_new")
        .withColumn("_h", F.bit_xor(_hash(1)).over(running))
        .withColumn("_g", F.bit_xor(_hash(2)).over(running))
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.array_sort(F.collect_list(F.struct("_i", "_h", "_g", "role", "text"))).alias("turns"),
        )
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """The stored conversations that are no prefix of another one, one of each set of equals."""
    prefixes = conversations.select(
        "conv_id", "n_turns",
        F.explode(F.arrays_zip("turns._i", "turns._h", "turns._g")).alias("p"),
    ).select("conv_id", "n_turns", "p._i", "p._h", "p._g")
    whole = prefixes.filter(F.col("_i") == F.col("n_turns"))
    first = whole.groupBy("_i", "_h", "_g").agg(F.min("conv_id").alias("conv_id"))
    shorter = prefixes.filter(F.col("_i") < F.col("n_turns")).select("_i", "_h", "_g").distinct()
    kept = first.join(shorter, ["_i", "_h", "_g"], "left_anti").select(F.col("conv_id").alias("_kept"))
    same = conversations["conv_id"].eqNullSafe(kept["_kept"])
    return conversations.join(kept, same, "left_semi")


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, rendered``: every turn between its marks, one after the other."""
    part = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"),
            F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n"),
        ),
    )
    return conversations.select("conv_id", "n_turns", F.array_join(part, "").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations of a log of turns."""
    return render(maximal(stored(with_prefix_hashes(turns), "conversations")))


def query(spark, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
with t as (select distinct conv_id, turn, role, text from conversations),
c as (select conv_id, count(*) n_turns,
  list({{'r': role, 't': text}} order by turn nulls first, role nulls first, text nulls first) turns from t group by conv_id),
u as (select min(conv_id) conv_id, n_turns, turns from c group by n_turns, turns),
k as (select * from u where not exists (
  select 1 from u v where v.n_turns > u.n_turns and v.turns[1] is not distinct from u.turns[1]
  and v.turns[1:u.n_turns] = u.turns))
select conv_id, n_turns, array_to_string(list_transform(turns, lambda x:
  '{OPEN}' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '{CLOSE}' || chr(10)), '') rendered
from k
"""
