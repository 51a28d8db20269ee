"""Mixing sources to target weights by Sainte-Lague apportionment of equal-word blocks.

The documents of a source are dealt into shards of about ``shard_words`` words and laid end to
end, in a seeded order, as a line of words that is cut into blocks of ``block_words``. Blocks
are seats: highest quotients ``votes / (2 k + 1)`` give each source its number of blocks from
its target, then each group of shards and each shard its own from their sizes. A shard then
takes its quota by systematic selection with a seeded start, so a block is taken
``quota / blocks`` times, rounded down or up. A document takes what its part of the line takes.

Only one narrow row per shard, source and document moves; documents of one source are spread
over its shards by their id and text, so no task holds a source. All arithmetic on quotas is exact on integers.

Defined results: a NULL text has size 0 and takes nothing; NULL sources are one source, the
last; repeated rows are separate documents; documents of size 0 take nothing; an empty table
gives an empty result; a text of any length is one document and may take in many blocks. Other
columns of the input are kept, but for those named ``size``, ``source_size``, ``target`` or ``taken``, which
give way to the added ones, and those whose names start with an underscore, which are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import BLANK, admitted, join_lookup, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 32
SHARD_WORDS = 65536
SHARDS_A_GROUP = 1024
SEED = "mix"


def _number(*parts: Column | str) -> Column:
    """A 32-bit number from MD5, the same in any engine."""
    text = F.concat_ws("|", F.lit(SEED), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(
    children: DataFrame, parent: list[str], order: str, votes: str, seats: str, out: str
) -> DataFrame:
    """Add ``out``: each child's seats of its parent's ``seats`` by highest quotients.

    A child's seats differ from ``seats * votes / total`` by at most
    ``children * votes / (2 * total) + 1/2``: the divisor that gives the right sum moves the
    sum of ideal shares by at most half a seat for each child. So only the quotients in that
    window are ranked, a number of rows in proportion to the number of children; those below
    are seats in any case. Ties go to the lower ``order``.
    """
    whole = Window.partitionBy(*parent)
    ideal = F.col("_ideal")
    ranked = Window.partitionBy(*parent).orderBy(F.desc("_quotient"), F.asc(order), F.asc("_k"))
    windowed = (
        children.withColumn("_votes", F.sum(votes).over(whole).cast("double"))
        .withColumn("_children", F.count(F.lit(1)).over(whole))
        .withColumn("_part", F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")))
        .filter(F.col("_part") > 0)
        .withColumn("_ideal", F.col(seats) * F.col("_part"))
        .withColumn("_reach", F.col("_children") * F.col("_part") / 2 + 1)
        .withColumn("_low", F.greatest(F.lit(0), F.floor(ideal - F.col("_reach"))))
        .withColumn("_high", F.floor(ideal + F.col("_reach")) + 1)
    )
    open_seats = F.col(seats) - F.sum("_low").over(whole)
    won = (
        windowed.withColumn("_open", open_seats)
        .withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .groupBy(*parent, order)
        .agg(
            (F.first("_low") + F.sum((F.col("_rank") <= F.col("_open")).cast("long"))).alias(out)
        )
    )
    return children.join(won, [*parent, order], "left").fillna(0, [out])


def targets(sources: DataFrame) -> DataFrame:
    """Add number, weight and ``target`` to ``_source, source_size``: one narrow row a source.

    Targets are filled by weight and stop at ``CAP`` times the source's size. In ascending order
    of cap per weight, a source stops if its share of what is left exceeds its cap.
    """
    everything = Window.partitionBy(F.lit(0))
    number = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("_source"))
    filled = Window.partitionBy(F.lit(0)).orderBy("_ratio", "_no")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filled.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_no") - 1) % len(WEIGHTS) + 1)
    wanted = F.sum("source_size").over(everything) * SHARE
    ranked = (
        sources.withColumn("_no", F.row_number().over(number))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * CAP)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_wanted", wanted)
        .withColumn("_left", F.col("_wanted") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(from_here))
        .withColumn("_full", F.col("_left") * F.col("_weight") > F.col("_cap") * F.col("_weights"))
        .withColumn("_rest", F.col("_wanted") - F.coalesce(_over("_cap", everything), F.lit(0)))
        .withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything))
    )
    level = F.col("_rest") * F.col("_weight") / F.col("_open")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level)
    return ranked.select(
        "_source", "_no", "source_size", target.alias("target"), F.col("_full").alias("_full")
    )


def _over(column: str, window) -> Column:
    return F.sum(F.when(F.col("_full"), F.col(column))).over(window)


ADDED = ("size", "source_size", "target", "taken")


def _placed(docs: DataFrame) -> DataFrame:
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.withColumn("size", word_count(F.col("text"))).withColumn(
        "_hash", _number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    )


def mix(docs: DataFrame) -> DataFrame:
    """Add ``size, source_size, target, taken`` to every document, and the marks ``_start``,
    ``_blocks``, ``_quota``, ``_offset`` from which ``taken_text`` cuts the taken words."""
    docs = admitted(docs, ADDED)
    narrow = stored(_placed(docs).select("source", "size", "_hash"), "sizes")
    totals = narrow.groupBy(F.col("source").alias("_source")).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")
    )
    sources = targets(totals.drop("_docs"))
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS)
    sources = sources.withColumn("_all", F.lit(0)).withColumn("_seats", seats.cast("long"))
    sources = apportion(sources, ["_all"], "_no", "target", "_seats", "_source_seats")
    shards = F.ceil(F.col("source_size") / SHARD_WORDS)
    sources = stored(
        sources.select(
            "_source", "_no", "source_size", "target", "_source_seats",
            F.greatest(F.lit(1), shards).cast("long").alias("_shards"),
        ),
        "sources",
    )
    shard = F.pmod(F.col("_hash"), F.col("_shards"))
    lookup = sources.withColumnRenamed("_source", "source")
    sized = (
        join_lookup(narrow, lookup, "source", ["_hash"])
        .withColumn("_shard", shard)
        .groupBy("_no", "_shard")
        .agg(F.sum("size").alias("_words"), F.first("_source_seats").alias("_source_seats"))
        .withColumn("_group", F.floor(F.col("_shard") / SHARDS_A_GROUP))
    )
    sized = stored(sized, "shards")
    groups = sized.groupBy("_no", "_group").agg(
        F.sum("_words").alias("_group_words"), F.first("_source_seats").alias("_source_seats")
    )
    groups = apportion(groups, ["_no"], "_group", "_group_words", "_source_seats", "_group_seats")
    quotas = apportion(
        sized.drop("_source_seats").join(groups.select("_no", "_group", "_group_seats"), ["_no", "_group"]),
        ["_no", "_group"], "_shard", "_words", "_group_seats", "_seats",
    )
    blocks = F.ceil(F.col("_words") / BLOCK_WORDS)
    quotas = quotas.select("_no", "_shard", blocks.cast("long").alias("_blocks"), "_seats").select(
        "_no", "_shard", "_blocks",
        F.least("_seats", F.col("_blocks") * CAP).alias("_quota"),
        F.pmod(_number(F.col("_no"), F.col("_shard")), F.greatest("_blocks", F.lit(1))).alias("_offset"),
    )
    line = Window.partitionBy("_no", "_shard").orderBy("_hash", "doc_id", "size", "_text")
    dealt = join_lookup(_placed(docs), lookup.drop("_source_seats"), "source", ["_hash"])
    return (
        dealt.withColumn("_shard", shard)
        .join(quotas, ["_no", "_shard"])
        .withColumn("_text", F.xxhash64("text"))
        .withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("size"))
        .withColumn("taken", _taken_before("_end") - _taken_before("_start"))
        .drop("_no", "_shard", "_hash", "_text", "_end", "_shards")
    )


def _taken_before(place: str) -> Column:
    """Words taken of the first ``place`` words of the shard's line."""
    whole = f"({place} div {BLOCK_WORDS})"
    before = f"(({whole} * _quota + _offset) div greatest(_blocks, 1))"
    after = f"((({whole} + 1) * _quota + _offset) div greatest(_blocks, 1))"
    return F.expr(
        f"{BLOCK_WORDS} * {before} + ({place} % {BLOCK_WORDS}) * ({after} - {before})"
    )


def taken_text(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is taken, with the words taken that time as its text.

    Words keep the blanks that follow them. Blocks taken at least ``n`` times are in the ``n``-th
    row; where all are, the text is left as it is.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"[^{BLANK}]+[{BLANK}]*"), F.lit(0))
    copies = (
        "((place div {b} + 1) * _quota + _offset) div _blocks"
        " - ((place div {b}) * _quota + _offset) div _blocks"
    ).format(b=BLOCK_WORDS)
    copies = copies.replace("place", "(_start + i)")
    some = F.expr(f"array_join(filter(_pieces, (w, i) -> {copies} >= _time), '')")
    base = F.expr("_quota div greatest(_blocks, 1)")
    return (
        mixed.filter(F.col("taken") > 0)
        .withColumn("_base", base)
        .withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(CAP))))
        .filter(F.col("_time") <= F.col("_base") + 1)
        .withColumn("_pieces", F.when(F.col("_time") > F.col("_base"), pieces))
        .withColumn("text", F.when(F.col("_time") > F.col("_base"), some).otherwise(F.col("text")))
        .filter(F.col("text") != "")
        .drop("_base", "_time", "_pieces", "_start", "_blocks", "_quota", "_offset")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    """The same in DuckDB SQL."""

    def seats(rows: str, parent: str, order: str, votes: str, given: str) -> str:
        return f"""(
  with w as (select *, sum({votes}) over (partition by {parent})::double v_, count(*) over (partition by {parent}) c_ from {rows}),
  p as (select *, {votes} / v_ p_ from w where v_ > 0 and {votes} > 0),
  r as (select *, greatest(0, floor({given} * p_ - (c_ * p_ / 2 + 1)))::bigint low_,
          floor({given} * p_ + (c_ * p_ / 2 + 1))::bigint + 1 high_ from p),
  o as (select *, {given} - sum(low_) over (partition by {parent}) open_ from r),
  k as (select *, unnest(range(low_, high_ + 1)) k_ from o),
  q as (select *, row_number() over (partition by {parent} order by {votes} / (2 * k_ + 1)::double desc, {order}, k_) rank_ from k)
  select {parent}, {order}, (any_value(low_) + sum((rank_ <= open_)::bigint))::bigint won
  from q group by {parent}, {order})"""

    def number(text: str) -> str:
        return f"('0x' || substr(md5('{SEED}|' || {text}), 1, 8))::bigint"

    def before(place: str) -> str:
        whole = f"({place} // {BLOCK_WORDS})"
        return (
            f"({BLOCK_WORDS} * (({whole} * quota + shift) // greatest(blocks, 1)) + ({place} % {BLOCK_WORDS}) *"
            f" ((({whole} + 1) * quota + shift) // greatest(blocks, 1) - ({whole} * quota + shift) // greatest(blocks, 1)))"
        )

    weights = ", ".join(map(str, WEIGHTS))
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+'))::bigint size,
    {number("coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))")} h from documents),
s0 as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) no from s0),
s2 as (select *, ([{weights}])[((no - 1) % {len(WEIGHTS)} + 1)::int] weight, source_size * {CAP} cap from s1),
s3 as (select *, sum(source_size) over () * {SHARE} wanted,
    coalesce(sum(cap) over (order by cap / weight::double, no rows between unbounded preceding and 1 preceding), 0) used,
    sum(weight) over (order by cap / weight::double, no rows between current row and unbounded following) weights from s2),
s4 as (select *, (wanted - used) * weight > cap * weights::double is_full from s3),
s5 as (select *, case when is_full then cap::double else
    (wanted - coalesce(sum(cap) filter (is_full) over (), 0)) * weight / sum(weight) filter (not is_full) over () end target from s4),
s6 as (select *, 0 one, round(sum(target) over () / {BLOCK_WORDS})::bigint seats from s5),
s as (select s6.*, coalesce(a.won, 0) source_seats,
    greatest(1, ceil(source_size / {SHARD_WORDS}.0)::bigint) shards
    from s6 left join {seats("s6", "one", "no", "target", "seats")} a using (no)),
e as (select d.*, s.no, s.source_size, s.target, s.source_seats, d.h % s.shards shard
    from d join s on d.source is not distinct from s.source),
f as (select no, shard, sum(size)::bigint words, any_value(source_seats) source_seats, shard // {SHARDS_A_GROUP} grp
    from e group by no, shard),
g as (select no, grp, sum(words)::bigint words, any_value(source_seats) source_seats from f group by no, grp),
g2 as (select f.no, f.grp, f.shard, f.words, coalesce(a.won, 0) group_seats
    from f left join {seats("g", "no", "grp", "words", "source_seats")} a on f.no = a.no and f.grp = a.grp),
g3 as (select *, no * 1000000 + grp parent from g2),
q as (select g3.no, g3.shard, ceil(words / {BLOCK_WORDS}.0)::bigint blocks, coalesce(a.won, 0) won
    from g3 left join {seats("g3", "parent", "shard", "words", "group_seats")} a on g3.parent = a.parent and g3.shard = a.shard),
q2 as (select no, shard, blocks, least(won, {CAP} * blocks) quota,
    {number("no || '|' || shard")} % greatest(blocks, 1) shift from q),
l as (select e.*, blocks, quota, shift,
    sum(size) over (partition by e.no, e.shard order by h, doc_id, size rows unbounded preceding)::bigint place
    from e join q2 on e.no = q2.no and e.shard = q2.shard)
select doc_id, size, source_size, target, ({before("place")} - {before("(place - size)")})::bigint taken from l
"""
