"""Quality rules of documents and of the hosts they come from.

Each rule is a condition on counts of one text, all computed inside the row. A host (the
``source`` of a document) fails a rule as often as its documents do; its rate is shrunk towards
all hosts' rates with a beta prior fitted to them by moments, so that a host with few documents
is not judged by them alone. A host whose shrunk rate of any rule reaches ``HOST_LIMIT`` goes
with all its documents.

Rule failures are added up per host before they move, and verdicts return by a lookup join that
spreads hot hosts. Repeated three-word windows are found by sorting the windows of the row, so a
very long text costs n log n.

Defined results: a NULL text has no words and fails the base rule; NULL sources are one host;
repeated rows count as often as they occur; an empty table gives an empty result. Other columns
are kept; names that start with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import BLANK, admitted, join_lookup, stored, word_array

MIN_WORDS = 50
#: A host goes if its shrunk rate of failures of one rule reaches this.
HOST_LIMIT = 0.5
#: The prior weighs between so many documents; the upper bound is for hosts that hardly differ.
PRIOR_RANGE = (1.0, 1000.0)
RULES = ("short", "repetitive", "symbols", "word_length", "lines")


def _repeated_words(windows: str) -> Column:
    """Words covered by windows whose hash occurs twice or more among ``windows``."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(placed)
    twice = F.transform(
        F.filter(
            "_ordered",
            lambda x, i: (x["h"] == F.get("_ordered", i - 1)["h"])
            | (x["h"] == F.get("_ordered", i + 1)["h"]),
        ),
        lambda x: x["i"],
    )
    return ordered, F.array_sort(twice)


def with_counts(df: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    empty = F.array().cast("array<bigint>")
    last = F.size("_hashes") - 3
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(
                F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2)
            ),
        ),
    ).otherwise(empty)
    ordered, twice = _repeated_words("_windows")
    none = F.lit(None).cast("array<struct<h:bigint,i:int>>")
    covered = F.aggregate(
        F.transform(
            "_places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_places", j + 1) - p, F.lit(3)))
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return (
        df.withColumn("_hashes", F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)))
        .withColumn("n_words", F.size("_hashes").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, f"[{BLANK}]+", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("_n_lines", F.size("_lines"))
        .withColumn("n_dup_lines", (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_windows", windows)
        .withColumn("_differ", F.size(F.array_distinct("_windows")) == F.size("_windows"))
        .withColumn("_ordered", F.when(~F.col("_differ"), ordered).otherwise(none))
        .withColumn("_places", twice)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_hashes", "_lines", "_windows", "_differ", "_ordered", "_places")
    )


def with_rules(counted: DataFrame) -> DataFrame:
    """Add ``base_failed`` and one 0/1 column ``_short`` ... for each of ``RULES``."""
    words = F.col("n_words")
    short = words < MIN_WORDS
    repetitive = 100 * F.col("n_repeat_words") > 50 * words
    failed = {
        "short": short,
        "repetitive": repetitive,
        "symbols": 2 * F.col("n_symbols") > words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
        "lines": 2 * F.col("n_dup_lines") > F.col("_n_lines"),
    }
    rules = {f"_{name}": failed[name].cast("long") for name in RULES}
    # Never true and not deterministic: the optimizer would else copy the counts, which refer to
    # one another, into a later filter on the verdict and evaluate each many times over.
    barrier = F.monotonically_increasing_id() < 0
    return counted.withColumns(rules | {"base_failed": short | repetitive | barrier})


def host_verdicts(ruled: DataFrame, host: str = "source") -> DataFrame:
    """``host, rejected`` with the shrunk rate of each rule: one row a host."""
    sums = [F.sum(f"_{name}").alias(f"_{name}") for name in RULES]
    hosts = ruled.groupBy(host).agg(F.count(F.lit(1)).alias("_n"), *sums)
    hosts = stored(hosts, "hosts")
    moments = hosts.agg(
        *[F.avg(F.col(f"_{r}") / F.col("_n")).alias(f"m_{r}") for r in RULES],
        *[F.coalesce(F.var_pop(F.col(f"_{r}") / F.col("_n")), F.lit(0.0)).alias(f"v_{r}") for r in RULES],
    )
    rates = hosts.crossJoin(F.broadcast(moments))  # one row of moments
    low, high = PRIOR_RANGE
    for r in RULES:
        mean, spread = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(high)
        weight = F.least(F.greatest(weight, F.lit(low)), F.lit(high))
        rates = rates.withColumn(
            f"{r}_rate", (F.col(f"_{r}") + weight * mean) / (F.col("_n") + weight)
        )
    worst = F.greatest(*[F.col(f"{r}_rate") for r in RULES])
    kept = [f"{r}_rate" for r in RULES]
    return rates.select(host, *kept, (worst >= HOST_LIMIT).alias("_rejected"))


def judge(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept`` to every document.

    Without the text the counted rows are stored, so that hosts and documents are judged without
    counting twice; with it they are counted again, as a copy of all texts would cost more.
    """
    ruled = with_rules(with_counts(admitted(docs, OUT[1:])))
    if not keep_text:
        ruled = stored(ruled.drop("text"), "counted")
    hosts = stored(host_verdicts(ruled).select("source", "_rejected"), "host-verdicts")
    joined = join_lookup(ruled, hosts, "source", ["n_words", "word_chars", "n_symbols"])
    kept = ~F.col("base_failed") & ~F.coalesce("_rejected", F.lit(False))
    return joined.withColumn("kept", kept).drop(
        "_rejected", "_n_lines", *[f"_{name}" for name in RULES]
    )


OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs, keep_text=False).select(*OUT)


def filter_sql(docs: str = "documents") -> str:
    """Common table expressions that end in ``judged``: the documents with counts and verdict."""
    conditions = {
        "short": f"n_words < {MIN_WORDS}",
        "repetitive": "100 * n_repeat_words > 50 * n_words",
        "symbols": "2 * n_symbols > n_words",
        "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
        "lines": "2 * n_dup_lines > n_lines",
    }
    low, high = PRIOR_RANGE
    flags = ", ".join(f"({c})::int f_{r}" for r, c in conditions.items())
    sums = ", ".join(f"sum(f_{r}) f_{r}" for r in RULES)
    means = ", ".join(
        f"avg(f_{r} / n::double) over () m_{r}, coalesce(var_pop(f_{r} / n::double) over (), 0) v_{r}"
        for r in RULES
    )
    rate = "(f_{r} + w_{r} * m_{r}) / (n + w_{r})"
    weights = ", ".join(
        f"least(greatest(case when v_{r} > 0 then m_{r} * (1 - m_{r}) / v_{r} - 1 else {high} end, {low}), {high}) w_{r}"
        for r in RULES
    )
    worst = ", ".join(rate.format(r=r) for r in RULES)
    return f"""
words_ as (select *, regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+') w_,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) l_, row_number() over () row_
  from {docs}),
windows_ as (select row_, i_, w_[i_] || chr(32) || w_[i_ + 1] || chr(32) || w_[i_ + 2] g_
  from (select row_, w_, unnest(range(1, len(w_) - 1)) i_ from words_)),
twice_ as (select row_, i_ from (select *, count(*) over (partition by row_, g_) c_ from windows_) where c_ > 1),
covered_ as (select row_, count(distinct i_ + k_) n from twice_, range(3) k(k_) group by row_),
counted_ as (select words_.* exclude (w_, l_), len(w_)::bigint n_words,
  coalesce(list_sum(list_transform(w_, lambda x: length(x))), 0)::bigint word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint n_symbols, len(l_)::bigint n_lines,
  (len(l_) - len(list_distinct(l_)))::bigint n_dup_lines, coalesce(covered_.n, 0)::bigint n_repeat_words
  from words_ left join covered_ using (row_)),
ruled_ as (select *, {flags} from counted_),
hosts_ as (select source, count(*) n, {sums} from ruled_ group by source),
moments_ as (select *, {means} from hosts_),
prior_ as (select *, {weights} from moments_),
rejected_ as (select source, greatest({worst}) >= {HOST_LIMIT} rejected from prior_),
judged as (select ruled_.*, f_short + f_repetitive > 0 base_failed, f_short + f_repetitive = 0 and not rejected kept
  from ruled_ join rejected_ on ruled_.source is not distinct from rejected_.source)"""


def oracle() -> str:
    return f"with {filter_sql()} select {', '.join(OUT)} from judged"
