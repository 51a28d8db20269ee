"""Text columns: whitespace, tokens, n-grams, counts."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata import settings

# Whitespace as Unicode text processing sees it; Java's own \s is ASCII only.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}++|{SPACE}++$", "")


def collapse_space(text: Column) -> Column:
    """Every run of whitespace becomes one space; none is left at the ends."""
    return F.btrim(F.regexp_replace(text, rf"{SPACE}++", " "))


def block_text(blocks: Column) -> Column:
    """Texts of an ``array<struct<tag,text>>`` joined by one space; NULL gives ``''``."""
    return F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), " "), F.lit(""))


def words(text: Column) -> Column:
    """All lower-cased words, one letter ones included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_set_count(text: Column, wanted: Iterable[str]) -> Column:
    """How often a whole word of ``wanted`` occurs; 0 for NULL.

    A word character is any letter, digit or ``_`` of any script (Java's ``\\b`` would also
    count combining marks). One regular expression pass; no word array is built, and the
    borders are looked at only where a wanted word stands.
    """
    border = r"[\p{L}\p{N}_]"
    pattern = "|".join(
        f"{w}(?!{border})(?<!{border}{w})" for w in (re.escape(word) for word in wanted)
    )
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(pattern)), F.lit(0))


def content_features(text: Column) -> dict[str, Column]:
    return {
        "personal_pronoun_count": word_set_count(text, settings.PERSONAL_PRONOUNS),
        "corporate_pronoun_count": word_set_count(text, settings.CORPORATE_PRONOUNS),
        "corporate_keyword_count": word_set_count(text, settings.CORPORATE_KEYWORDS),
    }


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-cased words of two characters or more, without stop words, in text order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONG_WORD), F.lit(0))
    stop = list(stop_words)
    return F.filter(found, lambda word: ~word.isin(stop)) if stop else found


def word_ngrams(words: str, low: int = 1, high: int = 2) -> Column:
    """Space-joined runs of ``low`` to ``high`` words of an array column."""
    array = F.col(words)

    def run(n: int) -> Column:
        if n == 1:
            return array
        count = F.size(array) - (n - 1)
        joined = F.slice(array, F.lit(1), count)
        for skip in range(1, n):
            joined = F.zip_with(
                joined,
                F.slice(array, F.lit(skip + 1), count),
                lambda left, right: F.concat_ws(" ", left, right),
            )
        return F.when(count > 0, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[run(n) for n in range(low, high + 1)])


def with_char_ngrams(df: DataFrame, text: str, out: str, low: int = 3, high: int = 5) -> DataFrame:
    """Add the character runs of the lower-cased text; runs of blanks count as one blank."""
    flat = F.col("_flat")

    def run(n: int) -> Column:
        count = F.length(flat) - (n - 1)
        return F.when(
            count > 0,
            F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(flat, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))

    return (
        df.withColumn("_flat", F.regexp_replace(F.lower(F.col(text)), rf"{SPACE}{{2,}}", " "))
        .withColumn(out, F.concat(*[run(n) for n in range(low, high + 1)]))
        .drop("_flat")
    )


def with_term_counts(df: DataFrame, terms: str, out: str) -> DataFrame:
    """Add ``array<struct<term,tf>>``, the term frequencies inside each row's term array.

    The terms are sorted; each run of equal terms is as long as the distance from its start
    to the next one. So no shuffle on (document, term) is needed.
    """
    size, starts = F.size("_sorted"), F.col("_starts")

    def term(i: Column) -> Column:
        return F.get(F.col("_sorted"), i)

    return (
        df.withColumn("_sorted", F.sort_array(F.coalesce(terms, F.array().cast("array<string>"))))
        .withColumn(
            "_starts",
            F.when(
                size > 0,
                F.filter(
                    F.sequence(F.lit(0), size - 1),
                    lambda i: (i == 0) | (term(i) != term(i - 1)),
                ),
            ).otherwise(F.array().cast("array<int>")),
        )
        .withColumn(
            out,
            F.zip_with(
                starts,
                F.slice(starts, F.lit(2), F.size(starts)),
                lambda start, end: F.struct(
                    term(start).alias("term"),
                    (F.coalesce(end, size) - start).cast("long").alias("tf"),
                ),
            ),
        )
        .drop("_sorted", "_starts")
    )
