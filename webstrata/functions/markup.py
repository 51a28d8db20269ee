"""HTML columns that need no parser state: start tags, attributes, links, leaf blocks.

All regular expressions run in the JVM. Loops over tag content are possessive, so they
neither backtrack nor recurse on long input.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata import settings
from webstrata.functions import text as txt

# Inside a start tag, up to its ">": quotes protect only after an equals sign.
_INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
# A tag that is not closed reaches to the end of the page: it matches as well, by a branch of its
# own, so that nothing behind it is scanned again.
_SKIPPED = (
    r"(?is)<!--.*?(?:--!?>|\z)"
    rf"|(<(script|style)(?=[\s/>]){_INSIDE}(?<!/)>).*?(?:</\2(?=[\s/>])[^>]*+(?:>|\z)|\z)"
    rf"|<(?:script|style)(?=[\s/>]){_INSIDE}\z"
)
_VALUE = r"(?:\s*+=++\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])\S*+))?+"


def without_raw_text(html: Column) -> Column:
    """HTML without comments and without script and style bodies.

    The start tag of a script stays. ``<!>`` marks the place, so that the text before and
    after a comment remains two pieces.
    """
    return F.regexp_replace(html, _SKIPPED, r"<!>$1")


def start_tags(html: Column, *names: str) -> Column:
    """Start tags with one of the names, each from its name to before its ``>``.

    The pattern consumes every tag and captures only the wanted ones, so a ``<a`` inside an
    attribute value of another tag is not counted.
    """
    wanted = "|".join(names)
    pattern = rf"(?i)<(?:((?:{wanted})(?=[\s/>]){_INSIDE})>|[a-z]{_INSIDE}(?:>|\z))"
    found = F.regexp_extract_all(without_raw_text(html), F.lit(pattern), F.lit(1))
    return F.filter(found, lambda tag: tag != "")


def has_name(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)^{name}(?=[\s/]|\z)")


def tag_count(html: Column, name: str) -> Column:
    return F.coalesce(F.size(start_tags(html, name)), F.lit(0))


def _written(tag: Column, name: str) -> Column:
    """An attribute as written, ``name="value"``; ``''`` when absent."""
    pattern = (
        rf"(?is)^[a-z][^\s/]*+(?:[\s/]*+(?!{name}(?:[\s=/]|\z))[^\s=/]++{_VALUE})*+"
        rf"[\s/]*+({name}{_VALUE})"
    )
    return F.regexp_extract(tag, pattern, 1)


def _value(written: Column, name: str) -> Column:
    """The value without its quotes."""
    return F.regexp_replace(written, rf"(?is)^{name}\s*+=*+\s*+([\"']?)(.*)\1$", "$2")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, ``''`` when it is absent or has none."""
    return _value(_written(tag, name), name)


def unescape_each(values: Column) -> Column:
    """Decode the ``;``-terminated character references in every string of an array.

    Named ones come from the standard HTML 5 table, numeric ones are computed. A string
    without ``&`` takes no extra work.
    """
    table = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    named = F.from_json(F.lit(json.dumps(table)), "map<string,string>")

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*+);", 1)
        decimal = F.regexp_extract(piece, r"^#0*+([0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(piece, r"^#[xX]0*+([0-9A-Fa-f]{1,6});", 1)
        code = F.coalesce(
            F.conv(F.nullif(decimal, F.lit("")), 10, 10), F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10)
        ).cast("int")
        tail = F.regexp_replace(piece, r"^[^;]*+;", "")
        return F.coalesce(
            F.concat(_character(code), tail),
            F.concat(F.try_element_at(named, name), tail),
            F.concat(F.lit("&"), piece),
        )

    def whole(value: Column) -> Column:
        pieces = F.transform(
            F.split(value, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(decode(piece))
        )
        return F.when(value.contains("&"), F.array_join(pieces, "")).otherwise(value)

    return F.transform(values, whole)


def _character(code: Column) -> Column:
    """The character of a code point; 128 to 159 are read as Windows-1252, as browsers do."""
    western = [
        ord(bytes([b]).decode("cp1252", errors="ignore") or chr(b)) for b in range(0x80, 0xA0)
    ]
    point = F.when(
        code.between(0x80, 0x9F), F.get(F.array(*map(F.lit, western)), code - 0x80)
    ).when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code).otherwise(0xFFFD)
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return F.when(code.isNotNull(), char)


def with_structural_features(df: DataFrame, html: str = "html") -> DataFrame:
    """Add the six structural features.

    All are zero for NULL and, as a generator tag without content makes the whole page
    unusable, for such a page. Every start tag of interest is cut out once.
    """
    tags = F.col("_tags")
    generator_tags = F.filter(
        tags, lambda t: has_name(t, "meta") & (attribute(t, "name") == "generator")
    )
    hubspot = F.exists(
        tags,
        lambda t: has_name(t, "script") & attribute(t, "src").contains(settings.HUBSPOT_PART),
    )
    values = {
        f"generator_is_{name}": F.coalesce(F.col("_generator").contains(name), F.lit(False))
        for name in settings.GENERATORS
    }
    values["has_hubspot_script"] = hubspot
    values["link_count"] = F.size(F.filter(tags, lambda t: has_name(t, "a")))
    values["form_count"] = F.size(F.filter(tags, lambda t: has_name(t, "form")))
    unusable = F.col(html).isNull() | (F.col("_content") == "")
    return (
        df.withColumn("_tags", start_tags(F.col(html), "meta", "script", "a", "form"))
        .withColumn("_content", _written(F.get(generator_tags, F.lit(0)), "content"))
        .withColumn("_generator", F.lower(_value(F.col("_content"), "content")))
        .withColumns(
            {
                name: F.when(unusable, 0).otherwise(value.cast("int"))
                for name, value in values.items()
            }
        )
        .drop("_tags", "_content", "_generator")
    )


def hrefs(html: Column) -> Column:
    """Distinct ``href`` values of ``<a>`` tags, without in-page, mail and phone targets."""
    written = F.transform(start_tags(html, "a"), lambda tag: _written(tag, "href"))
    present = F.filter(written, lambda w: w != "")
    values = unescape_each(F.transform(present, lambda w: _value(w, "href")))
    kept = F.filter(values, lambda v: ~v.rlike("^(?:#|mailto:|tel:)"))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def leaf_blocks(html: Column, tag: str) -> Column:
    """Texts of a tag that does not nest; each text piece is stripped, pieces are joined.

    An element that is not closed ends with the page.
    """
    closing = rf"</{tag}(?=[\s/>])[^>]*+(?:>|\z)"
    pattern = rf"(?is)<{tag}(?=[\s/>]){_INSIDE}(?:>(.*?)(?:{closing}|\z)|\z)"
    bodies = F.regexp_extract_all(without_raw_text(html), F.lit(pattern), F.lit(1))
    inner_tag = rf"(?i){txt.SPACE}*+<[a-z/!]{_INSIDE}(?:>|\z){txt.SPACE}*+"
    texts = unescape_each(F.transform(bodies, lambda b: F.regexp_replace(b, inner_tag, "")))
    return F.filter(F.transform(texts, txt.collapse_space), lambda t: t != "")
