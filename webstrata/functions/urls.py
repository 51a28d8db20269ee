"""URL columns: domain, path, features, standard form and reference resolution.

Functions of a frame build their result in steps, each step a projection of its own, so
that an intermediate value is computed once per row however often later steps use it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata import settings

_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)"
_AUTHORITY = rf"^{_SCHEME}?//([^/?#]*)"
_PATH = rf"^{_SCHEME}?(?://[^/?#]*)?([^?#]*)"
_ADDRESS = r"\[(?:[vV][0-9A-Fa-f]+\..+|[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?)\]"
_CONTROLS = "".join(map(chr, range(0x21)))


def _parsable(url: Column) -> Column:
    """URL parsers skip leading control characters and all tabs and line breaks."""
    return F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_CONTROLS))


def netloc(url: Column) -> Column:
    return F.regexp_extract(_parsable(url), _AUTHORITY, 1)


def is_invalid(url: Column) -> Column:
    """True for NULL and for a host whose square brackets hold no IP literal."""
    bracketed = url.contains("[") | url.contains("]")
    host = netloc(url)
    return url.isNull() | (bracketed & host.rlike(r"[\[\]]") & ~host.rlike(_ADDRESS))


def domain(url: Column) -> Column:
    """Network location without any ``www.``; port, user info and case stay."""
    return F.when(is_invalid(url), F.lit("")).otherwise(
        F.replace(netloc(url), F.lit("www."), F.lit(""))
    )


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(_parsable(url), _PATH, 1), r";[^/]*$", "")


def standardize(url: Column) -> Column:
    """Prefix ``https://`` unless the string starts with ``http``."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def suffix_flag(domain: Column, suffixes: Iterable[str] = settings.DEV_SUFFIXES) -> Column:
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | domain.endswith(suffix)
    return hit.cast("int")


def path_depth(path: Column) -> Column:
    """0 for the root path, else the number of segments between the outer slashes."""
    inner = F.btrim(path, F.lit("/"))
    slashes = F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit("")))
    return F.when(path == "/", 0).otherwise(slashes + 1)


def with_url_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the six URL features; all are zero for a URL that cannot be parsed."""
    link, host, bad = F.col(url), F.col("_host"), F.col("_bad")
    values = {
        "url_len": F.length(link),
        "domain_len": F.length(host),
        "path_depth": path_depth(F.col("_path")),
        "is_dev_tld": suffix_flag(host),
        "is_github_io": host.contains(settings.GITHUB_PART).cast("int"),
        "is_neocities": host.contains(settings.NEOCITIES_PART).cast("int"),
    }
    return (
        df.withColumns({"_host": domain(link), "_path": path(link), "_bad": is_invalid(link)})
        .withColumns({name: F.when(bad, 0).otherwise(value) for name, value in values.items()})
        .drop("_host", "_path", "_bad")
    )


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; runs only on paths that hold one."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    folder = F.when(path.rlike(r"(?:^|/)\.\.?$"), "/").otherwise("")
    rooted = F.regexp_replace(F.concat(F.array_join(kept, "/"), folder), "^(?!/)", "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), rooted).otherwise(path)


def with_resolved(df: DataFrame, base: str, hrefs: str, out: str) -> DataFrame:
    """Add ``out``, the distinct absolute forms of the references found on page ``base``.

    A reference with a scheme of its own is kept; one with the page's scheme, or none, is
    completed from the page's scheme, host and folder. Fragments are cut. The references
    stay an array of their page, so nothing is shuffled.
    """
    page = F.col("_page")
    scheme, host, page_path = F.col("_scheme"), F.col("_origin"), F.col("_page_path")
    staged = (
        df.withColumn("_page", F.substring_index(_parsable(F.col(base)), "#", 1))
        .withColumns(
            {
                "_scheme": F.lower(F.regexp_extract(page, rf"^({_SCHEME})", 1)),
                "_page_path": F.regexp_extract(page, _PATH, 1),
            }
        )
        .withColumns(
            {
                "_origin": F.concat(scheme, F.lit("//"), F.regexp_extract(page, _AUTHORITY, 1)),
                "_folder": F.concat(F.lit("/"), F.regexp_extract(page_path, r"^(.*/)", 1)),
                "_links": F.transform(
                    F.col(hrefs), lambda h: F.substring_index(_parsable(h), "#", 1)
                ),
            }
        )
        .withColumn(
            "_links",
            F.transform(
                "_links",
                lambda link: F.struct(
                    link.alias("link"),
                    F.lower(F.regexp_extract(link, rf"^({_SCHEME})", 1)).alias("scheme"),
                ),
            ),
        )
        .withColumn(
            "_links",
            F.transform(
                "_links",
                lambda x: F.struct(
                    x["link"],
                    ((x["scheme"] != "") & (x["scheme"] != scheme)).alias("foreign"),
                    F.regexp_replace(
                        F.when(
                            x["scheme"] == scheme, F.regexp_replace(x["link"], rf"^{_SCHEME}", "")
                        ).otherwise(x["link"]),
                        r"\?$",
                        "",
                    ).alias("rest"),
                ),
            ),
        )
        .withColumn(
            "_links",
            F.transform(
                "_links",
                lambda x: F.struct(
                    x["link"],
                    x["foreign"],
                    x["rest"],
                    F.regexp_extract(x["rest"], r"^(?://)?([^?]*)", 1).alias("path"),
                    F.regexp_extract(x["rest"], r"^[^?]*(\?.*)$", 1).alias("query"),
                ),
            ),
        )
    )

    def absolute(x: Column) -> Column:
        merged = F.regexp_replace(F.concat(F.col("_folder"), x["path"]), "/{2,}", "/")
        return (
            F.when(x["foreign"], x["link"])
            .when(x["rest"].rlike("^//[^/?]"), F.concat(scheme, x["rest"]))
            .when(x["rest"] == "", F.regexp_replace(page, r"\?$", ""))
            .when(x["path"] == "", F.concat(host, page_path, x["query"]))
            .when(x["path"].startswith("/"), F.concat(host, _without_dots(x["path"]), x["query"]))
            .otherwise(F.concat(host, _without_dots(merged), x["query"]))
        )

    return staged.withColumn(out, F.array_distinct(F.transform("_links", absolute))).drop(
        "_page", "_scheme", "_page_path", "_origin", "_folder", "_links"
    )
