"""Enrichment: from a URL list and stored pages to the main table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import blocks
from webstrata.operators.seeds import is_live
from webstrata.operators.skew import join_spread

USABLE = ("success", "success_empty")


def label_by_domain(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages (with ``domain, url``) get the label of their domain's seed.

    A domain may hold a large share of all pages, so hot domains are spread.
    """
    return join_spread(pages, seeds.select("domain", "label"), "domain", ["url"])


def one_label(url_list: DataFrame) -> DataFrame:
    """``url, label``: each URL once, with the least label it is listed with."""
    return url_list.groupBy("url").agg(F.min("label").alias("label"))


def to_do(url_list: DataFrame, done: DataFrame) -> DataFrame:
    """URLs without a stored result."""
    return one_label(url_list).join(done.select("url"), "url", "left_anti")


def served_as_html(pages: DataFrame) -> DataFrame:
    """Captured pages that answered below 400 with an HTML content type."""
    return pages.filter(is_live(F.col("status")) & F.col("content_type").contains("text/html"))


def fetched(url_list: DataFrame, pages: DataFrame, how: str = "left") -> DataFrame:
    """``url, label, html``: the stored HTML of every listed URL, NULL where there is none.

    ``pages`` has one row per URL (see ``one_capture``), or its copies are listed each. With ``inner`` URLs without a page,
    which are not stored anyway, are left out, and Spark may filter pages before the shuffle.
    """
    return url_list.join(pages.select("url", "html"), "url", how)


def one_capture(pages: DataFrame, order: str) -> DataFrame:
    """One capture per URL, the first by ``order``; many copies of a URL are folded map-side."""
    first = F.min_by(F.col("html"), F.col(order))
    return pages.groupBy("url").agg(first.alias("html"))


def fetch_status(html: Column, blocks: Column) -> Column:
    return (
        F.when(html.isNull(), "failed").when(F.size(blocks) > 0, "success").otherwise("success_empty")
    )


def enrich(fetched: DataFrame) -> DataFrame:
    """``url, label, structured_text, html_content, status`` of ``url, label, html`` rows.

    The only place where pages are parsed; later jobs read the stored blocks.
    """
    parsed = fetched.withColumn("structured_text", blocks.text_blocks(F.col("html")))
    return parsed.select(
        "url",
        F.col("label").cast("int").alias("label"),
        "structured_text",
        F.col("html").alias("html_content"),
        fetch_status(F.col("html"), F.col("structured_text")).alias("status"),
    )


def usable(enriched: DataFrame) -> DataFrame:
    """Rows to store: failed ones go, so that the next run tries them again."""
    return enriched.filter(F.col("status").isin(*USABLE)).drop("status")


def run_stats(status: DataFrame, listed: DataFrame, skipped: DataFrame) -> DataFrame:
    """``success, failed`` of the URLs tried so far, ``total`` URLs to do in this run, those ``skipped``
    by it, and ``percent_done``: the share of the list that was tried."""
    ok = F.col("status").isin(*USABLE)
    counts = status.agg(
        F.count_if(ok).alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    done = F.col("success") + F.col("failed")
    total = F.lit(listed.agg(F.count(F.lit(1))).scalar())
    return counts.withColumn("total", total).select(
        "*",
        F.lit(skipped.agg(F.count(F.lit(1))).scalar()).alias("skipped"),
        F.when(F.col("total") > 0, done / F.col("total") * 100).otherwise(0.0).alias("percent_done"),
    )
