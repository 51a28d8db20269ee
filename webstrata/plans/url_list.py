"""Steps 0 and 1: seed lists to URL list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata import settings
from webstrata.functions import urls
from webstrata.operators import enrich, frontier, links, seeds


def standard_list(lines: DataFrame) -> DataFrame:
    return lines.dropna(subset=["url"]).withColumn("url", urls.standardize(F.col("url")))


def seed_table(
    corporate: DataFrame, personal: DataFrame, live: DataFrame | None = None, debug: bool = False
) -> DataFrame:
    """``domain, url, label, max_links`` from two lists ``url, pos``."""
    lists = []
    for source, (lines, name) in enumerate(
        ((corporate, "corporate_seo"), (personal, "personal_blog"))
    ):
        head = seeds.first_rows(lines) if debug else lines
        rows = seeds.seed_rows(head, source, settings.LABEL_IDS[name])
        lists.append(rows if live is None else seeds.live_seeds(rows, live))
    return seeds.seed_per_domain(*lists)


def url_list(
    seed_rows: DataFrame, pages: DataFrame, bound: int | None = None, served: bool = False
) -> DataFrame:
    """``url, label`` and level of every URL reached from the seeds over stored pages.

    With ``served`` the pages carry ``status`` and ``content_type``, and only those that
    answered with HTML lead on.
    """
    source = enrich.served_as_html(pages) if served else pages
    edges = links.same_domain_page_links(source)
    return frontier.expand(seed_rows, edges, bound)
