"""Expansion of seeds to at most ``max_links`` same-domain URLs each, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.operators.checkpoints import bucketed, cut
from webstrata.operators.skew import limit_per_key


def shortest_lists(page_links: DataFrame, bound: int) -> DataFrame:
    """Keep the first ``bound`` links of every page, in URL order.

    Nothing is lost: with v URLs of the domain already visited, at most ``bound - v`` new ones
    are taken per level, in URL order. The first ``bound`` links of a page hold at least
    ``bound - v`` unvisited ones, and these come before all its later links.
    """
    first = F.slice(F.sort_array("links"), F.lit(1), F.lit(bound))
    return page_links.select("url", first.alias("links"))


def next_level(
    visited: DataFrame, frontier: DataFrame, page_links: DataFrame, bound: int, depth: int
) -> DataFrame:
    """URLs of the next level: new same-domain links within each domain's remaining quota.

    ``visited`` holds at most ``bound`` rows per domain and a page at most ``bound`` links, so
    no domain is hot here, however many pages it has. Joins run on the URL.
    """
    state = visited.groupBy("domain").agg(
        F.count(F.lit(1)).alias("_used"), F.first("max_links").alias("max_links")
    )
    open_domains = state.filter(F.col("_used") < F.col("max_links")).select(
        "domain", (F.col("max_links") - F.col("_used")).alias("_left")
    )
    found = (
        frontier.join(open_domains, "domain")
        .join(page_links, "url")
        .select("domain", "label", "max_links", "_left", F.explode("links").alias("url"))
        .dropDuplicates(["domain", "url"])
        .join(visited.select("domain", "url"), ["domain", "url"], "left_anti")
    )
    return limit_per_key(found, "domain", ["url"], F.col("_left"), bound, salts=1).select(
        "domain", "url", "label", "max_links", F.lit(depth).alias("depth")
    )


def expand(
    seeds: DataFrame,
    page_links: DataFrame,
    bound: int | None = None,
    max_levels: int | None = None,
) -> DataFrame:
    """URL list ``domain, url, label, max_links, depth`` reached from one seed per domain.

    ``page_links`` has one row per page with its same-domain links. ``bound`` is the largest
    ``max_links`` of a seed; without it, it is taken from the seeds. A page that is not stored is listed but leads nowhere. The driver
    only steps through the levels; every level is checkpointed, and at most ``bound`` levels
    are needed because each one that goes on adds a URL to a domain below its quota.
    """
    columns = ("domain", "url", "label", "max_links")
    levels = [cut(seeds.select(*columns, F.lit(0).alias("depth")).filter(F.col("max_links") > 0))]
    bound = levels[0].agg(F.max("max_links")).first()[0] or 0 if bound is None else bound
    # Stored in buckets of the URL, so that the join of each level moves only the frontier.
    lists = bucketed(shortest_lists(page_links, bound), "url", "page-links")
    for depth in range(1, min(bound, max_levels or bound) + 1):
        visited = reduce(DataFrame.unionByName, levels)
        level = cut(next_level(visited, levels[-1], lists, bound, depth))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)
