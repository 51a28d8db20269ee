"""Seed lists: one seed per domain, corporate list first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata import settings
from webstrata.functions import text, urls


def seed_rows(urls_in_order: DataFrame, source: int, label: int) -> DataFrame:
    """Rows ``url, pos, source, label, max_links`` of one list (columns ``url, pos``).

    NULLs go; of equal entries the first stays; blanks around an entry are removed.
    """
    return (
        urls_in_order.dropna(subset=["url"])
        .groupBy("url")
        .agg(F.min("pos").alias("pos"))
        .withColumns(
            {
                "url": text.strip(F.col("url")),
                "source": F.lit(source),
                "label": F.lit(label),
                "max_links": F.lit(settings.MAX_LINKS),
            }
        )
    )


def first_rows(df: DataFrame, limit: int = settings.DEBUG_SEEDS) -> DataFrame:
    """Head of a list in file order (debug runs)."""
    return df.orderBy("pos").limit(limit)


def live_seeds(seeds: DataFrame, live: DataFrame) -> DataFrame:
    """Seeds whose URL answers: a semi join with the table of live URLs."""
    return seeds.join(live.select("url"), "url", "left_semi")


def is_live(status: Column) -> Column:
    return status < 400


def seed_per_domain(*lists: DataFrame) -> DataFrame:
    """One seed per domain: first by (list, position); seeds without a domain are dropped.

    ``min_by`` aggregates on the map side, so a domain with very many seeds is no hot spot.
    """
    together = lists[0]
    for other in lists[1:]:
        together = together.unionByName(other)
    first = F.min_by(F.struct("url", "label", "max_links"), F.struct("source", "pos"))
    return (
        together.withColumn("domain", urls.domain(F.col("url")))
        .filter(F.col("domain") != "")
        .groupBy("domain")
        .agg(first.alias("seed"))
        .select("domain", "seed.*")
    )


def planned_pages(seeds: DataFrame) -> DataFrame:
    return seeds.agg(
        F.count(F.lit(1)).alias("seeds"), F.sum("max_links").cast("bigint").alias("planned_pages")
    )
