"""Counts that tell whether the stored table is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import urls


def distinct_domains(*url_tables: DataFrame) -> DataFrame:
    """Distinct domains of standardized URLs over all tables (column ``url``)."""
    together = url_tables[0].select("url")
    for other in url_tables[1:]:
        together = together.unionByName(other.select("url"))
    standard = urls.standardize(F.col("url"))
    return together.dropna().select(urls.domain(standard).alias("domain")).distinct()


def domain_count(*url_tables: DataFrame) -> DataFrame:
    return distinct_domains(*url_tables).agg(F.count(F.lit(1)).alias("domains"))


def pages_per_domain(pages: DataFrame) -> DataFrame:
    return pages.groupBy(urls.domain(F.col("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("pages")
    )


def page_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("pages"))


def completeness(expected: list[DataFrame], stored: DataFrame) -> DataFrame:
    """Expected and stored domains, stored rows, and whether every expected domain is there."""
    wanted = distinct_domains(*expected)
    present = distinct_domains(stored)
    missing = wanted.join(present, "domain", "left_anti")
    counts = {
        "expected_domains": wanted,
        "stored_domains": present,
        "missing_domains": missing,
        "stored_rows": stored,
    }
    one = stored.sparkSession.range(1).select(
        *[F.lit(t.agg(F.count(F.lit(1))).scalar()).alias(name) for name, t in counts.items()]
    )
    status = F.when(F.col("missing_domains") == 0, "complete").otherwise("incomplete")
    return one.withColumn("status", status)
