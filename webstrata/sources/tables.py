"""Reading seed lists, URL lists, captured pages and the main table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.blocks import BLOCKS

PAGES = "page_id long, url string, html string"
URL_LIST = "url string, label int"
ENRICHED = f"url string, label int, structured_text {BLOCKS}, html_content string"


def _with_position(lines: DataFrame) -> DataFrame:
    """Add ``pos``, which grows with (file, block of the file, line within the block)."""
    place = F.struct(
        "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()
    )
    return lines.select("url", place.alias("pos"))


def plain_list(spark: SparkSession, path: str) -> DataFrame:
    """``url, pos`` of a CSV without header, first column."""
    return _with_position(spark.read.schema("url string").option("header", False).csv(path))


def named_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``url, pos`` of one named column of a CSV with header."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return _with_position(rows.withColumn("url", F.col(f"`{column}`")))


def ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    return named_list(spark, path, "Domain")


def personal_sites(spark: SparkSession, path: str) -> DataFrame:
    return named_list(spark, path, "Site URL")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """``url, label`` of a URL list; rows with a missing value go, a label that is no integer fails."""
    reader = spark.read.schema(URL_LIST).option("header", True).option("mode", "FAILFAST")
    return reader.csv(path).dropna("any")


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bucketed_pages(spark: SparkSession, name: str) -> DataFrame:
    """Pages stored by ``sinks.bucket_pages``: a join on the URL moves only its other side."""
    return spark.read.table(name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hand a table of few splits to all cores before work that costs far more than moving it.

    A table with at least as many splits as cores, as any large one has, is left as it is:
    no shuffle. ``key`` is close to unique.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def enriched(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The main table with its fixed schema; ``glob`` selects files by name."""
    reader = spark.read.schema(ENRICHED)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def snapshot_key(spark: SparkSession, path: str) -> str:
    """Identity of the files below ``path``: changes when one is added, removed or rewritten.

    One row per file, without its content; combined in Spark and in any order.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    )
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x")).first()
    return f"{row['n']}-{row['x'] or 0:x}"
