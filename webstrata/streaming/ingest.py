"""Resumable enrichment: new captured pages as a stream, each URL stored once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webstrata.operators import enrich, membership
from webstrata.sources import sinks, tables

CAPTURES = "url string, label int, html string"


def page_stream(
    spark: SparkSession, path: str, schema: str = CAPTURES, files: int | None = None, glob: str | None = None
) -> DataFrame:
    """Captured pages as they arrive below ``path``; ``files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stored(spark: SparkSession, out: str) -> DataFrame:
    """All stored rows with the ``run`` and ``batch`` that stored them."""
    schema = f"{tables.ENRICHED}, run string, batch long"
    if not _exists(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def index_of(out: str) -> str:
    """Folder of the filters and URL buckets of the batches stored below ``out``."""
    return f"{out.rstrip('/')}-index"


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of the runs that share a checkpoint; kept inside it, so a new one has a new name."""
    path = f"{checkpoint}/run-id"
    if not _exists(spark, path):
        name = spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1)
        name.write.mode("overwrite").text(path)
    return spark.read.text(path).first()["value"]


def start(
    captures: DataFrame,
    out: str,
    checkpoint: str,
    rows_per_file: int | None = None,
) -> StreamingQuery:
    """Process what is there and stop; a later start goes on from the checkpoint.

    Batch n is written to ``run=<checkpoint's name>/batch=n``, overwriting what a failed attempt
    may have left, so a replayed batch stores nothing twice. URLs of all other stored batches, of
    whatever run, are skipped: with a new or lost checkpoint the work resumes from the output
    itself. Filters beside the output (``index_of``) tell which URLs may be stored, and only those are
    compared with stored URLs. Failed captures are not stored and may come again.
    """
    run = run_id(captures.sparkSession, checkpoint)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        one = F.min_by(F.struct("label", "html"), F.md5("html"))
        rows = batch.filter(F.col("html").isNotNull()).groupBy("url").agg(one.alias("c"))
        rows = rows.select("url", "c.*")
        rows = membership.unseen(rows, out, index_of(out), (run, number))
        kept = enrich.usable(enrich.enrich(rows))
        folder = f"{out}/run={run}/batch={number}"
        sinks.append_pages(kept, folder, rows_per_file, mode="overwrite")
        written = spark.read.schema("url string").parquet(folder)
        membership.write(written, index_of(out), run, number)

    return (
        captures.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
