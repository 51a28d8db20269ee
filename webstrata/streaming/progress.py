"""Progress per interval: how many rows came in and at which rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webstrata import settings


def rate(events: DataFrame, ts: str = "ts", seconds: int = settings.PROGRESS_SECONDS) -> DataFrame:
    """``start, n, rate`` per interval, on a table or, with a watermark, on a stream."""
    return (
        events.groupBy(F.window(ts, f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))
    )


def start_rates(events: DataFrame, out: str, checkpoint: str, delay: str = "1 minute") -> StreamingQuery:
    """Store the intervals of a stream as they change; ``stored_rates`` has the last state of each.

    An open interval is stored with what has come so far, so the newest ones are never missing;
    state is kept only until the watermark has passed an interval.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        rate_stream(events, delay)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def stored_rates(spark: SparkSession, out: str) -> DataFrame:
    """``start, n, rate``: what the latest batch says of each interval."""
    found = spark.read.schema("start timestamp, n long, rate double, batch long").parquet(out)
    latest = found.groupBy("start").agg(F.max(F.struct("batch", "n", "rate")).alias("last"))
    return latest.select("start", "last.n", "last.rate")


def rate_stream(
    events: DataFrame, delay: str = "1 minute", ts: str = "ts", seconds: int = settings.PROGRESS_SECONDS
) -> DataFrame:
    """The same over a stream; an interval is final once the watermark has passed it."""
    return rate(events.withWatermark(ts, delay), ts, seconds)
