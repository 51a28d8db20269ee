"""Scoring on arrival."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from webstrata.plans import scoring


def start(model: PipelineModel, captures: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score the captured pages that are there, store the predictions, stop."""
    return (
        scoring.score_pages(model, captures)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
