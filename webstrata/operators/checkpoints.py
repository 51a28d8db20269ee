"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where none is set and the session is local, as in tests, a folder is made.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", context.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="webstrata-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """``df`` stored below the checkpoint folder in buckets of ``key``, one a shuffle partition if no
    number is given.

    Joins on the key move only their other side, as often as they run.
    """
    folder = fresh_folder(df.sparkSession, name)
    table = folder.rsplit("/", 1)[1].replace("-", "_")
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", folder).saveAsTable(table)
    return df.sparkSession.table(table)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
