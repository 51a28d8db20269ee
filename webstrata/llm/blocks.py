"""Blocks: runs of consecutive documents that one task handles as arrays.

A block holds documents of about ``BLOCK_BYTES`` of text, or one longer document. What documents
of different blocks must learn from each other (how often a shingle occurs, what a word encodes
to) goes through an *exchange*: a block sends each distinct token once, in one packed array for
each bucket of tokens, a bucket's task combines the arrays of all blocks, and answers go back to
the blocks. A token that a third of all documents hold is thus one entry for each block,
and a token costs two to three bytes in the shuffle instead of a row.

Blocks are stored once in a table bucketed by block, so that answers find them without moving
them again. All steps are ordinary Spark jobs; tables are below the shared checkpoint folder.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators.checkpoints import fresh_folder

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20
PART = "struct<bucket:int,blob:binary>"


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, most significant planes apart, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """The same for ascending unsigned values: their differences are packed."""
    return pack(np.diff(values, prepend=values[:1] * 0))


def unpack_sorted(blob: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(blob, kind), dtype=kind)


def bundle(*blobs: bytes) -> bytes:
    """Several byte strings as one."""
    head = np.array([len(blobs), *map(len, blobs)], np.int64).tobytes()
    return head + b"".join(blobs)


def unbundle(blob: bytes) -> list[bytes]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, count, 8)
    ends = np.cumsum(sizes) + 8 * (count + 1)
    return [blob[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(io.BytesIO(blob)).read_all()


def cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Table]]:
    """Number and rows of each block of a partition; ``text`` decides the size."""
    first = TaskContext.get().partitionId() << 32
    held, size, number = [], 0, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, done + limit - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - done
            at = to
            if size >= limit:
                yield first + number, pa.Table.from_batches(held)
                held, size, number = [], 0, number + 1
    if held:
        yield first + number, pa.Table.from_batches(held)


def split_by_bucket(tokens: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Bucket and place of its tokens, for ascending 64-bit tokens."""
    owner = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(owner, prepend=owner[:1] + np.uint64(1)))
    ends = np.append(starts[1:], len(tokens))
    return [
        (int(owner[a]), slice(a, b)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
    ]


def bucket_count(df: DataFrame) -> int:
    """Buckets of tokens, so that one fits a task: a shuffle partition each, or more of them where
    the stored tables that ``df`` reads hold over ``BUCKET_BYTES`` for each."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Frames that are no tables have no size, which Spark gives as the largest number.
    known = sum(size for size in sizes if size < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // BUCKET_BYTES))


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its ``block`` stored in a table bucketed by it."""
    return store_at(df, fresh_folder(df.sparkSession, name))


def store_at(df: DataFrame, folder: str) -> DataFrame:
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, "block").option("path", folder)
    writer.saveAsTable(_table(folder))
    return df.sparkSession.table(_table(folder))


def _table(folder: str) -> str:
    return folder.rsplit("/", 1)[1].replace("-", "_")


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a table that ``store_at`` made once all that came of it is stored elsewhere."""
    spark.sql(f"DROP TABLE IF EXISTS {_table(folder)}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exchange(sent: DataFrame, combine: Callable) -> DataFrame:
    """``block, answers``: what ``combine`` gives for the parts of all blocks.

    ``sent`` has ``block, parts``; ``combine(pandas frame of block, bucket, blob)`` handles one
    bucket and returns a frame of the same columns, answers packed by block.
    """
    parts = sent.select("block", F.explode("parts").alias("p")).select("block", "p.bucket", "p.blob")
    answers = parts.groupBy("bucket").applyInPandas(combine, "block long, bucket int, blob binary")
    return answers.groupBy("block").agg(
        F.collect_list(F.struct("bucket", "blob")).alias("answers")
    )


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored blocks with the answers they got, NULL for none."""
    return blocks.join(answers, "block", "left")


def by_bucket(answers) -> list[tuple[int, bytes]]:
    """A row's answers in order of their bucket."""
    return sorted(((a["bucket"], a["blob"]) for a in answers or ()), key=lambda x: x[0])
