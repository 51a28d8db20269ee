"""Which URLs are stored already: a Bloom filter and the URLs in buckets, kept beside every batch.

A batch's filter has segments of 512 bits, a power of two of them, about ``BITS`` bits a URL; a URL sets
``PROBES`` bits of one segment. New URLs meet the filters by segment, at some two bytes for each
stored URL; only those that every bit speaks for are compared with stored URLs, and only with
those of their buckets. Nothing is decided by a filter alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 12
PROBES = 6
SEGMENT = 512
WORDS = [f"w{i}" for i in range(SEGMENT // 64)]
#: Segments whose URLs share a bucket, a power of two.
BUCKET_SEGMENTS = 4096
FILTERS = f"segment long, {', '.join(f'{w} long' for w in WORDS)}, run string, batch long, segments long"
URLS = "url string, run string, batch long, part string"


def _place(url: str) -> Column:
    return F.xxhash64(F.lit(1), url)


def _masks(url: str) -> dict[str, Column]:
    """The bits that a URL sets, by word of its segment."""
    number = F.xxhash64(F.lit(2), url)
    at = [F.shiftrightunsigned(number, 9 * i).bitwiseAND(SEGMENT - 1) for i in range(PROBES)]
    masks = {}
    for i, word in enumerate(WORDS):
        bits = [
            F.when(F.shiftright(a, 6) == i, F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(63).cast("int"))).otherwise(0)
            for a in at
        ]
        masks[word] = reduce(lambda x, y: x.bitwiseOR(y), bits)
    return masks


def _part(segments: Column) -> Column:
    """Name of a URL's bucket in a batch with so many segments."""
    buckets = F.greatest(F.lit(1), segments / BUCKET_SEGMENTS).cast("long")
    return F.concat_ws("-", segments, _place("url").bitwiseAND(buckets - 1))


def write(urls: DataFrame, root: str, run: str, batch: int) -> None:
    """Store filter and buckets of a batch's distinct ``url``, over what a failed attempt left."""
    segments = 1
    while segments * SEGMENT < urls.count() * BITS:
        segments *= 2
    wide = urls.select(_place("url").bitwiseAND(segments - 1).alias("segment"), *[m.alias(w) for w, m in _masks("url").items()])
    rows = wide.groupBy("segment").agg(*[F.bit_or(w).alias(w) for w in WORDS])
    rows.write.mode("overwrite").parquet(f"{root}/filters/run={run}/batch={batch}/segments={segments}")
    parted = urls.select("url", _part(F.lit(segments).cast("long")).alias("part"))
    parted.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/urls/run={run}/batch={batch}")


def folders(spark: SparkSession, root: str) -> set[tuple[str, int]]:
    """(run, batch) of the finished batches below a folder, from its listing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/run=*/batch=*")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    paths = [str(f.getPath()) for f in found or ()]
    return {(p.rsplit("/", 2)[1][4:], int(p.rsplit("=", 1)[1])) for p in paths}


def _of(batches: set[tuple[str, int]]) -> Column:
    """Rows of some batches, as a condition on the folders read."""
    runs: dict[str, list[int]] = {}
    for run, batch in sorted(batches):
        runs.setdefault(run, []).append(batch)
    conditions = [(F.col("run") == r) & F.col("batch").isin(b) for r, b in runs.items()]
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


def maybe(rows: DataFrame, root: str, batches: set[tuple[str, int]]) -> DataFrame:
    """``url, part`` of the rows that all bits of one of the batches' filters speak for."""
    spark = rows.sparkSession
    known = spark.read.schema(FILTERS).option("basePath", f"{root}/filters").parquet(f"{root}/filters").filter(_of(batches))
    sizes = [r[0] for r in known.select("segments").distinct().collect()]  # powers of two, few
    wide = [m.alias(f"m_{w}") for w, m in _masks("url").items()]
    size = F.explode(F.array(*[F.lit(s).cast("long") for s in sizes]))
    asked = rows.select("url", *wide, size.alias("segments"))
    asked = asked.withColumn("segment", _place("url").bitwiseAND(F.col("segments") - 1))
    speaks = reduce(lambda x, y: x & y, [F.col(w).bitwiseAND(F.col(f"m_{w}")) == F.col(f"m_{w}") for w in WORDS])
    return asked.join(known, ["segments", "segment"]).filter(speaks).select("url", _part(F.col("segments")).alias("part")).distinct()


def unseen(rows: DataFrame, out: str, root: str, own: tuple[str, int]) -> DataFrame:
    """The rows whose ``url`` no other batch below ``out`` has stored.

    Batches without an index, as a crash between the two writes leaves them, are read as they are.
    """
    spark = rows.sparkSession
    there = folders(spark, out) - {own}
    indexed = there & folders(spark, f"{root}/filters") & folders(spark, f"{root}/urls")
    if there - indexed:
        plain = spark.read.schema("url string, run string, batch long").parquet(out).filter(_of(there - indexed))
        rows = rows.join(plain.select("url"), "url", "left_anti")
    if not indexed:
        return rows
    asked = maybe(rows, root, indexed).persist()
    try:
        parts = [r[0] for r in asked.select("part").distinct().collect()]
        if not parts:
            return rows
        held = spark.read.schema(URLS).option("basePath", f"{root}/urls").parquet(f"{root}/urls")
        held = held.filter(_of(indexed) & F.col("part").isin(parts))
        stored = asked.select("url", "part").join(held.select("url", "part"), ["url", "part"], "left_semi")
        return rows.join(stored.select("url").distinct(), "url", "left_anti")
    finally:
        asked.unpersist()
