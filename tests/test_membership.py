"""Filters of stored URLs: none is missed, few are asked for in vain, new ones read no stored URL."""

from pyspark.sql import functions as F

from webstrata.operators import membership
from webstrata.streaming import ingest


def urls(spark, first, count):
    return spark.range(first, first + count).select(F.concat(F.lit("http://h/"), "id").alias("url"))


def store(spark, out, run, batch, rows, index=True):
    rows.withColumn("label", F.lit(1)).write.parquet(f"{out}/run={run}/batch={batch}")
    if index:
        membership.write(rows, ingest.index_of(out), run, batch)


def test_filters_miss_nothing_and_rarely_ask_in_vain(spark, tmp_path):
    out = str(tmp_path / "out")
    store(spark, out, "a", 0, urls(spark, 0, 20_000))
    store(spark, out, "a", 1, urls(spark, 20_000, 300))
    root, batches = ingest.index_of(out), {("a", 0), ("a", 1)}
    assert membership.folders(spark, out) == membership.folders(spark, f"{root}/filters") == batches
    asked = membership.maybe(urls(spark, 0, 20_300), root, batches).select("url").distinct()
    assert asked.count() == 20_300
    assert membership.maybe(urls(spark, 50_000, 20_000), root, batches).count() < 400
    assert membership.maybe(urls(spark, 0, 20_300), root, {("a", 1)}).filter("url < 'http://h/2'").count() < 400


def test_unseen_is_exact(spark, tmp_path):
    out = str(tmp_path / "out")
    assert membership.unseen(urls(spark, 0, 5), out, ingest.index_of(out), ("a", 0)).count() == 5
    store(spark, out, "a", 0, urls(spark, 0, 3000))
    store(spark, out, "b", 0, urls(spark, 3000, 50))
    store(spark, out, "b", 1, urls(spark, 3050, 50), index=False)  # a crash before the index
    store(spark, out, "c", 7, urls(spark, 3100, 0))
    found = membership.unseen(urls(spark, 0, 9000), out, ingest.index_of(out), ("x", 0))
    assert found.exceptAll(urls(spark, 3100, 5900)).isEmpty() and found.count() == 5900
    own = membership.unseen(urls(spark, 0, 9000), out, ingest.index_of(out), ("b", 0))
    assert own.exceptAll(urls(spark, 3000, 50).union(urls(spark, 3100, 5900))).isEmpty() and own.count() == 5950


def test_new_urls_read_no_stored_url(spark, tmp_path):
    out = str(tmp_path / "out")
    store(spark, out, "a", 0, urls(spark, 0, 3000))
    new = spark.createDataFrame([("http://new/1",), ("http://new/2",)], "url string")
    found = membership.unseen(new, out, ingest.index_of(out), ("x", 0))
    assert found.count() == 2 and found.inputFiles() == []
    seen = membership.unseen(urls(spark, 5, 1), out, ingest.index_of(out), ("x", 0))
    assert seen.count() == 0 and all("-index/urls/" in f for f in seen.inputFiles() if "/urls/" in f or "/out/" in f)
