import glob
import json

from pyspark.sql import functions as F

from webstrata.operators import enrich, metrics
from webstrata.operators import boosting
from webstrata.plans import enrichment, scoring, training
from webstrata.showcase import queries
from webstrata.sources import sinks, tables
from webstrata.streaming import ingest, progress
from webstrata.streaming import scoring as stream_scoring

TINY = training.Training(buckets=256, rounds=3, linear_rounds=10, min_leaf_rows=2)


def test_csv_lists(spark, rows, tmp_path):
    (tmp_path / "corporate.csv").write_text("b.com\nhttps://a.com\n\nc.com\n")
    plain = tables.plain_list(spark, str(tmp_path / "corporate.csv")).dropna(subset=["url"]).orderBy("pos")
    assert [r.url for r in plain.collect()] == ["b.com", "https://a.com", "c.com"]
    (tmp_path / "sites.csv").write_text('Rank,Site URL\n1,"https://x.com/a,b"\n2,\n3,https://y.com\n')
    named = tables.personal_sites(spark, str(tmp_path / "sites.csv")).orderBy("pos").collect()
    assert [r.url for r in named] == ["https://x.com/a,b", None, "https://y.com"]
    (tmp_path / "ranked.csv").write_text("Rank,Domain\n1,a.com\n")
    assert tables.ranked_domains(spark, str(tmp_path / "ranked.csv")).first().url == "a.com"
    (tmp_path / "list.csv").write_text('url,label\n"https://x.com/a,b",1\nhttps://y.com,\n')
    assert [tuple(r) for r in tables.url_list(spark, str(tmp_path / "list.csv")).collect()] == [("https://x.com/a,b", 1)]
    sinks.write_url_list(rows("url string, label int", ("https://x.com/a,b", 1)), str(tmp_path / "out"))
    assert [tuple(r) for r in tables.url_list(spark, str(tmp_path / "out")).collect()] == [("https://x.com/a,b", 1)]


def test_chunks_resume_and_compaction(spark, rows, tmp_path):
    parts, out = str(tmp_path / "parts"), str(tmp_path / "out")
    pages = rows("url string, html string", *[(f"u{i}", f"<p>t{i}</p>") for i in range(25)])
    listed = rows("url string, label int", *[(f"u{i}", i % 2) for i in range(30)], ("u1", 1))
    enrichment.run(listed.filter("url < 'u2'"), pages, parts, rows_per_file=4)
    enrichment.run(listed, pages, parts, done=tables.enriched(spark, parts), rows_per_file=4)
    stored = tables.enriched(spark, parts)
    assert sorted(r.url for r in stored.collect()) == sorted(f"u{i}" for i in range(25))
    files = glob.glob(f"{parts}/*.zstd.parquet")
    assert len(files) >= 7
    assert max(tables.enriched(spark, parts).groupBy(F.input_file_name()).count().toPandas()["count"]) <= 4
    sinks.compact(spark, parts, out, files=1)
    assert len(glob.glob(f"{out}/*.zstd.parquet")) == 1
    assert tables.enriched(spark, out).exceptAll(stored).isEmpty()
    assert tables.enriched(spark, out, glob="*.parquet").count() == 25


def test_feature_table_is_reused_until_something_changes(spark, rows, tmp_path):
    source, root, built = str(tmp_path / "in"), str(tmp_path / "features"), []

    def build(df):
        built.append(1)
        return df.select("url")

    sinks.append_pages(rows(tables.ENRICHED, ("u", 1, None, "h")), source)
    first, key = sinks.feature_table(source, root, {"n": 1}, build, spark)
    assert first.count() == 1 and sinks.feature_table(source, root, {"n": 1}, build, spark)[1] == key
    assert len(built) == 1
    assert sinks.feature_table(source, root, {"n": 2}, build, spark)[1] != key
    sinks.feature_table(source, root, {"n": 1}, build, spark, rebuild=True)
    sinks.append_pages(rows(tables.ENRICHED, ("v", 1, None, "h")), source)
    again, other = sinks.feature_table(source, root, {"n": 1}, build, spark)
    assert other != key and again.count() == 2 and len(built) == 4


def main_rows(spark, folder):
    return queries.main_table(spark, folder)


def test_features_model_report_and_scoring(spark, folder, tmp_path):
    rows = main_rows(spark, folder)
    features = training.feature_rows(rows, TINY)
    assert training.widths(features) == {"text": 256, "url": 6, "structural": 6, "content": 3}
    path = str(tmp_path / "features")
    features.write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.first().features.size == 271
    train, test = training.split_parts(stored, "url", TINY)
    fitted = training.fit_boosted(train, TINY, classes=2)
    model = training.whole_model(TINY, fitted)
    training.save(model, str(tmp_path / "model"))
    loaded = training.load(str(tmp_path / "model"))
    direct = {r.url: r.probability for r in training.predictions(fitted.transform(stored), "url").collect()}
    pages = queries.pages(spark, folder)
    scored = scoring.score_pages(loaded, pages)
    got = {r.url: r.probability for r in scored.collect()}
    assert got.keys() == direct.keys() and all(abs(got[u] - direct[u]) < 1e-9 for u in got)
    shown = scoring.for_display(scored).first()
    assert shown.prediction in ("Personal Blog", "Corporate Seo") and shown.confidence.endswith("%")

    report = training.report(fitted.transform(test))
    sinks.write_report(training.manifest(report, TINY), str(tmp_path / "manifest"))
    manifest = json.loads(open(glob.glob(f"{tmp_path}/manifest/*.json")[0]).read())
    assert manifest["params"]["rounds"] == "3"
    assert {m["name"] for m in manifest["evaluation_metrics"]} >= {"accuracy", "macro avg"}
    sinks.write_report(report, str(tmp_path / "report"), "csv")

    out = str(tmp_path / "scored")
    stream = spark.readStream.schema(pages.schema).option("pathGlobFilter", "pages.parquet").parquet(folder)
    stream_scoring.start(loaded, stream, out, str(tmp_path / "state")).awaitTermination()
    streamed = {r.url: r.prediction for r in spark.read.parquet(out).collect()}
    assert streamed == {r.url: r.prediction for r in scored.collect()}


def test_url_only_model_separates_the_labels(spark, folder):
    rows = queries.with_label(queries.pages(spark, "/root/testdata/sf0.01").select("url")).drop("domain")
    train, test = training.split_parts(rows, "url", TINY)
    model, names = training.fit_url_only(train, TINY)
    pairs = training.predictions(model.transform(test), "label")
    accuracy = {r.name: r for r in metrics.classification_report(pairs, "label", "prediction").collect()}["accuracy"].f1
    assert accuracy > 0.9
    terms = training.informative_terms(spark, model, names).collect()
    assert any("blog" in r.term for r in terms if r["class"] == 1) and len(terms) == 40
    vector = model.transform(test).first().tfidf
    assert abs(vector.norm(2) - 1) < 1e-9


def test_load_refuses_other_models(spark, tmp_path):
    import pytest
    from pyspark.ml import PipelineModel

    training.save(PipelineModel(stages=[training.CharNgrams()]), str(tmp_path / "m"))
    with pytest.raises(ValueError):
        training.load(str(tmp_path / "m"))


def test_ingest_restarts_where_it_stopped(spark, rows, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        ingest.start(ingest.page_stream(spark, source, files=1), out, state).awaitTermination()
        return sorted((r.url, r.html_content) for r in ingest.stored(spark, out).collect())

    def add(*captures):
        rows(ingest.CAPTURES, *captures).write.mode("append").parquet(source)

    add(("a", 1, "<p>1</p>"), ("a", 1, "<p>1</p>"), ("b", 0, None))
    assert run() == [("a", "<p>1</p>")]
    assert run() == [("a", "<p>1</p>")]
    add(("a", 1, "<p>2</p>"), ("b", 0, "<i>2</i>"))
    add(("c", 0, "<p>3</p>"))
    assert run() == [("a", "<p>1</p>"), ("b", "<i>2</i>"), ("c", "<p>3</p>")]


def test_a_replayed_batch_stores_nothing_twice(spark, rows, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows(ingest.CAPTURES, ("a", 1, "<p>1</p>")).write.parquet(source)
    for state in ("state-1", "state-2"):  # the second start knows nothing of the first
        ingest.start(ingest.page_stream(spark, source), out, str(tmp_path / state)).awaitTermination()
    assert [r.url for r in ingest.stored(spark, out).collect()] == ["a"]


def test_a_new_checkpoint_keeps_what_is_stored(spark, rows, tmp_path):
    out = str(tmp_path / "out")
    for turn, urls in enumerate((("a", "z"), ("b", "a"))):
        source = str(tmp_path / f"in-{turn}")
        rows(ingest.CAPTURES, *[(u, 1, f"<p>{turn}</p>") for u in urls]).write.parquet(source)
        ingest.start(ingest.page_stream(spark, source), out, str(tmp_path / f"state-{turn}")).awaitTermination()
    found = sorted((r.url, r.html_content) for r in ingest.stored(spark, out).collect())
    assert found == [("a", "<p>0</p>"), ("b", "<p>1</p>"), ("z", "<p>0</p>")]


def test_rates_as_stream_equal_the_table(spark, folder):
    table = queries.events(spark, folder)
    whole = {r.start: r.n for r in progress.rate(table).collect()}
    streamed = {r.start: r.n for r in queries.rate_30s_stream(spark, folder).collect()}
    assert streamed == {str(k): n for k, n in whole.items()}




def test_training_run(spark, folder, tmp_path):
    source, features, out = (str(tmp_path / n) for n in ("main", "features", "out"))
    sinks.append_pages(main_rows(spark, folder), source)
    report = training.run(spark, source, features, out, TINY)
    assert {r.name for r in report.collect()} >= {"0", "1", "accuracy", "macro avg", "weighted avg"}
    training.load(f"{out}/model")
    assert spark.read.json(f"{out}/confusion").count() == 2
    assert spark.read.json(f"{out}/labels").agg(F.sum("n")).first()[0] == 50
    assert spark.read.json(f"{out}/manifest").first().run_id


def test_early_stopping_has_patience():
    assert boosting.best_round([3, 2, 2.5, 1, 1.5, 1.2], 2) == 4
    assert boosting.best_round([3, 2, 2.5, 2.4, 1], 2) == 2
    assert boosting.best_round([1.0], 50) == 1


def test_captures_of_a_url_are_folded(spark, rows, tmp_path):
    captures = rows(
        "url string, html string, status int, content_type string, at int",
        ("a", "<p>late</p>", 200, "text/html", 2), ("a", "<p>early</p>", 200, "text/html", 1),
        ("a", "<p>error</p>", 500, "text/html", 0), ("b", "x", 200, "image/png", 1),
    )
    listed = rows("url string, label int", ("a", 1), ("b", 1))
    enrichment.run(listed, captures, str(tmp_path / "out"), served=True, order="at")
    assert [r.html_content for r in tables.enriched(spark, str(tmp_path / "out")).collect()] == ["<p>early</p>"]


def test_bucketed_pages_are_not_shuffled(spark, rows, tmp_path):
    pages = rows("url string, html string", *[(f"u{i}", "<p>x</p>") for i in range(50)])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored LOCATION '{tmp_path}/stored'")
    sinks.bucket_pages(pages, "stored.pages", 4)
    listed = rows("url string, label int", *[(f"u{i}", 1) for i in range(60)])
    joined = enrich.fetched(listed.hint("merge"), tables.bucketed_pages(spark, "stored.pages"), "inner")
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(url") <= 2  # initial and final form of the list side
    scan = plan[plan.index("FileScan parquet spark_catalog.stored.pages"):]
    assert "Bucketed: true" in scan
    spark.sql("DROP DATABASE stored CASCADE")
