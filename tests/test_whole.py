"""Every step after the other, from seed files to scores, over the smallest pages."""

from dataclasses import replace

from pyspark.sql import functions as F

from webstrata.functions import urls
from webstrata.plans import enrichment, scoring, training, url_list
from webstrata.sources import sinks, tables
from webstrata.operators import quality
from webstrata.showcase import queries

CONFIG = training.Training(buckets=256, rounds=3, min_leaf_rows=1)


def test_seed_files_to_scores(spark, folder, tmp_path):
    path = {n: str(tmp_path / n) for n in ("corporate", "personal", "urls", "enriched", "features", "out")}
    pages = tables.pages(spark, f"{folder}/pages.parquet")
    blog = urls.domain(F.col("url")).startswith("blog.")
    # Corporate seeds come without a scheme, as in the raw list.
    bare = pages.filter(~blog & F.col("url").startswith("https://")).select(
        F.regexp_replace("url", "^https://", "").alias("url")
    )
    sinks.write_plain_list(bare, path["corporate"])
    pages.filter(blog).select(F.col("url").alias("Site URL")).write.option("header", True).csv(path["personal"])

    corporate = url_list.standard_list(tables.plain_list(spark, path["corporate"]))
    personal = tables.personal_sites(spark, path["personal"])
    seeds = url_list.seed_table(corporate, personal)
    expanded = url_list.url_list(seeds, pages)
    sinks.write_url_list(expanded, path["urls"])
    listed = tables.url_list(spark, path["urls"])
    per_domain = listed.groupBy(urls.domain(F.col("url"))).count()
    assert per_domain.agg(F.max("count")).first()[0] <= 25
    assert listed.count() > seeds.count()

    enrichment.run(listed, pages, path["enriched"])
    stored = tables.enriched(spark, path["enriched"])
    assert stored.count() >= seeds.count()
    assert quality.completeness([corporate, personal], stored).first().status == "complete"

    training.run(spark, path["enriched"], path["features"], path["out"], CONFIG)
    model = training.load(f"{path['out']}/model")
    scored = scoring.score_enriched(model, stored, "url", "label")
    assert scored.count() == stored.count()
    assert scored.filter(~F.col("confidence").between(0.5, 1.0)).isEmpty()


def test_quota_on_the_largest_domain(spark):
    source = "/root/testdata/sf0.1"
    counts = queries.quota_pages(spark, source).groupBy("domain").count()
    assert counts.agg(F.max("count")).first()[0] == 25
    whole = queries.pages_per_domain(spark, source)
    clipped = whole.select("domain", F.least("pages", F.lit(25)).alias("count"))
    assert clipped.exceptAll(counts).isEmpty() and counts.exceptAll(clipped).isEmpty()


def test_registered_models_do_the_whole_job(spark, folder, monkeypatch):
    """Every model query trains with the defaults, but for the leaf rows of the small label tables."""
    default, used = training.Training(), []
    monkeypatch.setattr(training, "split_parts", lambda rows, key, config: (rows, rows))
    for name in ("fit_trees", "fit_linear", "fit_content_only", "fit_url_only"):
        monkeypatch.setattr(training, name, lambda *given, **_: (used.append(given[1]), ([], []))[1])
    monkeypatch.setattr(training, "fit_boosted", lambda rows, config, classes: used.append(config))
    monkeypatch.setattr(training, "report", lambda *_, **__: used)
    for name in ("boosted_report", "linear_report", "multiclass_report", "content_only_report", "url_only_report"):
        try:
            getattr(queries, name)(spark, folder)
        except AttributeError:  # the stand-ins have no transform()
            pass
    assert len(used) == 5
    assert [replace(config, min_leaf_rows=default.min_leaf_rows) for config in used] == [default] * 5
    assert queries.feature_table(spark, folder).first()["width"] == 65_536 + 15
