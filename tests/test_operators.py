import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from webstrata.operators import (
    checkpoints, enrich, frontier, links, metrics, quality, seeds, skew, split,
)
from webstrata.plans import url_list


def lines(rows, *values):
    return rows("url string, pos int", *[(v, i) for i, v in enumerate(values)])


def test_first_seed_of_a_domain_wins(rows):
    corporate = lines(rows, " https://b.com/x ", "https://www.a.com", None, "httpbin.org", "https://a.com/2")
    personal = lines(rows, "https://a.com", "https://c.com", "https://c.com")
    found = url_list.seed_table(corporate, personal).collect()
    assert sorted(tuple(r) for r in found) == [
        ("a.com", "https://www.a.com", 0, 25),
        ("b.com", "https://b.com/x", 0, 25),
        ("c.com", "https://c.com", 1, 25),
    ]
    standard = url_list.standard_list(lines(rows, "example.org", "httpbin.org", None)).collect()
    assert [r.url for r in standard] == ["https://example.org", "httpbin.org"]


def test_live_and_debug_seeds(rows):
    corporate = lines(rows, *[f"https://s{i}.com" for i in range(30)])
    personal = lines(rows, "https://p.com")
    status = rows("url string, status int", ("https://s1.com", 200), ("https://p.com", 404), ("https://s29.com", 399))
    live = status.filter(seeds.is_live(F.col("status")))
    assert {r.domain for r in url_list.seed_table(corporate, personal, live).collect()} == {"s1.com", "s29.com"}
    assert url_list.seed_table(corporate, personal, debug=True).count() == 21
    planned = seeds.planned_pages(url_list.seed_table(corporate, personal)).first()
    assert (planned.seeds, planned.planned_pages) == (31, 775)


def test_links_of_a_page(rows):
    page = (
        '<a href="/x#top"><a href="q"><a href="../r"><a href="?s=1"><a href="//a.com/y"><a href="https://b.com/">'
        '<a href="#c"><a href="javascript:void(0)"><a href="/x">'
    )
    pages = rows("url string, html string", ("https://www.a.com/d/p.html", page), ("https://b.com", None))
    same = {r.dst_url for r in links.same_domain_links(pages).collect()}
    assert same == {
        "https://www.a.com/x", "https://www.a.com/d/q", "https://www.a.com/r",
        "https://www.a.com/d/p.html?s=1", "https://a.com/y",
    }
    every = [r.dst_url for r in links.links(pages).collect()]
    assert len(every) == len(set(every)) == 7


def brute_force_expansion(seed_rows, out_links):
    visited, frontier_ = {d: [u] for d, u, _ in seed_rows}, {d: [u] for d, u, _ in seed_rows}
    quota = {d: m for d, _, m in seed_rows}
    depth, at = {u: 0 for _, u, _ in seed_rows}, 0
    while any(frontier_.values()):
        at += 1
        for d in frontier_:
            room = quota[d] - len(visited[d])
            new = {t for u in frontier_[d] for t in out_links.get(u, ())} - set(visited[d])
            frontier_[d] = sorted(new)[:room]
            visited[d] += frontier_[d]
            depth.update(dict.fromkeys(frontier_[d], at))
    return depth


def test_expansion_against_brute_force(rows):
    def url(d, k):
        return f"https://{d}.com/{k:03d}"

    out_links = {}
    for d, n in (("hot", 400), ("deep", 60), ("lone", 1)):
        for k in range(n):
            steps = (7, 11, 50, 90) if d == "hot" else (1,)
            out_links[url(d, k)] = [url(d, (k * 3 + s) % (n + 5)) if d == "hot" else url(d, k + s) for s in steps]
    out_links[url("wide", 0)] = [url("wide", k) for k in range(1, 41)]
    seed_rows = [(f"{d}.com", url(d, 0), m) for d, m in (("hot", 25), ("deep", 25), ("lone", 25), ("wide", 25))]
    seed_rows.append(("dead.com", "https://dead.com/", 1))
    seeds_df = rows("domain string, url string, label int, max_links int", *[(d, u, 1, m) for d, u, m in seed_rows])
    edges = rows("url string, links array<string>", *out_links.items())
    found = frontier.expand(seeds_df, edges).collect()
    assert {r.url: r.depth for r in found} == brute_force_expansion(seed_rows, out_links)
    counts = Counter(r.domain for r in found)
    assert len(found) == len({r.url for r in found}) and max(counts.values()) == 25
    assert (counts["wide.com"], counts["deep.com"], counts["dead.com"]) == (25, 25, 1)


def test_limit_per_key_with_a_hot_key(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string"))
    df = spark.range(5000).select(key.alias("k"), "id")
    got = defaultdict(list)
    limited = skew.limit_per_key(df, "k", ["id"], 7, 7)
    assert limited._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4
    for r in limited.collect():
        got[r.k].append(r.id)
    expected = defaultdict(list)
    for r in df.orderBy("id").collect():
        expected[r.k].append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[:7] for k, v in expected.items()}


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_join_spread_equals_a_plain_join(spark, how):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 200)
    df = spark.range(3000).select(key.alias("k"), "id")
    lookup = spark.range(0, 150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = sorted(map(str, skew.join_spread(df, lookup, "k", ["id"], how).collect()))
    assert got == sorted(map(str, df.join(lookup, "k", how).collect()))
    assert [r.k for r in skew.hot_keys(df, "k", 10).collect() if r.k is not None] == [0]


def test_enrichment(rows):
    pages = rows(
        "url string, html string, status int, content_type string",
        ("a", "<p>x</p>", 200, "text/html; charset=utf-8"), ("b", "<div>x</div>", 200, "text/html"),
        ("c", "%PDF", 200, "application/pdf"), ("d", "<p>x</p>", 500, "text/html"),
    )
    listed = rows("url string, label int", *[(u, 1) for u in "aabcde"])
    todo = enrich.to_do(listed, rows("url string", ("e",)))
    rows_ = enrich.enrich(enrich.fetched(todo, enrich.served_as_html(pages)))
    assert {r.url: r.status for r in rows_.collect()} == {
        "a": "success", "b": "success_empty", "c": "failed", "d": "failed",
    }
    kept = enrich.usable(rows_).collect()
    assert [tuple(t) for t in {r.url: r for r in kept}["a"].structured_text] == [("p", "x")]
    assert {r.url: r for r in kept}["b"].structured_text is None
    skipped = listed.filter("url = 'e'")
    assert tuple(enrich.run_stats(rows_.select("status"), todo, skipped).first()) == (2, 2, 4, 1, 100.0)
    half = rows_.filter("url in ('a', 'c')").select("status")
    assert tuple(enrich.run_stats(half, todo, skipped).first()) == (1, 1, 4, 1, 50.0)
    assert tuple(enrich.run_stats(half.limit(0), todo.limit(0), skipped).first()) == (0, 0, 0, 1, 0.0)
    copies = rows("url string, html string, n int", ("a", "2", 2), ("a", "1", 1), ("b", "3", 9))
    assert {tuple(r) for r in enrich.one_capture(copies, "n").collect()} == {("a", "1"), ("b", "3")}


def test_split_by_hash(spark):
    df = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    parts = split.with_parts(df, "url").groupBy("part").count().collect()
    counts = {r.part: r["count"] for r in parts}
    assert sum(counts.values()) == 2000 and 330 < counts["test"] < 470
    test = {r.url for r in df.filter(split.is_test(F.col("url"))).collect()}
    assert test == {u for u in (f"u{i}" for i in range(2000)) if int(hashlib.md5(u.encode()).hexdigest()[:8], 16) / 2**32 < 0.2}


@pytest.mark.parametrize("bits", [4, 16])
def test_split_stratified(spark, bits):
    df = spark.range(997).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 10).cast("int").alias("label"))
    df = df.withColumn("label", F.when(F.col("label") < 8, 0).otherwise(F.col("label")))
    got = split.stratified(df, "url", "label", bits=bits).collect()
    everyone = defaultdict(list)
    for r in df.collect():
        everyone[r.label].append(r.url)
    assert len(got) == 997
    for label, urls_ in everyone.items():
        ranked = sorted(urls_, key=lambda u: hashlib.md5(u.encode()).hexdigest())
        chosen = {r.url for r in got if r.label == label and r.is_test}
        assert chosen == set(ranked[: int(len(urls_) * 0.2 + 0.5)])


def test_split_stratified_keeps_copies_together(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 400))
    df = spark.range(1200).select(key.alias("url"), F.lit(1).alias("label"), "id")
    got = split.stratified(df, "url", "label", share=0.5, bits=4).collect()
    assert len({r.id for r in got}) == 1200
    sides = defaultdict(set)
    for r in got:
        sides[r.url].add(r.is_test)
    assert all(len(s) == 1 for s in sides.values())
    assert 600 - 400 < sum(r.is_test for r in got) <= 600


def test_class_guard(rows):
    with pytest.raises(ValueError):
        split.require_classes(rows("label int", (1,), (1,)))
    assert split.require_classes(rows("label int", (1,), (0,), (2,))) == 3


def test_reports(rows):
    pairs = rows("y int, p int", (0, 0), (0, 0), (0, 1), (1, 1))
    got = {r.name: r for r in metrics.classification_report(pairs, "y", "p").collect()}
    close = lambda row, *v: all(abs(a - b) < 1e-12 for a, b in zip(row[1:4], v))
    assert close(got["0"], 1, 2 / 3, 0.8) and close(got["1"], 0.5, 1, 2 / 3)
    assert got["accuracy"].precision == 0.75 and got["accuracy"].support == 4
    assert abs(got["macro avg"].f1 - 11 / 15) < 1e-12 and abs(got["weighted avg"].f1 - 23 / 30) < 1e-12
    matrix = metrics.confusion_matrix(pairs, "y", "p", [0, 1]).orderBy("label").collect()
    assert [tuple(r) for r in matrix] == [(0, 2, 1), (1, 0, 1)]
    never = rows("y int, p int", (0, 0), (1, 0))
    got = {r.name: r for r in metrics.classification_report(never, "y", "p").collect()}
    assert got["1"].precision == got["1"].f1 == 0
    assert [tuple(r) for r in metrics.confusion_matrix(never, "y", "p", [0, 1]).orderBy("label").collect()] == [(0, 1, 0), (1, 1, 0)]
    dist = {r.label: (r.n, r.share, r.classes) for r in metrics.label_distribution(pairs, "y").collect()}
    assert dist == {0: (3, 0.75, 2), 1: (1, 0.25, 2)}


def test_completeness(rows):
    expected = [rows("url string", ("a.com",), (None,)), rows("url string", ("https://b.com/x",), ("https://www.b.com",))]
    got = quality.completeness(expected, rows("url string", ("https://a.com/1",), ("https://a.com/2",))).first()
    assert tuple(got) == (2, 1, 1, 2, "incomplete")
    got = quality.completeness(expected[:1], rows("url string", ("https://a.com/1",))).first()
    assert got.status == "complete"
    assert quality.domain_count(*expected).first()[0] == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoints.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_quota_above_the_usual_bound(rows):
    urls = [f"https://s.com/{i:02}" for i in range(60)]
    seed = rows("domain string, url string, label int, max_links int", ("s.com", "https://s.com", 1, 50))
    edges = rows("url string, links array<string>", ("https://s.com", urls))
    assert frontier.expand(seed, edges).count() == 50


def test_confusion_of_labels_with_gaps(rows):
    pairs = rows("label int, prediction int", (0, 0), (0, 4), (1, 1), (3, 1), (3, 3), (None, 1))
    found = {r["label"]: tuple(r)[1:] for r in metrics.confusion_matrix(pairs, "label", "prediction").collect()}
    assert found == {0: (1, 0, 0, 1), 1: (0, 1, 0, 0), 3: (0, 1, 1, 0), 4: (0, 0, 0, 0)}
    with pytest.raises(ValueError):
        metrics.confusion_matrix(pairs, "label", "prediction", [0, 1, 3])


def test_levels_do_not_move_the_links(spark, rows):
    edges = rows("url string, links array<string>", *[(f"u{i}", [f"u{i + 1}"]) for i in range(50)])
    lists = checkpoints.bucketed(frontier.shortest_lists(edges, 5), "url", "links")
    start = rows("domain string, url string, label int, max_links int", ("d", "u0", 1, 5))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        level = frontier.next_level(start, start, lists, 5, 1)
        plan = level._jdf.queryExecution().executedPlan().toString()
        assert [r["url"] for r in level.collect()] == ["u1"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[: plan.index("Bucketed: true")].split("\n")[-4:]  # Sort, Filter, scan
    assert "Sort [url" in above[-3] and not any("Exchange" in line for line in above[-3:])
