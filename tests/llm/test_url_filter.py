"""URL parts and rules against plain Python, and the model on URLs it has not seen."""

from webstrata.llm import url_filter

URLS = [
    "http://A.Net/x", "https://www.example.net/en/1?q", "https://example.net/de/1", "x://Sub.Example.COM/de/a#b",
    "http://example.com/fr/", "http://org/fr/1", "http://a.org/fr", "http://ÀB.net/", "http://a.net", "nothing",
    "://", "http://?x", "a://b://c/d", "http://notexample.net/en/", "http://net.com/", None, "", "http://x.net:80/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return best and (best[0] + best[1], best[2])


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, label string")
    got = url_filter.judge(pages, None).orderBy("page_id").collect()
    assert len(got) == len(URLS)
    for row, url in zip(got, URLS, strict=True):
        assert (row["host"], row["path"]) == parts(url)
        rule = ruled(*parts(url))
        assert row["rule"] == (rule and rule[0])
        assert row["verdict"] == (rule[1] if rule else "allow")


def test_model_generalises_and_is_stable(spark):
    good = [(f"http://news{i}.example.com/story/{i}", 0.0) for i in range(120)]
    bad = [(f"http://casino{i}.win/free/bonus{i}", 1.0) for i in range(120)]
    model = url_filter.fit(spark.createDataFrame(good + bad, "url string, label double"))
    again = url_filter.fit(spark.createDataFrame((good + bad)[::-1], "url string, label double").repartition(5))
    new = [("http://news999.example.com/story/77",), ("http://casino777.win/free/bonus5",), (None,)]
    frame = spark.createDataFrame(new, "url string")
    first = [r["verdict"] for r in url_filter.judge(frame, model).collect()]
    assert first[:2] == ["allow", "block"] and first[2] in ("allow", "block")
    scores = lambda m: [r["block_score"] for r in url_filter.judge(frame, m).collect()]
    assert scores(model) == scores(again)


def test_one_label_none_and_empty(spark):
    one = spark.createDataFrame([("http://a/b", 1.0), (None, 1.0)], "url string, label double")
    frame = spark.createDataFrame([("http://q/w",)], "url string")
    assert url_filter.judge(frame, url_filter.fit(one)).first()["verdict"] == "block"
    assert url_filter.fit(one.limit(0)) is None
    assert url_filter.judge(frame.limit(0), None).collect() == []
