from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from webstrata import settings
from webstrata.functions import urls

FEATURES = [
    ("https://a.com", 13, 5, 1, 0, 0, 0),
    ("https://a.com/", 14, 5, 0, 0, 0, 0),
    ("https://a.com//", 15, 5, 1, 0, 0, 0),
    ("https://www.joe.dev/x/y/", 24, 7, 2, 1, 0, 0),
    ("https://joe.github.io", 21, 13, 1, 1, 1, 0),
    ("https://x.neocities.org/p", 25, 15, 1, 0, 0, 1),
    ("https://joe.dev:8080/", 21, 12, 0, 0, 0, 0),
    ("a.com/x", 7, 0, 2, 0, 0, 0),
    ("http://[abc", 0, 0, 0, 0, 0, 0),
    (None, 0, 0, 0, 0, 0, 0),
]


def test_url_features(rows):
    df = rows("url string", *[(f[0],) for f in FEATURES])
    got = urls.with_url_features(df).select("url", *settings.URL_FEATURES).collect()
    assert [tuple(r) for r in got] == FEATURES


def test_domain_and_path_agree_with_the_standard_library(rows):
    samples = [
        "https://user@www.a.com:80/x;p/y;q=1?z#f", "//h/x", "HTTP://WWW.b.c", "mailto:a@b", "a:b/c",
        "x", "", "http://a?b", "http://a#b", " \thttp://a/b", "ht\ntp://a/\tb", "http://www.www.a/",
        "http://[::1]:8/x", "1http://a/", "http:/a/b", "https://é.fr/ü/",
    ]
    df = rows("url string", *[(s,) for s in samples])
    got = df.select("url", urls.domain(F.col("url")), urls.path(F.col("url"))).collect()
    for url, domain, path in got:
        expected = urlparse(url)
        assert (domain, path) == (expected.netloc.replace("www.", ""), expected.path), url


def test_standardize(rows):
    df = rows("url string", ("example.org",), ("http://a",), ("httpbin.org",))
    got = [r[0] for r in df.select(urls.standardize(F.col("url"))).collect()]
    assert got == ["https://example.org", "http://a", "httpbin.org"]


def test_resolve_agrees_with_the_standard_library(rows):
    bases = [
        "https://www.a.com/d/p.html", "https://a.com", "http://a.com/x//y/?q=1#f", "https://a.com/d/",
    ]
    references = [
        "/x#top", "q", "../r", "?s=1", "//a.com/y", "https://b.com/", "javascript:void(0)", "",
        "../../../z", "./", "..", "a//b", "https:foo", "HTTPS://A.com/?", "/a/../b?x=../y", "/x?",
        "http://b.com", "///q", "g;x=1/../y", "?", "/a;b?c#d", "tel:1", "x/./y/..", "/..", "ftp://q/w#e",
    ]
    for base in bases:
        df = rows("base string, refs array<string>", (base, references))
        df = df.select("base", F.explode("refs").alias("ref")).withColumn("refs", F.array("ref"))
        for row in urls.with_resolved(df, "base", "refs", "out").collect():
            assert row.out == [urljoin(base, row.ref).split("#")[0]], (base, row.ref)
