import time
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from hypothesis import given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F

from webstrata import settings
from webstrata.functions import blocks, markup

STRUCTURE = [
    (
        '<meta name="generator" content="Hugo 0.1"><a>x</a><a href="/y">y</a><form></form>',
        1, 0, 0, 0, 2, 1,
    ),
    ('<meta name="generator" content="WordPress"><meta name="generator" content="Hugo">', 0, 0, 1, 0, 0, 0),
    ('<meta name="Generator" content="Hugo">', 0, 0, 0, 0, 0, 0),
    ('<meta name="generator"><a href="/">x</a>', 0, 0, 0, 0, 0, 0),
    ("<META CONTENT='JEKYLL v4' name=generator>", 0, 1, 0, 0, 0, 0),
    ('<script src="//js.hs-scripts.com/1.js"></script>', 0, 0, 0, 1, 0, 0),
    ('<script data-src="//js.hs-scripts.com/1.js"></script>', 0, 0, 0, 0, 0, 0),
    ('<!-- <a> --><script>"<a>"</script><abbr>q</abbr>', 0, 0, 0, 0, 0, 0),
    ('<div title="<a >"><A\nHREF=x><form/>', 0, 0, 0, 0, 1, 1),
    ("", 0, 0, 0, 0, 0, 0),
    (None, 0, 0, 0, 0, 0, 0),
]


def test_structural_features(rows):
    df = rows("html string", *[(s[0],) for s in STRUCTURE])
    got = markup.with_structural_features(df).select("html", *settings.STRUCTURAL_FEATURES).collect()
    assert [tuple(r) for r in got] == STRUCTURE


def test_hrefs(rows):
    page = (
        "<a href=\"/x?a=1&amp;b=2&eacute;&#8364;&#x41;&#128;&nope;&lt\">1</a><a HREF='q'>2</a>"
        '<a href=z/y title="href=no">3</a><a title="a href=no" href = "t">4</a><a href>5</a><a name=x>'
        '<a href="#c"><a href="mailto:x"><a href="tel:1"><a href="/x"><!-- <a href="c"> -->'
        '<a data-href="n" href="u"><a href="/x">'
    )
    got = rows("h string", (page,), (None,)).select(markup.hrefs(F.col("h"))).collect()
    assert got[0][0] == ["/x?a=1&b=2é€A€&nope;&lt", "q", "z/y", "t", "", "/x", "u"]
    assert got[1][0] == []


def test_leaf_blocks(rows):
    page = '<ul><li> a <b>b</b> c&amp;d </li><li></li><LI x=">">e\n f<!-- q --> g</li></ul>'
    got = rows("h string", (page,)).select(markup.leaf_blocks(F.col("h"), "li")).collect()
    assert got[0][0] == ["abc&d", "e fg"]


def test_long_markup_needs_no_stack(rows):
    page = "<a " + "x=1 " * 50000 + 'href="/y">' + "<i>" * 50000 + "<!--" + "-" * 50000 + "--><a>"
    got = markup.with_structural_features(rows("html string", (page,))).collect()[0]
    assert got.link_count == 2


BLOCKS = [
    ("<p> Hello <b>world</b> </p>", [("p", "Helloworld")]),
    ("<article><h1>T</h1><p>a  b</p></article>", [("article", "Ta b"), ("h1", "T"), ("p", "a b")]),
    ("<p><b>x<br><p>y</p>", [("p", "xy"), ("p", "y")]),
    ("<p>a &amp; b</p>", [("p", "a & b")]),
    ('<script>var t="</p>";</script><p>k</p>', [("p", "k")]),
    ("<p>a<!-- c --> b</p>", [("p", "ab")]),
    ("<P>a<template>t</template><ruby>b<rt>c</rt></ruby><style>p</p></style></P>", [("p", "ab")]),
    ("<p><![CDATA[x]]>y<p/>z", [("p", "xyz")]),
    ("<div>z</div><p> </p>", None),
    ("", None),
    (None, None),
]


def test_text_blocks(rows):
    df = rows("html string", *[(b[0],) for b in BLOCKS])
    got = df.select("html", blocks.text_blocks(F.col("html")).alias("b")).collect()
    assert [(r.html, r.b and [tuple(x) for x in r.b]) for r in got] == BLOCKS


def test_pages_are_parsed_once(spark, rows):
    df = rows("url string, html string", ("u", "<p>x</p>"))
    parsed = df.withColumn("b", blocks.text_blocks(F.col("html"))).filter(F.size("b") > 0)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


class SlowReader(HTMLParser):
    """Brute force: the standard parser, every element keeps the pieces of all its ancestors."""

    VOID = {"br", "img"}
    HIDDEN = {"script", "style", "template"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.text = [], [], ""
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        piece, self.text = self.text.strip(), ""
        if not any(name in self.HIDDEN for name, _ in self.stack):
            for _, pieces in self.stack:
                pieces.append(piece)

    def handle_data(self, data):
        self.text += data

    def handle_comment(self, data):
        self.flush()

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in self.VOID or not (self.stack or tag in settings.BLOCK_TAGS):
            return
        pieces = []
        self.stack.append((tag, pieces))
        if tag in settings.BLOCK_TAGS:
            self.found.append((tag, pieces))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag in [name for name, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def blocks(self):
        texts = ((tag, " ".join("".join(pieces).split())) for tag, pieces in self.found)
        return [{"tag": tag, "text": text} for tag, text in texts if text]


PARTS = st.sampled_from(
    "<p> </p> <b> </b> <div> </div> <article> </article> <LI> </li> <br> <br/> <p/> <h2> </h2> a é &amp; "
    "&#65; &lt;p&gt; <!--c--> <pre> </pre> <template> </template> <blockquote> </blockquote> "
    "<script>if(a</p>)</script> <style>x</style> <img/>".split()
    + [" ", "\n", "x < y", '<p class="a>b" id=c>', "<p title='</p>'>", "</p >"]
)


@given(st.lists(PARTS, max_size=40).map("".join))
@hypothesis_settings(max_examples=400, deadline=None)
def test_text_blocks_against_the_standard_parser(page):
    assert blocks.page_blocks(page) == SlowReader(page).blocks()


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<p x='", "<li>x", "<li a=", "</li ", "<script ", "<!", "<![CDATA[", "<"])
def test_unclosed_markup_takes_linear_time(spark, part):
    page = "<p>kept</p><a href='/x'>y</a>" + part * ((1 << 20) // len(part))
    begin = time.perf_counter()
    if part != "<li>x":  # nested items are blocks that hold all that follows
        assert blocks.page_blocks(page)[0]["text"] == "kept"
    assert time.perf_counter() - begin < 4
    frame = spark.createDataFrame([(page,)], "html string")
    begin = time.perf_counter()
    row = markup.with_structural_features(frame).select(
        "link_count", markup.hrefs(F.col("html")).alias("h"), markup.leaf_blocks(F.col("html"), "li").alias("b")
    ).first()
    assert time.perf_counter() - begin < 15
    assert row["h"] == ["/x"]


def test_a_tag_that_is_not_closed_is_text():
    assert blocks.page_blocks('<p>a <b x="1') == [{"tag": "p", "text": 'a <b x="1'}]
    assert blocks.page_blocks("<p>a</p") == [{"tag": "p", "text": "a</p"}]


def test_blocks_leave_a_worker_in_slices():
    """A batch of any size is parsed a slice at a time, rows in their order and none left out."""
    pages = [None if i % 50 == 7 else "" if i % 50 == 8 else f"<p>a{i}</p><li>b" for i in range(1000)]
    pages[500] = "<p>" + "x" * blocks.SLICE_CHARS
    taken = []

    def batches():
        for start in (0, 600, 600):
            taken.append(start)
            yield pa.array(pages[start : 1000 if start else 600] if len(taken) < 3 else [], pa.string())

    found, sizes = [], []
    for part in blocks._parse_batches(batches()):
        if not sizes:
            assert taken == [0]
        sizes.append(len(part))
        found += part.to_pylist()
    assert max(sizes) <= blocks.SLICE_ROWS and len(sizes) > 1000 // blocks.SLICE_ROWS
    assert found == [None if p is None else (blocks.page_blocks(p) or None) for p in pages]
    assert found[500][0]["text"] == pages[500][3:] and found[7] is None and found[8] is None
