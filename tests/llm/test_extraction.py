"""Main text of pages of several templates, and broken markup in linear time."""

import time

import pytest

from webstrata.llm import extraction

MENU = "<nav><ul><li><a href=/a>Menu one</a></li><li><a href=/b>Menu two</a></li></ul></nav>"
BODY = "<p>First block of the story, long enough to count.</p><p>Second <b>bold</b> block &amp; more\n text&nbsp;here.</p>"
TEXT = "First block of the story, long enough to count. Second bold block & more text here."
PAGES = {
    "article": f"<html><head><title>T</title><script>x='</p>'</script></head><body>{MENU}<div class='ad'>Buy now now now</div><article>{BODY}</article><footer>&copy; us</footer></body></html>",
    "div": f"<body><header><h2>Site name</h2>{MENU}</header><div id=page><div class='content-12'>{BODY}<div class='share-buttons'>Share this</div></div><div class='sidebar'><p>Other long words of the side bar that go on and on.</p></div></div><div class=cookie-notice>We use cookies</div></body>",
    "comments": f"<main>{BODY}<form><input name=q><label>Search</label></form></main><section id='comments'><article class='comment'><p>{'I disagree with all of it. ' * 30}</p></article></section>",
    "unclosed": f"<body>{MENU}<div class=post>{BODY.replace('</p>', '')}",
    "header inside": f"<article><header><h1>First block of the story, long enough to count.</h1></header>{BODY[BODY.index('<p>Second'):]}</article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    page = PAGES[name]
    path = extraction.best_path(page)
    got = extraction.main_text(page, path)
    assert got == TEXT


def test_host_vote_decides(spark):
    """A page whose advert text outweighs its article follows its host."""
    side = f"<div class=extra><p>{'Unrelated words of another box. ' * 40}</p></div>"
    usual = [f"<div class=story>{BODY}</div><div class=extra><p>Short.</p></div>"] * 5
    rows = [(i, "http://Host.com/a", page) for i, page in enumerate([*usual, f"<div class=story>{BODY}</div>{side}"])]
    rows += [(50, None, None), (51, "x", ""), (52, "http://other.com", side), (53, "http://host.com/b", "plain <3 words & &nope; x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(frame).collect()}
    assert len(got) == len(rows) and all(got[i] == TEXT for i in range(6))
    assert got[50] == got[51] == "" and got[52].startswith("Unrelated") and got[53] == "plain <3 words & &nope; x"
    assert extraction.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<p x='", "<li>x", "<div>", "</div>", "<", "<!--", "<script>", '<a b="\'>'])
def test_broken_markup_is_linear(part):
    page = "<p>words of text</p>" + part * (300_000 // len(part))
    start = time.perf_counter()
    extraction.main_text(page, None)
    assert time.perf_counter() - start < 6


@pytest.mark.parametrize(
    "opening",
    [
        "<article data-title='A hidden valley'>",
        '<article data-hidden="false">',
        "<article data-role=menu data-id=ads>",
        '<article data-x="y hidden id=ads style=display:none">',
        "<article aria-hidden=false>",
    ],
)
def test_only_exact_attributes_count(opening):
    assert extraction.main_text(f"{opening}{BODY}</article>", None) == TEXT


def test_links_keep_their_text():
    links = '<a href="/hidden-falls">falls</a>, <a href="/x?id=ads">class</a>'
    assert extraction.main_text(f"<article><p>{'Words ' * 20}{links}</p></article>", None).endswith(" falls, class")


@pytest.mark.parametrize("names", ["hidden", "HIDDEN=''", "aria-hidden = 'true'", "style='display: none'", "x=1 class=\"a ad\"", "id=sidebar"])
def test_named_attributes_still_hide(names):
    assert extraction.main_text(f"<article>{BODY}<div data-x='>' {names}>Gone</div></article>", None) == TEXT


@pytest.mark.parametrize("size", [99_000, 101_000, 3_000_000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_quoted_value_of_any_size(size, quote):
    value = ("</p></article><p>Not text.</p>" * (size // 30 + 1))[:size]
    page = f"<article><div data-state={quote}{value}{quote}></div>{BODY}</article>"
    assert extraction.main_text(page, None) == TEXT


@pytest.mark.parametrize("part", ["<a b=", "<a b='>", '<a b=">', "<a b= ", "<a =", "<a b=''", "<a>='", "<a b=' c=\">"])
def test_tag_ends_are_linear(part):
    page = "<p>words of text</p>" + part * (1_000_000 // len(part))
    start = time.perf_counter()
    extraction.main_text(page, None)
    assert time.perf_counter() - start < 20


LEAD, LONG = "A short lead stands here.", "Many words make a long body. " * 20
WHOLE = f"{LEAD} {LONG.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        f"<article><header><h1>{LEAD}</h1></header><div class=entry-content><p>{LONG}</p></div></article>",
        f"<body>{MENU}<main><h1>{LEAD}</h1><article><p>{LONG}</p></article></main></body>",
        f"<body><div class=post><p>{LEAD}</p><blockquote>{LONG}</blockquote></div></body>",
        f"<article><p>{LEAD}</p><blockquote><p>{LONG}</p></blockquote></article>",
        f"<body><div class=post><div class=part>{LEAD}</div><div class=part>{LONG}</div></div></body>",
        f"<body><div class=part>{LEAD}</div><div class=links><a href=/a>{LEAD}</a></div><div class=part>{LONG}</div></body>",
        f"<body><h1>{LEAD}</h1><div class=content><div class=in><p>{LONG}</p></div></div></body>",
        f"<h1>{LEAD}</h1><div class=content><p>{LONG}</p></div>",
    ],
)
def test_whole_text_around_and_beside_the_best_box(page):
    for path in (None, extraction.best_path(page)):
        assert extraction.main_text(page, path) == WHOLE


def test_climb_stops_at_link_lists_and_other_boxes():
    links = f"<div class=more><a href=/a>{LEAD}</a><a href=/b>{LEAD}</a></div>"
    for page in (
        f"<body><div class=page><div class=content>{BODY}</div>{links}</div></body>",
        f"<body><div class=content>{BODY}</div><div class=other>{LEAD}</div></body>",
    ):
        assert extraction.main_text(page, extraction.best_path(page)) == TEXT
