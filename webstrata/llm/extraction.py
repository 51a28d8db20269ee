"""Main text of HTML pages by consensus host paths.

Every page's containers are scored by their running text outside links, with more for
``article`` and ``main``. From the best one the choice climbs to the article around it, or else to
the ``main`` around it, and on to the highest container that adds only running text. The path of
tags and generalised class names reached is the page's vote. Votes are counted per host before they
move; the path with most votes wins, and each page is extracted from all containers with its host's
path in page order, or with the path of its own choice where it has none.
Within it, menus, footers, forms, scripts and elements whose class, id or role names them as
boilerplate are left out. Block elements and line breaks end a block of text; white space in a
block becomes one space.

A page is parsed in one pass over its tags, in time linear in its length. Both passes read the
page table; only votes and winners move, and a host with a third of all pages is one row of votes
for each task.

Defined results: NULL or empty HTML has an empty text; a NULL URL, or one without ``://``, is of the
host with the empty name; markup that ends early is taken as closed there; unknown character
references stay as written; a page without containers votes for ``/``; ties go to the path first by name and the container first on the
page; repeated rows are extracted each. Other columns are kept by ``extract``.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import admitted, join_lookup, stored
from webstrata.llm.url_filter import with_parts

# --- Fixed values: HTML elements ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
CONTAINERS = frozenset("html body div article section main td center blockquote".split())
#: Elements that are never part of the main text.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form menu iframe object svg math select "
    "button textarea title audio video canvas dialog datalist noframes noembed option input".split()
)
#: Words of a class, id or role that name boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner menu nav navbar navigation breadcrumb breadcrumbs footer sidebar aside widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social related recommended recommendations "
    "teaser teasers toolbar pagination pager skip hidden copyright legal contentinfo complementary "
    "dialog tags toc".split()
)
REMARKS = frozenset("comment comments disqus respond reply replies discussion".split())
HEADS = frozenset("header masthead topbar".split())
#: Each attribute in turn, its value consumed with it.
_ATTRIBUTE = re.compile(r"""([^\s=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(\S*+)))?+""")
#: Inside a tag, up to its ``>``. A quote after an equals sign protects up to the next one of its
#: kind, however far; without a next one it is text. Only the last quote of a kind lacks one, so
#: all tags together are scanned in linear time.
_INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """A container: its place, a key of its path of labels, and its counts of characters."""

    __slots__ = ("tag", "parent", "label", "key", "plain", "linked", "score", "all_plain", "all_linked")

    def __init__(self, tag: str, parent: Element | None, label: str) -> None:
        self.tag, self.parent, self.label = tag, parent, label
        self.key = path_key(parent.key if parent else 0, label)
        self.plain = self.linked = self.score = self.all_plain = self.all_linked = 0

    @property
    def path(self) -> str:
        labels, box = [], self
        while box is not None and box.label:
            labels.append(box.label)
            box = box.parent
        return ">".join(reversed(labels)) or "/"


def path_key(above: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above}>{label}") if label else 0


def _tag_end(page: str, at: int) -> int:
    """Where the tag that opens at ``at`` ends: the first ``>`` outside quoted values, or -1."""
    end = _INSIDE.match(page, at).end()
    return end if end < len(page) else -1


def _boilerplate(tag: str, names: str, inside_article: bool) -> bool:
    words, before = [], ""
    for word in _WORDS.findall(names):
        word = word.lower()
        if before not in ("has", "with", "no", "without"):
            words.append(word)
        before = word
    words = set(words)
    if words & REMARKS and tag not in ("html", "body", "main"):
        return True
    if tag in ("html", "body", "main", "article") or tag in ("h1", "h2", "h3", "p"):
        return False
    return bool(words & BOILERPLATE) or bool(words & HEADS and not inside_article)


def parse(page: str | None) -> tuple[list[Element], list[tuple[Element, str, bool]]]:
    """Containers in page order, and the pieces of text with their innermost container.

    A piece with an empty text marks the end of a block. The third part says if it is in a link.
    """
    page = page or ""
    root = Element("", None, "")
    stack: list[tuple[str, Element, bool, bool]] = [("", root, False, False)]
    opened: dict[str, int] = {}
    containers, pieces = [root], []
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        text = page[at : start if start >= 0 else size]
        if text:
            _, box, dropped, link = stack[-1]
            if not dropped:
                pieces.append((box, text, link))
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            _, box, dropped, link = stack[-1]
            if not dropped:
                pieces.append((box, "<", link))
            at = start + 1
            continue
        tag = name.group().lower()
        end = _tag_end(page, name.end())
        at = size if end < 0 else end + 1
        if end < 0:
            break
        if tag not in INLINE:
            pieces.append((stack[-1][1], "", False))
        if closing:
            if opened.get(tag):
                while True:
                    last = stack.pop()
                    opened[last[0]] -= 1
                    if last[0] == tag:
                        break
            continue
        _, box, dropped, link = stack[-1]
        if tag in VOID:
            continue
        names, hidden = "", False
        attributes = page[name.end() : end]
        if attributes.strip(" /\n\t"):
            found: dict[str, str] = {}
            for key, *values in _ATTRIBUTE.findall(attributes):
                found.setdefault(key.lower(), "".join(values))
            for key, value in found.items():
                if key in ("class", "id", "role"):
                    names += f" {value}"
                elif key == "style":
                    hidden |= re.sub(r"\s", "", value.lower()).find("display:none") >= 0
                elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true"):
                    hidden = True
        inside = bool(opened.get("article") or opened.get("main"))
        out = dropped or hidden or tag in DROPPED or (bool(names) and _boilerplate(tag, names, inside))
        out = out or (tag == "header" and not inside)
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, end + 1)
            at = size if not stop else stop.start()
        if tag in CONTAINERS and not out:
            label = tag
            for word in sorted(set(re.sub(r"\d+", "N", names).split())):
                label += "." + word.replace(">", "")
            box = Element(tag, box, label)
            containers.append(box)
        stack.append((tag, box, out, link or tag == "a"))
        opened[tag] = opened.get(tag, 0) + 1
    return containers, pieces


def rate(containers: list[Element], pieces: list[tuple[Element, str, bool]]) -> Element:
    """Score the containers and return the best one, the first of equals.

    Running text counts for its innermost container; text in links counts against it. Three fifths
    of a container's score count for the one around it, so several parts of one text add up there.
    """
    for box, text, link in pieces:
        if text:
            n = len(text) - text.count(" ")
            if link:
                box.linked += n
            else:
                box.plain += n
    for box in reversed(containers):
        box.all_plain += box.plain
        box.all_linked += box.linked
        if box.parent is not None:
            box.parent.all_plain += box.all_plain
            box.parent.all_linked += box.all_linked
        own = max(0, box.plain - 2 * box.linked)
        box.score += own
        if box.tag in ("article", "main"):
            box.score = 1.5 * box.score
        elif box.tag in ("html", "body", ""):
            box.score = 0.7 * box.score
        if box.parent is not None:
            box.parent.score += 0.6 * box.score
    return max(containers, key=lambda box: box.score)


def climb(best: Element, containers: list[Element]) -> Element:
    """The container around ``best`` that holds the whole text.

    That is the outermost article around it, else the nearest ``main``, else itself; and from
    there the highest one of which every part that it adds has no more text in links than
    outside. The page's body adds its own text only, no other boxes.
    """
    chain = [best]
    while chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    way = {id(box) for box in chain}
    beside, links = set(), {id(box) for box in chain if box.linked > box.plain}
    for box in containers:
        if id(box) not in way and id(box.parent) in way and box.all_plain + box.all_linked:
            beside.add(id(box.parent))
            if box.all_linked > box.all_plain:
                links.add(id(box.parent))
    articles = [i for i, box in enumerate(chain) if box.tag == "article"]
    mains = [i for i, box in enumerate(chain) if box.tag == "main"]
    at = articles[-1] if articles else mains[0] if mains else 0
    for box in chain[at + 1 :]:
        if id(box) in links:
            break
        if box.tag in ("html", "body", "") and (id(box) in beside or not box.plain):
            break
        at += 1
    return chain[at]


def text_of(chosen: list[Element], pieces: list[tuple[Element, str, bool]]) -> str:
    """Blocks of the containers' text in page order, joined by one space."""
    inside: dict[int, bool] = {id(box): True for box in chosen}

    def held(box: Element | None) -> bool:
        way = []
        while box is not None and id(box) not in inside:
            way.append(box)
            box = box.parent
        found = inside[id(box)] if box is not None else False
        for b in way:
            inside[id(b)] = found
        return found

    blocks, block = [], []
    for box, text, _ in pieces:
        if text:
            if held(box):
                block.append(text)
        elif block:
            blocks.append(html_lib.unescape("".join(block)))
            block = []
    blocks.append(html_lib.unescape("".join(block)))
    return " ".join(w for b in blocks for w in b.split())


def best_path(page: str | None) -> str:
    """Path of the page's best container after climbing, '' if it has no text."""
    containers, pieces = parse(page)
    best = rate(containers, pieces)
    return climb(best, containers).path if best.score > 0 else ""


def main_text(page: str | None, path: str | None) -> str:
    """Text of the containers with the given path, else with the path of the page's best one."""
    containers, pieces = parse(page)
    best = rate(containers, pieces)
    found = []
    if path:
        key = 0
        for label in path.split(">") if path != "/" else ():
            key = path_key(key, label)
        found = _with_text(containers, key)
    if not found:
        found = _with_text(containers, climb(best, containers).key) or [best]
    return text_of(found, pieces)


def _with_text(containers: list[Element], key: int) -> list[Element]:
    """All containers with the path, if one of them has running text."""
    same = [box for box in containers if box.key == key]
    return same if any(box.score > 0 for box in same) else []


def votes(pages: DataFrame) -> DataFrame:
    """``host, path``: the winning path of each host that has one."""

    @F.pandas_udf("string")
    def path(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([best_path(p) for p in batch], dtype=object)

    counted = (
        pages.select("host", path("html").alias("path"))
        .filter("path <> ''")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    first = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return counted.withColumn("place", F.row_number().over(first)).filter("place = 1").select(
        "host", F.col("path").alias("_path")
    )


def extract(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``text``, the page's main text."""
    pages = admitted(pages, ("host", "text")).withColumnsRenamed({"path": "_kept"})
    hosted = with_parts(pages).drop("path").withColumnsRenamed({"_kept": "path"})
    winners = stored(votes(hosted), "host-paths")

    @F.pandas_udf("string")
    def text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, path in parts:
            yield pd.Series([main_text(a, b) for a, b in zip(page, path, strict=True)], dtype=object)

    joined = join_lookup(hosted, winners, "host", ["url", "html"])
    return joined.withColumn("text", text("html", "_path")).drop("_path")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
