"""Text blocks of a page: the one step that needs a stack of open elements."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata import settings

# The code travels to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCKS = "array<struct<tag:string,text:string>>"
# What a Python worker holds as objects: the pages and blocks of so many rows or characters.
SLICE_ROWS = 64
SLICE_CHARS = 1 << 20

# --- Fixed values: HTML elements ---
# Elements that close at once, and elements whose text belongs to no block.
_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
_HIDDEN = frozenset(("template", "rt", "rp"))

# Inside a tag, up to its ">": quotes protect only after an equals sign.
_INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
# What lies between two text pieces: a comment, a whole script or style element, marked
# text, a tag, or a declaration. A tag that is not closed matches up to the end of the page, so
# that nothing behind it is scanned again; it is text.
_BREAK = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)"
    rf"|(script|style)(?=[\s/>]){_INSIDE}(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|!\[CDATA\[(?P<marked>.*?)\]\]>"
    rf"|(?P<close>/?)(?P<name>[a-z][^\s/>]*+){_INSIDE}(?:>|(?P<cut>\Z))"
    r"|[!?/][^>]*+(?:>|(?P<open>\Z)))",
    re.IGNORECASE | re.DOTALL,
)
_FOUND = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))
_BARE_SLASH = re.compile(r"=\s*[^\s\"'>][^\s>]*/>\Z")


def text_blocks(html: Column) -> Column:
    """``array<struct<tag,text>>`` of the target tags in document order, NULL when there is none.

    Arrow batches of the HTML column alone travel to Python; other columns stay in the JVM.
    Marked as not deterministic, so that the optimizer never copies it into a filter and
    every page is parsed once.
    """
    return F.arrow_udf(_parse_batches, BLOCKS).asNondeterministic()(html)


def _parse_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Blocks in slices, so that memory follows neither the batch nor the partition."""
    for pages in batches:
        found: list[list[dict] | None] = []
        chars = 0
        for page in pages:
            html = page.as_py()
            found.append(None if html is None else (page_blocks(html) or None))
            chars += len(html or "")
            if len(found) >= SLICE_ROWS or chars >= SLICE_CHARS:
                yield pa.array(found, type=_FOUND)
                found, chars = [], 0
        if found:
            yield pa.array(found, type=_FOUND)


def page_blocks(
    page: str, targets: frozenset[str] = frozenset(settings.BLOCK_TAGS)
) -> list[dict[str, str]]:
    """Blocks of one page.

    Only subtrees of target tags are kept. A start tag opens an element, an end tag closes
    up to the nearest open element of its name, nothing is closed implicitly. A block's text
    is every text piece below it, each stripped, joined with nothing; a nested target is a
    block of its own as well. Text of script, style, template and ruby notes belongs to no
    block.
    """
    stack: list[tuple[str, int]] = []  # name, index of its block or -1
    open_count: dict[str, int] = {}
    pieces: list[str] = []
    blocks: list[list] = []  # tag, first piece, end piece
    hidden = 0

    def keep(text: str) -> None:
        if stack and not hidden:
            text = unescape(text).strip()
            if text:
                pieces.append(text)

    def close() -> str:
        nonlocal hidden
        name, block = stack.pop()
        open_count[name] -= 1
        hidden -= name in _HIDDEN
        if block >= 0:
            blocks[block][2] = len(pieces)
        return name

    at = 0
    for found in _BREAK.finditer(page):
        if found["cut"] is not None or found["open"] is not None:
            break
        keep(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            if found["marked"]:
                keep(found["marked"])
            continue
        name = name.lower()
        if found["close"]:
            if open_count.get(name):
                while close() != name:
                    pass
            continue
        if name in _VOID or not (stack or name in targets):
            continue
        if page[at - 2] == "/" and not _BARE_SLASH.search(found[0]):
            continue
        block = -1
        if name in targets:
            block = len(blocks)
            blocks.append([name, len(pieces), 0])
        stack.append((name, block))
        open_count[name] = open_count.get(name, 0) + 1
        hidden += name in _HIDDEN
    keep(page[at:])
    while stack:
        close()

    texts = []
    for tag, first, end in blocks:
        text = " ".join("".join(pieces[first:end]).split())
        if text:
            texts.append({"tag": tag, "text": text})
    return texts
