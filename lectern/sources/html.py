"""HTML to blocks. A small tree builder (implied end tags, void and raw-text elements, entities) on the standard library's
tokenizer, used through Arrow: the semantics of a document tree are beyond column expressions.

Not rebuilt from HTML5's algorithm: foster parenting of misplaced table content and the adoption agency for crossed
formatting elements; crossed tags close up to the matching open one.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BLOCKS
from ..shared import sliced

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose start closes an open p.
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Start tags that close an open element of these names, unless a name of the second set stands in between.
CLOSERS = {
    "li": (("li",), ("ul", "ol")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
HEAD_ONLY = frozenset("title base link meta style script noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("script style head nav svg".split())
INLINE = frozenset("a span em strong b i u small sub sup code abbr cite q mark del ins s time".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.children, self.text = tag, attrs or {}, [], text

    def walk(self):
        """The node and all below, in document order; without recursion, so depth is no limit."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag == "#text")


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.seen_body = False

    def _body(self) -> None:
        """Opens html and body where a document leaves them out."""
        if not self.seen_body:
            if not any(n.tag == "html" for n in self.open):
                self._push("html", {})
            self.open = self.open[: [n.tag for n in self.open].index("html") + 1]
            self._push("body", {})
            self.seen_body = True

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _close(self, names, stops=()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in names:
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}  # the first of repeated attributes counts
        if tag == "html":
            if not any(n.tag == "html" for n in self.open):
                self._push("html", attrs)
            return
        if tag == "head":
            if not self.seen_body:
                if not any(n.tag == "html" for n in self.open):
                    self._push("html", {})
                self._push("head", attrs)
            return
        if tag == "body":
            if not self.seen_body:
                self._body()
                self.open[-1].attrs = attrs
            return
        if not self.seen_body and not (tag in HEAD_ONLY and any(n.tag == "head" for n in self.open)):
            if tag in HEAD_ONLY:
                self.handle_starttag("head", [])
            else:
                self._body()
        if tag in CLOSE_P:
            self._close(("p",), ("button", "td", "th", "table", "body"))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in CLOSERS:
            names, stops = CLOSERS[tag]
            for _ in range(2):
                self._close(names, stops)
        self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # In HTML a trailing slash closes foreign elements only.
        if tag in ("svg", "path", "image", "rect", "g") and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._close(("head",))
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self._body()
            self._push("p", {})
            self.open.pop()
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in HEADINGS:
            self._close(HEADINGS, ("body",))
            return
        self._close((tag,), ("body",) if tag not in ("td", "th", "tr", "table") else ())

    def handle_data(self, data):
        if not self.seen_body and not (len(self.open) > 2 and self.open[-1].tag in HEAD_ONLY):
            if not data.strip():
                return
            self._body()
        self.open[-1].children.append(Node("#text", text=data))


def parse(html: str | bytes) -> Node:
    """The document tree of HTML or XHTML; never fails."""
    if isinstance(html, bytes):
        html = html.decode("utf-8", "replace")
    b = Builder()
    b.feed(html.removeprefix("﻿"))
    b.close()
    return b.root


def collapse(text: str) -> str:
    """Runs of space and line ends as one space; other white space only goes at the ends."""
    for c in "\n\r\t":
        text = text.replace(c, " ")
    return " ".join(x for x in text.split(" ") if x).strip()


def blocks_of(html: str | bytes) -> list[dict]:
    """The body as a sequence of blocks.

    Headings keep their level and their own id, else that of the nearest container; p, li and pre give their collapsed
    text, if any; hr and img give marks. Containers and unknown elements are descended into; inline elements, scripts,
    navigation and drawings are not, and loose text is not a block."""
    body = parse(html).find("body")
    out: list[dict] = []
    stack = [(body, "")] if body else []
    while stack:
        n, anchor = stack.pop()
        tag = n.tag
        if tag == "#text" or tag in SKIPPED or tag in INLINE:
            continue
        if tag in HEADINGS:
            out.append({"kind": "heading", "level": int(tag[1]), "anchor": n.attrs.get("id") or anchor, "text": collapse(n.content()), "alt": ""})
        elif tag in ("p", "li", "pre"):
            if text := collapse(n.content()):
                out.append({"kind": {"p": "paragraph", "li": "list_item", "pre": "pre"}[tag], "level": 0, "anchor": anchor, "text": text, "alt": ""})
        elif tag == "hr":
            out.append({"kind": "hr", "level": 0, "anchor": "", "text": "", "alt": ""})
        elif tag == "img":
            out.append({"kind": "image", "level": 0, "anchor": "", "text": "", "alt": n.attrs.get("alt", "")})
        else:
            inner = n.attrs.get("id") or anchor
            stack += [(c, inner) for c in reversed(n.children)]
    return out


_BLOCK_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("anchor", pa.string()), ("text", pa.string()), ("alt", pa.string())]))


def with_blocks(pages: DataFrame, html: str = "html", into: str = "blocks") -> DataFrame:
    """``pages`` with an array column of blocks; posexplode it for one row each."""

    @F.arrow_udf(BLOCKS) if hasattr(F, "arrow_udf") else F.udf(BLOCKS)
    def extract(column: pa.Array) -> pa.Array:
        return sliced(lambda c: pa.array([blocks_of(x) if x is not None else [] for x in c.to_pylist()], _BLOCK_TYPE), _BLOCK_TYPE, column)

    return pages.withColumn(into, extract(F.col(html)))


def exploded(items: DataFrame, blocks: str = "blocks") -> DataFrame:
    """One row for each block, with block_index."""
    return items.select(*[c for c in items.columns if c != blocks], F.posexplode(blocks).alias("block_index", "b")).select(*[c for c in items.columns if c != blocks], "block_index", "b.*")
