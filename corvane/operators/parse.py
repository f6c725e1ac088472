"""HTML to text and to typed blocks, with a tolerant tree builder on the standard library's tokenizer.

Parsing is the one step that no built-in function can do; it runs on Arrow batches of one column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.schemas import BLOCKS

# Which elements are left out, and which make which block.
NO_TEXT = frozenset(("script", "style", "noscript", "template"))
NO_BLOCKS = NO_TEXT | {"nav"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
DEEPEST = 4
LISTS, TEXTS = ("ul", "ol"), ("p", "blockquote")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", *HEADINGS))
#: Elements that end an open one of a kind, and where looking for it stops.
SIBLINGS = {"li": (("li",), ("ul", "ol")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}
SPACE = re.compile(r"\s+")
#: Pages that are Python objects at once.
PART = 128


class Node:
    __slots__ = ("children", "name")

    def __init__(self, name: str) -> None:
        self.name = name
        self.children: list[Node | str] = []

    def texts(self, skip: frozenset[str]) -> list[str]:
        out: list[str] = []
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, str):
                    out.append(c)
                elif c.name not in skip:
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()
        return out

    def all(self, name: str, skip: frozenset[str]) -> list[Node]:
        out: list[Node] = []
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            if n.name in skip:
                continue
            if n.name == name:
                out.append(n)
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
        return out


class Tree(HTMLParser):
    """Builds nodes; unclosed elements end with their parent, stray end tags are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.body: Node | None = None

    def _close(self, names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return
            if self.open[i].name in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.body is not None:
            return
        if tag in ENDS_P:
            self._close(("p",), ("td", "th", "li", "div", "table", "article", "section"))
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag == "body":
            self.body = node
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].name == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return
            if tag not in ("table", "div", "body", "html", "article", "section", "ul", "ol") and self.open[i].name in ("td", "th", "table", "article", "section"):
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    t = Tree()
    t.feed(html)
    t.close()
    return t.body or t.root


def normal(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def text_of(html: str | None) -> str:
    """The text nodes of the body, joined by spaces, white space normalised. Navigation is part of it."""
    return normal(" ".join(tree(html).texts(NO_TEXT))) if html else ""


def _inline(n: Node) -> str:
    return normal(" ".join(n.texts(NO_BLOCKS)))


def _table(n: Node) -> str:
    rows = ([_inline(c) for c in tr.children if isinstance(c, Node) and c.name in ("td", "th")] for tr in n.all("tr", NO_BLOCKS))
    return "\n".join(" | ".join(filter(None, r)) for r in rows if any(r))


def _items(n: Node) -> str:
    items = (_inline(c) for c in n.children if isinstance(c, Node) and c.name == "li")
    return "\n".join(f"- {x}" for x in items if x)


def blocks_of(html: str | None) -> list[dict]:
    """Blocks in the order of the page: heading (levels 1 to 4), text, table, code. Text that stands in no such element is no block."""
    out: list[dict] = []

    def emit(kind: str, text: str, level: int | None = None) -> None:
        if text.strip():
            out.append({"pos": len(out), "kind": kind, "text": text, "level": level})

    todo = [iter(tree(html).children)] if html else []
    while todo:
        for c in todo[-1]:
            if isinstance(c, str) or c.name in NO_BLOCKS:
                continue
            if c.name in HEADINGS:
                emit("heading", _inline(c), min(int(c.name[1]), DEEPEST))
            elif c.name == "table":
                emit("table", _table(c))
            elif c.name == "pre":
                emit("code", "\n".join(c.texts(NO_BLOCKS)).strip("\n"))
            elif c.name in LISTS:
                emit("text", _items(c))
            elif c.name in TEXTS:
                emit("text", _inline(c))
            else:
                todo.append(iter(c.children))
                break
        else:
            todo.pop()
    return out


def in_parts(of: Callable, kind: pa.DataType, values: pa.Array) -> pa.Array:
    """``of`` each value, PART values at a time, so that however many rows a batch has, few are Python objects at once."""
    parts = [pa.array([of(x) for x in values.slice(lo, PART).to_pylist()], kind) for lo in range(0, len(values), PART)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def body_text(html: Column) -> Column:
    """text_of as a column."""

    @arrow_udf("string")
    def texts(h: pa.Array) -> pa.Array:
        return in_parts(text_of, pa.string(), h)

    return texts(html)


def read_text(html: Column) -> Column:
    """struct<text, error>: text_of, or what kept a page from being parsed; one bad page ends nothing."""

    def one(h: str | None) -> dict[str, str | None]:
        try:
            return {"text": text_of(h), "error": None}
        except Exception as failure:
            return {"text": None, "error": f"parse: {type(failure).__name__}: {failure}"}

    @arrow_udf("struct<text:string,error:string>")
    def texts(h: pa.Array) -> pa.Array:
        return in_parts(one, pa.struct([("text", pa.string()), ("error", pa.string())]), h)

    return texts(html)


def block_list(html: Column) -> Column:
    """blocks_of as a column; null for a page that can't be parsed."""

    def one(h: str | None) -> list[dict] | None:
        try:
            return blocks_of(h)
        except Exception:
            return None

    @arrow_udf(BLOCKS)
    def lists(h: pa.Array) -> pa.Array:
        return in_parts(one, pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32())])), h)

    return lists(html)


def parse_blocks(pages: DataFrame, html: str = "body_html", keep: tuple[str, ...] = ("page_id", "breadcrumb")) -> DataFrame:
    """One row per block: the kept columns, pos, kind, text, level."""
    found = pages.select(*keep, F.explode(block_list(F.col(html))).alias("b"))
    return found.select(*keep, "b.*")
