"""Tags and text of an HTML page, however broken, in time that grows with its length."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is not markup, and those of them that, unclosed, take the rest of the page along.
RAW = frozenset("script style noscript template textarea iframe svg canvas title select button object video audio".split())
TO_THE_END = frozenset("script style textarea title head".split())
TEXT, START, END = 0, 1, 2
Event = tuple[int, str, str]

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


def tag_end(html: str, at: int, plain: bool) -> tuple[int, bool]:
    """Where the tag ends whose name ends at ``at``: the first > outside quotes. If none is, the page's quotes are broken, and from then on (plain) any > ends a tag."""
    k = at
    while not plain:
        m = _STOP.search(html, k)
        if m is None:
            plain = True
        elif m[0] == ">":
            return m.start(), False
        else:
            close = html.find(m[0], m.end())
            k = m.end() if close < 0 else close + 1
    return html.find(">", at), True


def events(html: str, raw: frozenset[str] = RAW) -> Iterator[Event]:
    """(TEXT, text, ''), (START, name, attributes) and (END, name, '') in order; names in lower case.

    Comments, declarations and the content of ``raw`` elements are left out, end tags of these too. A < that begins no tag,
    and a tag that never ends, are text. Nothing is searched for twice: an end that is missing once is missing for good.
    """
    n, at, last, plain = len(html), 0, html.rfind(">"), False
    missing: set[str] = set()
    ends: dict[str, re.Pattern[str]] = {}
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            yield TEXT, html[at:], ""
            return
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 2)
            after = close + 3 if close >= 0 else n
        elif html[lt + 1] in "!?":
            after = html.find(">", lt) + 1
        elif (m := _NAME.match(html, lt + 1)) is None:
            yield TEXT, html[at : lt + 1], ""
            at = lt + 1
            continue
        else:
            if lt > at:
                yield TEXT, html[at:lt], ""
            close, plain = tag_end(html, m.end(), plain)
            name, attributes = m[2].lower(), html[m.end() : close]
            at = close + 1
            if m[1]:
                if name not in raw:
                    yield END, name, ""
                continue
            yield START, name, attributes
            if name not in raw or (name in ("svg", "object") and attributes.rstrip().endswith("/")):
                continue
            if name not in missing:
                if name not in ends:
                    ends[name] = re.compile(r"(?i)</head[^>]*>|(?=<body\b)" if name == "head" else rf"(?i)</{re.escape(name)}(?=[\s/>])[^>]*>")
                found = ends[name].search(html, at)
                if found:
                    at = found.end()
                    continue
                missing.add(name)
            if name in TO_THE_END:
                return
            continue
        if lt > at:
            yield TEXT, html[at:lt], ""
        at = after


def attributes_of(text: str) -> Iterator[tuple[str, str]]:
    """(name, value) of the attributes of a tag, names in lower case, values as they stand."""
    for m in _ATTRIBUTE.finditer(text):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""
