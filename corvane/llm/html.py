"""Main text of web pages by two passes of block rules.

A page is cut into blocks. The first pass decides a block on its own, by its link density, its length and its density of
stop words, each weighed by where it stands: inside an article or main element text is likely, in a box whose class or id
speaks of something beside the text it has to read like text. What the contract names (menus, headers, footers, sidebars,
notices, adverts, forms, comments) is left out by its element or by an unmistakable name. Blocks that stay undecided get,
in the second pass, the label of the nearest decided neighbour, headings that of the text they stand over. Of a page's
articles and what stands beside them, the side with more good text is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup
from .markup import END, START, TEXT, attributes_of, events

#: Frequent words of English, German, French and Spanish; fixed values.
STOP = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its not of on or that the their they this to was were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht oder sich sie sind so um und von vor war wie wird zu zum zur über "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous à "
    "al como con cuando de del el ella en entre es esta este ha hay la las le lo los más me mi muy no o para pero por que se si sin sobre su sus también un una y ya".split()
)
#: Characters under which a block is short, and from which it is long.
SHORT, LONG = 70, 200
#: Densities of stop words from which a block reads like text, and is text if long; links beyond LINKS are a menu.
SOME, MANY, LINKS = 0.30, 0.32, 0.5
#: Up to this link density a block may be text in any language, whatever its stop words: if long, it is.
FEW = 0.2

RAW = markup.RAW | {"head"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form menu dialog".split())
BREAK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOX = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html li main menu nav ol section table td th tr ul".split())
#: Words of class, id or role of a box that is no part of the text, and of one that likely isn't: what stands there has to read like text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notices pager pagination popup promo promoted sidebar sponsor sponsored".split()
)
MAYBE = frozenset(
    "byline dialog disclaimer discussion overlay promotion recommendations recommended related replies reply respond responses search share sharing signup skip social subscribe subscription toc toolbar widget widgets".split()
)

CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"[^\W\d_]+")
#: Characters of scripts that write a syllable or a word with each; one counts as three.
WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")

MAIN, OUTSIDE, EXCLUDED = 1, 0, -1
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    zone: int
    links: int
    linked: int
    heading: bool
    article: int
    doubtful: bool = False


#: A class that begins so says what a box has beside it, or lacks; it doesn't mark the box.
BESIDE = frozenset("has with without no".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Marks:
    """What class, id and role of an element say: that it isn't main text, that it is only a header, that it may not be main text, that it is."""

    out: bool = False
    header: bool = False
    maybe: bool = False
    main: bool = False


def marked(attributes: str) -> Marks:
    out: set[str] = set()
    maybe = main = False
    for name, value in attributes_of(attributes):
        if name not in ("class", "id", "role"):
            continue
        for one in value.split():
            words = [w.lower() for w in re.split(r"[^A-Za-z]+", CAMEL.sub(" ", one)) if w]
            if words and words[0] not in BESIDE:
                out |= MARKS.intersection(words)
                maybe |= not MAYBE.isdisjoint(words)
            main |= name == "role" and "main" in words
    return Marks(bool(out), out == {"header"}, maybe, main)


def blocks(html: str, marked_articles: bool = False) -> list[Block]:
    """All blocks of a page, white space in each made one space. With ``marked_articles``, marks don't exclude an outermost article. Character references count as what they stand for."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    # An open element: its name, and what held outside it (zone, the article it is in, whether in a header of one, whether in doubt).
    stack: list[tuple[str, int, int, bool, bool]] = []
    opened: dict[str, int] = {}
    zone, article, in_header, doubtful, in_link, heading, links, articles = OUTSIDE, 0, False, False, 0, False, 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                where = EXCLUDED if in_header and not heading else zone
                out.append(Block(text, where, links, len(" ".join(unescape("".join(linked)).split())), heading, article, doubtful))
            parts.clear()
            linked.clear()
        links = 0

    for event, name, attributes in events(html, RAW):
        if event == TEXT:
            parts.append(name)
            if in_link:
                linked.append(name)
            continue
        if event == START:
            if name in RAW:
                if name in BREAK:
                    flush()
                elif parts and name not in ("script", "style"):
                    parts.append(" ")
                continue
            if name in BREAK:
                flush()
            if name == "br":
                parts.append("\n")
            if name in VOID:
                continue
            stack.append((name, zone, article, in_header, doubtful))
            opened[name] = opened.get(name, 0) + 1
            if name == "a":
                in_link += 1
                links += 1
            if name in HEADINGS:
                heading = True
            elif name in BOX:
                m = marked(attributes) if attributes else Marks()
                if name not in ("body", "html", "article", "main"):
                    doubtful |= m.maybe
                if m.header and article:
                    in_header = True
                elif name in NEVER or (m.out and name not in ("body", "html", "article", "main")) or (name == "article" and (m.out or m.maybe) and (article or not marked_articles)):
                    zone = EXCLUDED
                elif name == "header":
                    if article:
                        in_header = True
                    else:
                        zone = EXCLUDED
                elif name in ("article", "main") or m.main:
                    if zone != EXCLUDED:
                        zone = MAIN
                        articles += 1
                        article = article or articles
        elif event == END:
            if name in BREAK:
                flush()
            if name in HEADINGS:
                heading = False
            if not opened.get(name):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for gone in stack[k:]:
                        in_link -= gone[0] == "a"
                        opened[gone[0]] -= 1
                    _, zone, article, in_header, doubtful = stack[k]
                    del stack[k:]
                    break
                if name not in BOX and stack[k][0] in BOX:
                    break
    flush()
    return out


def stop_density(text: str) -> float:
    words = WORDS.findall(text.lower())
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def decide(b: Block) -> int:
    """The first pass: a block by itself."""
    if b.zone == EXCLUDED:
        return BAD
    size = len(b.text)
    if b.linked > LINKS * size and (b.zone == OUTSIDE or b.doubtful or b.links > 1):
        return BAD
    density = stop_density(b.text)
    full = size + 2 * len(WIDE.findall(b.text))
    few = b.linked <= FEW * size
    if b.doubtful:
        return GOOD if few and (density >= SOME and full >= SHORT or full > LONG) else OPEN if b.heading else BAD
    if b.zone == MAIN:
        return GOOD if full >= SHORT and few or density >= SOME or b.heading else OPEN
    if full < SHORT:
        return BAD if b.links else OPEN
    if density >= MANY or few:
        return GOOD if full > LONG else OPEN
    return OPEN if density >= SOME else BAD


def labelled(found: list[Block]) -> list[int]:
    """Both passes: GOOD or BAD for each block."""
    labels = [decide(b) for b in found]
    n = len(found)
    before: list[tuple[int, int]] = []
    last = (BAD, n + 1)
    for i, label in enumerate(labels):
        last = (label, i) if label != OPEN else last
        before.append(last)
    after: list[tuple[int, int]] = [(BAD, n + 1)] * n
    last = (BAD, n + 1)
    for i in range(n - 1, -1, -1):
        last = (labels[i], i) if labels[i] != OPEN else last
        after[i] = last
    out = []
    for i, b in enumerate(found):
        label = labels[i]
        if label == OPEN:
            (x, p), (y, q) = before[i], after[i]
            near, far = i - p if p <= n else n + 1, q - i if q <= n else n + 1
            if near > n and far > n:  # nothing is decided
                label = GOOD if b.zone == MAIN else BAD
            elif b.heading and b.doubtful:
                label = y
            elif near == far:
                label = GOOD if GOOD in (x, y) and (x == y or b.zone == MAIN) else BAD
            else:
                label = x if near < far else y
        out.append(label)
    return out


def good_text(found: list[Block]) -> str:
    """The good blocks: of those in an article or main element if they hold most of the good text, else of all."""
    labels = labelled(found)
    inside = [b for b in found if b.zone == MAIN]
    good = [0, 0]
    for b, label in zip(found, labels, strict=True):
        good[b.zone == MAIN] += len(b.text) if label == GOOD else 0
    if inside and good[True] >= good[False]:
        found, labels = inside, labelled(inside)
    return "\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by an empty line; empty if there is none. Marked articles are main text only if nothing else is."""
    return good_text(blocks(html or "")) or good_text(blocks(html or "", True))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, from its whole html.

    One row per row, in time that grows with the page, however broken its markup; null ids and urls stay null; a null or empty html, or one without main text, gives an empty text
    and 0 characters. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
