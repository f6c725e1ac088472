"""HTML extraction (3): hand-made pages, and all fixture pages against their article."""

import html as H
import re
import time

import pytest

from corvane.llm import html as rules
from corvane.llm.html import extract, main_text


def test_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies and so on.</div>
    <main><article><h1>Head &amp; tail</h1><p>First   para<br>with <b>bold</b> &eacute;t&eacute; text that runs on and on, so that it is long enough.
    <p>Short.<ul><li>one</li><li>two</li></ul><aside>Not this</aside><div class="ad">Buy now</div><form><input><p>Your mail</form>
    <table><tr><td>a</td><td>b</td></tr></table><!-- <p>gone</p> --><noscript>no</noscript><div class="comments"><article><p>A reader says a lot of things here, and more.</p></article></div></article></main>
    <div id="sidebar"><p>Elsewhere the of and to in a text that is long enough to be taken for one, were it not for where it stands.</p></div><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "Head & tail\n\nFirst para with bold été text that runs on and on, so that it is long enough.\n\nShort.\n\none\n\ntwo\n\na\n\nb"


def test_marks():
    assert main_text('<div class="with-sidebar no-ads"><article><div class="post-header"><h1>T</h1><p>By someone</p></div><p>Body.</p><div class="shareButtons"><p>Share</p></div></article></div>') == "T\n\nBody."


def test_two_passes_without_article():
    long = "This is the text of a page that has no article, and it is as long as the rules ask of it, with many of the words that are in all texts. " * 2
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{long}</p><p>Short line</p><p>{long}</p></div><p>Tail</p><div><a href=3>All rights</a></div></body>"
    text = " ".join(long.split())
    assert main_text(page) == f"{text}\n\nShort line\n\n{text}"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article>x"), (4, "w", "<p>" * 3000), (5, "x", "plain"), (6, "y", "<article>" + "word " * 50000 + "</article>"), (6, "y", "<script>var a = 1"), (7, "z", "<article>a<b c='>'>b</b>&lt;i&gt;&#65;&amp</article>")]
    pages = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, n_chars int")
    got = [(r.page_id, r.url, r.text[:20], r.n_chars) for r in extract(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", "x", 1), (4, "w", "", 0), (5, "x", "", 0), (6, "y", "word word word word ", 249999), (6, "y", "", 0), (7, "z", "ab<i>A&", 7)], key=repr)
    assert extract(pages.limit(0)).collect() == []


def test_fixture_pages_are_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(filter(None, blocks))


def test_pages_without_article_in_other_languages():
    texts = [
        "Il museo conserva centinaia di opere antiche, raccolte durante molti secoli da famiglie nobili; ogni stanza racconta una storia diversa, dove pittura, scultura ed architettura dialogano sempre fra loro, offrendo ai visitatori percorsi nuovi.",
        "Deze stad kreeg vroeg stadsrechten, waarna handelaren overal pakhuizen bouwden; tegenwoordig wonen daar vooral studenten, kunstenaars, gepensioneerden, terwijl oude grachten jaarlijks duizenden bezoekers trekken vanuit heel Europa en verder.",
        "Музей открыт ежедневно, кроме понедельника; посетители могут увидеть картины, скульптуры, старинные книги, карты, монеты, а также послушать лекции, которые читают известные историки, художники, архитекторы нашего города каждую субботу вечером.",
        "这座城市有着悠久的历史,许多古老的建筑至今保存完好。游客可以沿着河边散步,参观博物馆,品尝当地的美食。每年春天,这里都会举行盛大的节日活动,吸引来自世界各地的人们前来观看和参加。",
        "Researchers measured rainfall, temperature, humidity, wind speed plus soil moisture across twelve stations; results showed steady warming since 1970, stronger winters storms, drier summers, earlier harvests, fewer frost days, higher river levels.",
    ]
    for t in texts:
        assert main_text(f'<body><div><a href="/1">Menu</a> <a href="/2">Other</a></div><div><p>{t}</p></div><div><a href="/3">Imprint</a></div></body>') == t


def test_teaser_article_does_not_hide_the_body():
    body = "The river rose for three days, and on the fourth it broke through the wall that the town had built after the flood of the last century. " * 2
    text = " ".join(body.split())
    assert main_text(f'<body><article class="hero"><p>A short teaser.</p></article><div><p>{body}</p><p>{body}</p></div></body>').endswith(f"{text}\n\n{text}")
    assert main_text(f'<body><div><p>{body}</p></div><article class="related"><p>{body}{body}{body}</p></article></body>') == text
    assert main_text(f'<body><article class="share"><p>{body}</p></article></body>') == text
    assert main_text(f'<body><article><p>{body}</p><p>{body}</p></article><div><p>{body}</p></div></body>') == f"{text}\n\n{text}"


LONG = "The river rose for three days, and on the fourth it broke through the wall that the town had built after the flood of the last century; many of the people who lived by it were gone by then. "
PLAIN = "Item 4711 Gearbox Steel Cast Iron Flange Bolts Washers Seals Bearings Housing Shaft Pulley Belt Chain Sprocket Motor Pump Valve Filter Hose Clamp Nozzle Gauge Meter Sensor Switch Relay Fuse Cable Plug Socket Lamp Panel Frame Cover"


def test_boxes_in_an_article_that_only_sound_like_something_else():
    text = LONG.strip()
    for box in ('<div class="search-results">', '<section id="social-history">', '<div class="widget-guide">', '<div class="related-work">'):
        assert main_text(f"<article><p>{text}</p>{box}<h2>Head</h2><p>{text}</p></article>") == f"{text}\n\nHead\n\n{text}"
    links = "".join(f'<li><a href="/{i}">Another story {i}</a></li>' for i in range(9))
    assert main_text(f'<article><p>{text}</p><div class="related"><h3>Read on</h3><ul>{links}</ul></div></article>') == text
    assert main_text(f'<article><p>{text}</p><div class="comments"><p>{text}</p></div><div class="advert"><p>{text}</p></div></article>') == text


@pytest.mark.parametrize(
    "name,value,page",
    [
        ("STOP", frozenset(), f"<body><div><p>{LONG[:150]} <a href=1>{LONG[:50]}</a></p><p>{LONG}{LONG}</p></div></body>"),
        ("LINKS", 2.0, f'<body><article><p>{LONG}</p><p><a href=1>{LONG[:90]}</a> <a href=2>{LONG[:90]}</a></p></article></body>'),
        ("SHORT", 0, f"<body><div><p>See <a href=1>x</a> too</p></div><div><p>{LONG}{LONG}</p></div></body>"),
        ("LONG", 10_000, f"<body><div><p>{LONG}{LONG}</p></div></body>"),
        ("FEW", -1.0, f"<body><div><p>{PLAIN}</p></div></body>"),
    ],
)
def test_each_rule_decides(monkeypatch, name, value, page):
    """Without one of the rules, some page gives another text."""
    before = main_text(page)
    monkeypatch.setattr(rules, name, value)
    assert main_text(page) != before


def test_second_pass_decides(monkeypatch):
    page = f"<body><div><p>{LONG}{LONG}</p><p>Short line</p><p>{LONG}{LONG}</p></div></body>"
    assert "Short line" in main_text(page)
    monkeypatch.setattr(rules, "labelled", lambda found: [rules.decide(b) for b in found])
    assert "Short line" not in main_text(page)


@pytest.mark.parametrize("piece", ['<a href="x" ', "<a ", "<button>", "<noscript>x", "<div>", "</table>", "<!-- ", "<", "<a \">\" ", "<p class='", "<x>" * 3 + "</y>", "<svg>", "<![if x", "class" + " " * 50, "<div id=a ad ad=", "&amp", "<head>", "<div></span>"])
def test_broken_pages_take_linear_time(piece):
    page = "<p>Begin</p>" + piece * (400_000 // len(piece))
    for end in ("", '">'):
        began = time.time()
        main_text(page + end)
        assert time.time() - began < 4


def test_megabyte_of_unclosed_tags_under_a_second():
    began = time.time()
    main_text('<a href="x" ' * (1_000_000 // 12))
    assert time.time() - began < 1
