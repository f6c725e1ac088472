"""Blocks and chunks: golden cases."""

from corvane.functions.text import word_count
from corvane.operators.chunk import chunk_pages, heading_paths
from corvane.operators.parse import blocks_of, text_of
from corvane.sources.schemas import BLOCKS

kinds = lambda html: [(b["kind"], b["text"], b["level"]) for b in blocks_of(html)]


def test_block_kinds():
    html = "<style>x</style><h1>Top</h1><p>Intro <b>bold</b></p><h2>Sub</h2><ul><li>one</li><li>two<ul><li>deep</li></ul></li></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><pre>\ncode\n  more\n</pre><script>no</script>"
    assert kinds(html) == [("heading", "Top", 1), ("text", "Intro bold", None), ("heading", "Sub", 2), ("text", "- one\n- two deep", None), ("table", "A | B\n1 | 2", None), ("code", "code\n  more", None)]


def test_tolerance_and_quirks():
    assert kinds("<h6>x</h6>") == [("heading", "x", 4)]
    assert kinds("<div>bare text<p>kept</div>tail") == [("text", "kept", None)]
    assert kinds("<nav><p>menu</p></nav><blockquote>q</blockquote><p> </p>") == [("text", "q", None)]
    assert kinds("<p>one<p>two<br>lines<b>open<p>three") == [("text", "one", None), ("text", "two lines open", None), ("text", "three", None)]
    assert kinds("<table><tr><td>a<td></td><td><table><tr><td>in</td></tr></table></td></tr></table>") == [("table", "a | in\nin", None)]
    assert kinds("<html><head><title>t</title></head><body><section><div><p>deep &amp; far</p></div></section></body></html>") == [("text", "deep & far", None)]
    assert blocks_of(None) == blocks_of("") == []
    assert text_of("<body><nav>menu</nav><script>var a='</p>'</script>Real   <i>content</i> here.<style>p{}</style></body>") == "menu Real content here."


def chunks(spark, blocks, crumb="DOCS > Home > Guide", **options):
    rows = [("42", crumb, [(i, k, t, n) for i, (k, t, n) in enumerate(blocks)])]
    df = spark.createDataFrame(rows, f"page_id string, breadcrumb string, blocks {BLOCKS}")
    return chunk_pages(df, **options).orderBy("ordinal").collect()


def test_nesting_and_siblings(spark):
    got = chunks(spark, [("heading", "Setup", 1), ("heading", "Networking", 2), ("text", "a", None), ("heading", "Usage", 1), ("text", "b", None), ("text", "c", None)])
    assert [(c.chunk_id, c.breadcrumb, c.text) for c in got] == [("42:0", "DOCS > Home > Guide > Setup > Networking", "DOCS > Home > Guide > Setup > Networking\n\na"), ("42:1", "DOCS > Home > Guide > Usage", "DOCS > Home > Guide > Usage\n\nb\n\nc")]
    assert [(c.kind, c.whole) for c in got] == [("text", False)] * 2


def test_skipped_levels(spark):
    got = chunks(spark, [("heading", "A", 3), ("text", "x", None), ("heading", "B", 2), ("text", "y", None), ("heading", "C", 4), ("text", "z", None)], crumb="P")
    assert [c.breadcrumb for c in got] == ["P > A", "P > B", "P > B > C"]


def test_tables_and_code(spark):
    table = "\n".join(["h1 | h2"] + [f"r{i} | v{i}" for i in range(200)])
    [one] = chunks(spark, [("table", table, None)], max_tokens=50, count=word_count)
    assert one.whole and one.text.endswith(table)
    table = "\n".join(["h1 | h2"] + [f"r{i} | v{i}" for i in range(400)])
    many = chunks(spark, [("table", table, None)], hard_max_tokens=40, count=word_count)
    assert len(many) > 1 and not any(c.whole for c in many) and all(c.token_count <= 40 for c in many)
    bodies = [c.text.split("\n\n", 1)[1].split("\n") for c in many]
    assert all(b[0] == "h1 | h2" for b in bodies) and [x for b in bodies for x in b[1:]] == table.split("\n")[1:]
    code = "\n".join(f"line {i}" for i in range(300))
    parts = chunks(spark, [("code", code, None)], hard_max_tokens=25, count=word_count)
    assert len(parts) > 1 and all(c.token_count <= 25 for c in parts)
    assert "\n".join(c.text.split("\n\n", 1)[1] for c in parts) == code
    assert chunks(spark, [("table", "only | header | " + "x " * 90, None)], hard_max_tokens=10, count=word_count) == []


def test_text_budget(spark):
    got = chunks(spark, [("text", " ".join(f"w{i}" for i in range(500)), None)], max_tokens=60, count=word_count)
    assert len(got) > 1 and all(c.token_count <= 60 for c in got) and [c.ordinal for c in got] == list(range(len(got)))


def test_heading_paths_equal_the_stack(spark):
    import random

    r = random.Random(1)
    rows, want = [], {}
    for page in range(40):
        stack = []
        for pos in range(30):
            if r.random() < 0.6:
                n = r.randint(1, 4)
                stack = [h for h in stack if h[0] < n] + [(n, f"t{pos}")]
                rows.append((str(page), pos, "heading", f"t{pos}", n))
            else:
                rows.append((str(page), pos, "text", "x", None))
            want[str(page), pos] = " > ".join(t for _, t in stack)
    df = spark.createDataFrame(rows, "page_id string, pos int, kind string, text string, level int")
    assert {(x.page_id, x.pos): x.path for x in heading_paths(df).collect()} == want


def test_a_batch_is_parsed_in_parts(monkeypatch):
    """Of a batch of many pages only a part is Python objects at once, whatever the batch's size; nulls and bad pages stay in place."""
    import pyarrow as pa

    from corvane.operators import parse

    html = pa.array([None if i % 50 == 0 else f"<p>{i} " + "word " * 400 + "</p>" for i in range(4000)])
    monkeypatch.setattr(parse, "PART", 7)
    held = []
    listed = parse.pa.array
    monkeypatch.setattr(parse.pa, "array", lambda x, *a: (held.append(len(x)), listed(x, *a))[1])
    got = parse.in_parts(lambda h: None if h is None else parse.text_of(h).split()[0], pa.string(), html)
    assert max(held) <= 7 and got.to_pylist() == [None if i % 50 == 0 else str(i) for i in range(4000)]
    assert len(parse.in_parts(parse.text_of, pa.string(), html.slice(0, 0))) == 0
