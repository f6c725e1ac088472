"""URL filters (6): rules, and propagation over redirects and canonical links."""

from corvane.llm import urls
from corvane.llm.queries import RULES


def test_rules_and_aliases(spark):
    page = lambda i, u, h="": (i, u, h, "clash")
    rows = [
        page(1, "https://A.Example.NET/en/1"),
        page(2, "http://a.example.net/fr/1"),
        page(3, "http://example.com/de/x?y#z"),
        page(4, "http://notexample.com/de/x"),
        page(5, "https://x.org/fr/"),
        page(6, None),
        page(7, "no scheme/en/"),
        page(8, "http://net"),
        page(9, "http://alias.io/1", '<link rel="canonical" href="http://spam.net/a">'),
        page(10, "http://alias.io/2", "<meta http-equiv=refresh content='0; url=http://alias.io/1'>"),
        page(11, "http://both.io/", '<link href="http://spam.net/b" rel=canonical>'),
        page(12, "http://other.io/", '<link rel="canonical" href="http://both.io/"><meta http-equiv="refresh" content="1;URL=http://x.org/fr/">'),
        page(13, "http://lone.io/"),
        page(13, "http://lone.io/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted((tuple(r) for r in urls.judge(pages, urls.page_edges(pages), RULES).collect()))
    assert got == [
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "a.example.net", "/fr/1", "net/", "block"),
        (3, "example.com", "/de/x", "example.com/de/", "block"),
        (4, "notexample.com", "/de/x", None, "allow"),
        (5, "x.org", "/fr/", "org/fr/", "allow"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "net", "", None, "allow"),
        (9, "alias.io", "/1", None, "block"),
        (10, "alias.io", "/2", None, "block"),
        (11, "both.io", "/", None, "allow"),
        (12, "other.io", "/", None, "allow"),
        (13, "lone.io", "/", None, "allow"),
        (13, "lone.io", "/", None, "allow"),
    ]


def test_sql_agrees_where_pages_link(spark, tmp_path):
    import duckdb

    from corvane.llm import queries

    hosts = ["a.net", "b.io", "c.io", "d.example.com", "e.org", "f.io"]
    rows = [(i, f"http://{hosts[i % 6]}/{'de' if i % 2 else 'fr'}/{i % 40}", f'<link rel="canonical" href="http://{hosts[(i * 7) % 6]}/fr/{(i * 3) % 40}">' if i % 3 else "") for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    order = lambda x: sorted(map(repr, x))
    got = queries.op6_urls(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert order(map(tuple, got)) == order(con.execute(queries.OP6).fetchall())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages, urls.page_edges(pages), RULES).collect() == []


def test_relative_targets(spark):
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    rows = [
        (1, "http://example.com/old", refresh("/de/new")),
        (2, "https://a.io/x", '<link rel="canonical" href="//spam.net/a">'),
        (3, "http://example.com/a/b", '<link rel=canonical href="../de/x?a=1&amp;b=2">'),
        (4, "http://a.io/4", '<base href="http://example.com/de/">' + refresh("y")),
        (5, "http://a.io/5", refresh("mailto:x") + '<link rel="canonical" href="http://[/">'),
        (6, "no scheme", refresh("/de/new")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.a, r.b) for r in urls.page_edges(pages).collect()}
    assert {b for _, b in edges} == {"http://example.com/de/new", "https://spam.net/a", "http://example.com/de/x?a=1&b=2", "http://example.com/de/y", "http://[/"}
    got = {r.page_id: r.verdict for r in urls.judge(pages, urls.page_edges(pages), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}


def test_tags_alone_make_edges():
    at = lambda h: urls.targets(h)[1]
    assert at('<link rel="nofollow canonical" href="http://a.io/">') == at("<LINK HREF='http://a.io/' REL=Canonical>") == at('<link title="a > b" rel="canonical" href="http://a.io/">') == ["http://a.io/"]
    for hidden in ('<!-- <link rel="canonical" href="http://a.io/"> -->', '<script>"<link rel=canonical href=http://a.io/>"</script>', '<link rel="canonically" href="http://a.io/">', '<link rel="canonical">', '<meta http-equiv="refresh" content="5">'):
        assert at(hidden) == []
    assert at("<meta http-equiv=Refresh content='0;URL=\"http://a.io/?a=1&amp;b=2\"'>") == ["http://a.io/?a=1&b=2"]


def test_thousands_of_pages_with_chains_and_hubs(spark, tmp_path):
    """Long chains of redirects, a hub that very many pages name, loops and shared targets, against the SQL."""
    import duckdb

    from corvane.llm import queries

    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = []
    for i in range(2000):  # a hub, undecided itself, of which one alias is blocked
        rows.append((f"http://hub{i % 7}.io/{i}", link("http://hub.io/")))
    rows.append(("http://hub.io/", link("http://spam.net/x")))
    for c in range(20):  # chains of 60 pages; the end of every other is decided, of every sixth by an allow too
        for i in range(60):
            to = f"http://c{c}.io/{i + 1}" if i < 59 else (f"http://spam.net/{c}" if c % 2 else "http://c.io/end")
            rows.append((f"http://c{c}.io/{i}", link(to)))
        if c % 6 == 1:
            rows.append((f"http://c{c}.io/30", link("http://x.org/fr/")))
    for i in range(300):  # loops
        rows.append((f"http://loop.io/{i}", link(f"http://loop.io/{(i + 1) % 300}")))
    rows += [(f"http://lone{i}.io/", "") for i in range(500)]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in queries.op6_urls(spark, str(tmp_path)).collect()}
    block = lambda u: u.startswith("http://hub") or (u.startswith("http://c") and "://c." not in u and int(u[8:].split(".")[0]) % 2 == 1 and int(u[8:].split(".")[0]) % 6 != 1)
    assert got == {i: "block" if block(u) else "allow" for i, (u, _) in enumerate(rows)}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet' where url like '%loop%' or url like '%lone%' or url like '%c1.io%'")
    assert {r[0]: r[4] for r in con.execute(queries.OP6).fetchall()}.items() <= got.items()
