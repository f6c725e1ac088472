"""A recorded wiki end to end: scan, extraction, gates, state, index, events."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import extract, sync
from corvane.operators.index import chunks_of, hashing_embedding, points, replaced
from corvane.operators.state import Snapshots, page_ids
from corvane.sources import recorded, retry, schemas, wiki
from corvane.sources.files import read_jsonl
from corvane.sources.settings import Settings
from corvane.streaming import events


def page(i, space, body="<h1>T</h1><p>B</p>", when="2026-09-01T10:00:00.000Z", **more):
    return {"id": str(i), "type": "page", "status": "current", "title": f"Page {i}", "space": {"key": space}, "version": {"when": when, "by": {"displayName": "Ada"}}, "ancestors": [{"title": "Home"}], "metadata": {"labels": {"results": [{"name": "runbook"}, {"name": ""}]}}, "body": {"view": {"value": body}}, "_links": {"base": "https://wiki.example/", "webui": f"/display/{space}/{i}"}} | more


@pytest.fixture
def folder(tmp_path):
    def put(pages, restrictions=()):
        (tmp_path / "pages.jsonl").write_text("\n".join(map(json.dumps, pages)), "utf-8")
        (tmp_path / "restrictions.jsonl").write_text("\n".join(map(json.dumps, restrictions)), "utf-8")
        return str(tmp_path)

    return put


def crawl(spark, folder, spaces, **options):
    rows = wiki.read_wiki(spark, recorded=folder, spaces=spaces, **options)
    return extract.extract_pages(rows.select(F.from_json("json", schemas.RAW_PAGE).alias("x")).select("x.*"))


def test_scan_pages_through_and_filters(spark, folder):
    f = folder([page(i, "ENG") for i in range(120)] + [page(500, "OPS"), page(501, "ENG", status="archived")])
    assert wiki.read_wiki(spark, recorded=f, spaces="ENG,OPS").count() == 121
    assert wiki.read_wiki(spark, recorded=f, spaces="ENG,OPS").where("space_key = 'OPS'").count() == 1
    with pytest.raises(Exception, match="UnknownSpace"):
        wiki.read_wiki(spark, recorded=f, spaces="NONE").count()
    f = folder([page(1, "ENG", when="2026-01-01"), page(2, "ENG", when="2026-02-01"), page(3, "OPS", when="2026-03-01")])
    assert [r.id for r in wiki.read_wiki(spark, recorded=f, spaces="ENG", since="2026-02-01").collect()] == ["2"]
    fetch = recorded.recorded_fetch(f)
    assert wiki.one_page(fetch, "3")["title"] == "Page 3" and "restrictions" in wiki.read_restrictions(fetch, "3")


def test_extracted_fields(spark, folder):
    f = folder([page(1, "ENG", body="<style>a{}</style><p>Real  content</p> here.<script>x</script>"), {"id": 2, "space": {"key": "ENG"}, "version": {"when": ""}}])
    one, two = crawl(spark, f, "ENG").orderBy("page_id").collect()
    assert (one.breadcrumb, one.url, one.labels, one.author, one.text) == ("ENG > Home > Page 1", "https://wiki.example/display/ENG/1", ["runbook"], "Ada", "Real content here.")
    assert len(one.content_hash) == 64
    assert (two.page_id, two.title, two.url, two.labels, two.ancestors, two.text, two.breadcrumb) == ("2", "", "", [], [], "", "ENG")


def test_restriction_shapes(spark):
    none, some, named = {"size": 0, "results": []}, {"size": 1, "results": []}, {"size": None, "results": ["x"]}
    rows = [("a", {"user": some, "group": none}, None, None), ("b", {"user": none, "group": none}, None, None), ("c", None, none, none), ("d", None, none, some), ("e", {"user": None, "group": named}, None, None), ("f", None, None, None)]
    df = spark.createDataFrame(rows, schemas.RESTRICTION)
    assert {r.page_id for r in extract.restricted_pages(df).collect()} == {"a", "d", "e"}


def test_sync_counts_and_gate(spark, folder, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/state")
    restricted = spark.createDataFrame([("3",)], "page_id string")
    seen = []
    f = folder([page(1, "ENG"), page(2, "ENG"), page(3, "ENG"), page(4, "OPS")])
    run = lambda: sync.sync(crawl(spark, f, "ENG,OPS"), restricted, store, lambda p: seen.append(sorted(r.page_id for r in p.collect())))
    assert run() == {"seen": 4, "indexed": 3, "skipped_restricted": 1, "skipped_unchanged": 0, "deleted": 0, "errors": 0}
    assert {r.page_id for r in page_ids(store.read()).collect()} == {"1", "2", "4"}
    assert page_ids(store.read(), ["OPS"]).count() == 1 and page_ids(store.read(), []).count() == 0
    folder([page(1, "ENG", body="<p>edited</p>"), page(2, "ENG", body="<h2>T</h2><p>B</p>"), page(3, "ENG"), page(4, "OPS")])
    assert run()["indexed"] == 1 and run()["indexed"] == 0
    assert seen[:2] == [["1", "2", "4"], ["1"]]
    sync.delete_pages(spark.createDataFrame([("4",)], "page_id string"), store)
    assert page_ids(store.read()).count() == 2
    restricted = spark.createDataFrame([("1",)], "page_id string")
    sync.sync(crawl(spark, f, "ENG,OPS"), restricted, store, purge_restricted=True)
    assert "1" not in {r.page_id for r in page_ids(store.read()).collect()}
    assert len(store.versions()) == 2


def test_replace_in_index(spark, folder):
    f = folder([page(1, "ENG"), page(2, "ENG")])
    index = points(chunks_of(crawl(spark, f, "ENG")), hashing_embedding(16)).collect()
    assert {(r.chunk_id, r.breadcrumb) for r in index} == {("1:0", "ENG > Home > Page 1 > T"), ("2:0", "ENG > Home > Page 2 > T")}
    f2 = folder([page(1, "ENG", body="<p>bare</p>"), page(2, "ENG", body="")])
    pages = crawl(spark, f2, "ENG")
    rows = {(r.chunk_id, r.text.split("\n\n")[1]) for r in replaced(spark.createDataFrame(index, schemas.POINT), pages, points(chunks_of(pages), hashing_embedding(16))).collect()}
    assert rows == {("1:0", "bare")}


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise retry.HttpError(503)
        return "ok"

    assert retry.with_retries(flaky, sleep=waits.append) == "ok" and 0.5 <= waits[0] <= 1 and 1 <= waits[1] <= 1.5
    for error in (retry.HttpError(404), ValueError()):
        with pytest.raises(type(error)):
            retry.with_retries(lambda e=error: (_ for _ in ()).throw(e), sleep=waits.append)
    with pytest.raises(FileNotFoundError):
        retry.with_retries(lambda: open("/none/such"), sleep=waits.append)
    with pytest.raises(retry.HttpError):
        retry.with_retries(lambda: (_ for _ in ()).throw(retry.HttpError(500)), waits=[0.1], sleep=waits.append)
    assert waits.pop() == 0.1
    assert len(waits) == 2 and retry.worth_retrying(ConnectionError()) and retry.worth_retrying(retry.HttpError(429))


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nSPACE_ALLOWLIST= ENG, ,OPS \nWIKI_PAT='t'\nRETRIEVE_TOP_K=7\nOTHER=1\n")
    s = Settings.read({"wiki_base_url": "https://x/", "Retrieve_Top_K": "9"}, str(tmp_path / ".env"))
    assert (s.space_allowlist, s.wiki_token, s.retrieve_top_k, s.wiki_base_url) == (["ENG", "OPS"], "t", 9, "https://x")


def test_jsonl(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a?", "gold_page_ids": ["1"]}\n\n  \n {"question": "b?", "gold_page_ids": []} \n')
    assert [tuple(r) for r in read_jsonl(spark, str(tmp_path / "q.jsonl")).collect()] == [("a?", ["1"]), ("b?", [])]


def test_event_shapes(spark):
    rows = ['{"page":{"id":5},"event":"page_created"}', '{"content":{"id":"6"},"eventType":"Page_Removed"}', '{"page_id":"7"}', '{"id":"8","event":"x_page_deleted_y"}', '{"page":"text","id":9}', "{}", "junk"]
    got = events.routed(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r.page_id, r.action) for r in got] == [("5", "sync"), ("6", "delete"), ("7", "sync"), ("8", "delete"), ("9", "sync"), (None, None), (None, None)]
    assert events.authorised(None, "s", "s") and not events.authorised("x", None, "s")
    assert not events.authorised(None, None, "") and not events.authorised("", "", "")  # no secret opens nothing


def test_stream(spark, tmp_path):
    rows = [(1, '{"page_id":"1"}'), (2, '{"page_id":"2"}'), (3, '{"page_id":"1","event":"page_trashed"}'), (4, '{"event":"none"}')]
    spark.createDataFrame(rows, "seq long, value string").write.parquet(f"{tmp_path}/in")
    got = {"sync": [], "delete": []}
    collect = lambda k: lambda df: got[k].extend(r.page_id for r in df.collect())
    go = lambda: events.sync_stream(spark.readStream.schema("seq long, value string").parquet(f"{tmp_path}/in"), collect("sync"), collect("delete"), f"{tmp_path}/cp").awaitTermination()
    go()
    assert got == {"sync": ["2"], "delete": ["1"]}
    go()  # nothing is read twice
    assert got == {"sync": ["2"], "delete": ["1"]}
