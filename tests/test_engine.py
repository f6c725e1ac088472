"""The engine, its HTTP surface and its command line over a recorded wiki."""

import json

import pytest

from corvane import cli
from corvane.engine import Engine
from corvane.service import handle
from corvane.sources.settings import Settings

from .test_sync_and_sources import page


@pytest.fixture
def engine(spark, tmp_path):
    bodies = {1: "<h1>Backups</h1><p>Backups of the database run every night at two.</p>", 2: "<h1>Deploy</h1><p>Deploy a release by pushing a tag.</p>", 3: "<h1>Access</h1><p>Ask the desk for access to the cluster.</p>"}
    (tmp_path / "pages.jsonl").write_text("\n".join(json.dumps(page(i, "ENG", b)) for i, b in bodies.items()))
    s = Settings(space_allowlist=["ENG"], catalog_dir=f"{tmp_path}/catalog", state_dir=f"{tmp_path}/state", embed_dim=32, webhook_secret="s")
    return Engine(spark, s, recorded=str(tmp_path))


def test_crawl_ask_and_events(engine, tmp_path, capsys):
    assert cli.main(["sync"], engine) == 0 and engine.index.read().count() == 3
    status, got = handle(engine, "POST", "/query", {}, b'{"question": "When do backups of the database run?"}')
    assert status == 200 and got["used_context"] and got["citations"][0]["page_id"] == "1" and got["citations"][0]["title"] == "Page 1"
    status, got = handle(engine, "POST", "/query", {}, '{"question": "Völlig anderes Thema?"}'.encode())
    assert (got["used_context"], got["citations"]) == (False, [])
    assert handle(engine, "POST", "/query", {}, b'{"question": " "}')[0] == 422
    assert handle(engine, "GET", "/health", {}, b"")[0] == 200 and handle(engine, "GET", "/x", {}, b"")[0] == 404
    assert handle(engine, "POST", "/webhook", {}, b'{"page_id": "1"}')[0] == 401
    header = {"X-Webhook-Secret": "s"}
    assert handle(engine, "POST", "/webhook", header, b"{}")[0] == 422
    assert handle(engine, "POST", "/webhook?secret=s", {}, b'{"page": {"id": 1}, "event": "page_updated"}')[1]["stats"]["skipped_unchanged"] == 1
    assert handle(engine, "POST", "/webhook", header, b'{"id": "1", "event": "page_trashed"}')[1]["status"] == "deleted"
    assert engine.index.read().count() == engine.state.read().count() == 2
    (tmp_path / "q.jsonl").write_text('{"question": "How to deploy a release?", "gold_page_ids": ["2"]}\n')
    assert cli.main(["evaluate", "--dataset", f"{tmp_path}/q.jsonl", "--k", "1"], engine) == 0
    assert "reranker on: hit rate@1 1.000, MRR 1.000" in capsys.readouterr().out
    assert cli.main(["reindex"], engine) == 0 and engine.index.read().count() == 3


def test_a_missing_space_ends_the_scan(engine):
    engine.settings.space_allowlist.append("NONE")
    assert cli.main(["sync"], engine) == 2


def put(tmp_path, pages, restrictions=()):
    (tmp_path / "pages.jsonl").write_text("\n".join(map(json.dumps, pages)))
    (tmp_path / "restrictions.jsonl").write_text("\n".join(map(json.dumps, restrictions)))


SOME, NONE = {"size": 1, "results": [{"username": "ada"}]}, {"size": 0, "results": []}


def test_restricted_pages_stay_out_by_every_way(engine, tmp_path):
    """A crawl, an event and a stream ask the wiki who may read a page, and a page that became restricted can be purged."""
    secret = "Salaries are listed in the vault."
    pages = [page(1, "ENG", "<p>Public text about backups.</p>"), page(2, "ENG", f"<p>{secret}</p>"), page(3, "OPS", f"<p>{secret}</p>")]
    limits = [{"id": "2", "restrictions": {"user": SOME, "group": NONE}}, {"id": "3", "user": NONE, "group": SOME}]
    put(tmp_path, pages, limits)
    assert cli.main(["sync"], engine) == 0
    assert {r.page_id for r in engine.index.read().collect()} == {r.page_id for r in engine.state.read().collect()} == {"1"}
    header = {"X-Webhook-Secret": "s"}
    for i in ("2", "3"):
        got = handle(engine, "POST", "/webhook", header, json.dumps({"page_id": i, "event": "page_updated"}).encode())
        assert got[0] == 200 and got[1]["stats"]["skipped_restricted"] == 1
    assert not handle(engine, "POST", "/query", {}, json.dumps({"question": secret}).encode())[1]["used_context"]
    put(tmp_path, pages)  # nobody restricts them any more: an event brings in even a page of another space
    assert handle(engine, "POST", "/webhook", header, b'{"page_id": "3"}')[1]["stats"]["indexed"] == 1
    assert cli.main(["sync"], engine) == 0 and engine.state.read().count() == 3
    put(tmp_path, pages, limits)
    assert engine.run_sync()["skipped_restricted"] == 1 and engine.state.read().count() == 3
    assert engine.run_sync(purge_restricted=True)["skipped_restricted"] == 1
    assert "2" not in {r.page_id for r in engine.index.read().collect()} | {r.page_id for r in engine.state.read().collect()}


def test_a_page_that_fails_ends_nothing(engine, tmp_path):
    """One that can't be parsed, one whose restrictions can't be read, one that isn't there."""
    put(tmp_path, [page(1, "ENG", "<p>Good</p>"), page(2, "ENG", "<![unknown[<p>Bad</p>"), page(3, "ENG", "<p>Who may read?</p>")], [{"id": "3", "status": 403}])
    got = engine.run_sync()
    assert (got["seen"], got["indexed"], got["errors"]) == (3, 1, 2)
    assert {r.page_id for r in engine.index.read().collect()} == {"1"}
    assert cli.main(["sync"], engine) == 1
    got = engine.sync_pages(engine.spark.createDataFrame([("1",), ("99",), ("2",)], "page_id string"))
    assert (got["seen"], got["skipped_unchanged"], got["errors"]) == (3, 1, 2)


def test_point_lookup_goes_to_the_source(engine, tmp_path):
    from corvane.sources import wiki

    put(tmp_path, [page(i, "ENG") for i in range(4)] + [page(7, "OPS")])
    rows = wiki.read_wiki(engine.spark, recorded=str(tmp_path), spaces="ENG")
    found = rows.where("id in ('2', '7', '55')")
    assert [r.id for r in found.collect()] == ["2"] and found.rdd.getNumPartitions() == 1


def test_stream_keeps_the_index_current(engine, tmp_path):
    put(tmp_path, [page(1, "ENG", "<p>One</p>"), page(2, "ENG", "<p>Two</p>")], [{"id": "2", "restrictions": {"user": SOME, "group": NONE}}])
    rows = [(1, '{"page_id":"1"}'), (2, '{"page_id":"2"}')]
    engine.spark.createDataFrame(rows, "seq long, value string").write.parquet(f"{tmp_path}/events")
    engine.follow(engine.spark.readStream.schema("seq long, value string").parquet(f"{tmp_path}/events"), f"{tmp_path}/at").awaitTermination()
    assert [r.page_id for r in engine.index.read().collect()] == ["1"]


def test_writers_meet(engine):
    from corvane.operators.state import Conflict, Snapshots

    rows = lambda *ids: engine.spark.createDataFrame([(i, "h", "", "ENG", "", "") for i in ids], "page_id string, content_hash string, last_modified string, space_key string, title string, url string")
    engine.state.write(rows("1", "2", "3"))
    slow = Snapshots(engine.spark, engine.state.path)
    written = slow._written
    slow._written = lambda df, n: (engine.state.replace(rows("2")), written(df, n))[1]  # another writer is faster
    with pytest.raises(Conflict):
        slow.replace(rows("9").select("page_id"), rows("9"))
    assert {r.page_id for r in engine.state.read().collect()} == {"1", "3"}
    version = engine.state.versions()[-1]
    engine.state.replace(rows().select("page_id"))
    assert engine.state.versions()[-1] == version  # nothing to do writes nothing
    engine.state.grace = 0.0
    for i in range(3):
        engine.state.replace(rows(str(i)).select("page_id"), rows(str(i)))
    assert {r.page_id for r in engine.state.read().collect()} == {"0", "1", "2", "3"} and len(engine.state.versions()) == 2


def test_misses_are_told(engine, tmp_path, capsys):
    assert cli.main(["sync"], engine) == 0
    (tmp_path / "q.jsonl").write_text('{"question": "How to deploy a release?", "gold_page_ids": ["77"]}\n')
    assert cli.main(["evaluate", "--dataset", f"{tmp_path}/q.jsonl", "--k", "1"], engine) == 0
    assert "missed, reranker on: rank -: How to deploy a release? (wanted 77)" in capsys.readouterr().out


@pytest.fixture
def server():
    """A local service that answers like the models' addresses, and what it was asked."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body))
            if self.path == "/v1/embeddings":
                out = {"data": [{"embedding": [float(len(t)), 1.0]} for t in body["input"]]}
            elif self.path == "/rerank":
                out = {"results": [{"index": i, "relevance_score": 0.9 if "tag" in d else 0.1} for i, d in reversed(list(enumerate(body["documents"])))]}
            else:
                out = {"choices": [{"message": {"content": "Push a tag [1]."}}]}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_models_at_their_addresses(spark, engine, tmp_path, server):
    """With addresses set, the engine embeds, reranks and answers through them, and asks the chat model once a question."""
    at, asked = server
    s = Settings(space_allowlist=["ENG"], catalog_dir=f"{tmp_path}/c2", state_dir=f"{tmp_path}/s2", embed_base_url=f"{at}/v1", embed_model="e", embed_batch=2, rerank_url=f"{at}/rerank", rerank_api_key="k", rerank_model="r", llm_base_url=f"{at}/v1", llm_model="m", llm_disable_thinking=True)
    remote = Engine(spark, s, recorded=engine.recorded)
    assert remote.run_sync()["indexed"] == 3
    row = remote.answer(spark.createDataFrame([(0, "How is a release deployed?")], "qid int, question string")).collect()[0]
    assert row.used_context and row.answer == "Push a tag [1]." and [c.page_id for c in row.citations] == ["2"]
    chats = [b for p, _, b in asked if p == "/v1/chat/completions"]
    assert len(chats) == 1 and chats[0]["chat_template_kwargs"] == {"enable_thinking": False} and chats[0]["max_tokens"] == 1500
    assert chats[0]["messages"][1]["content"].startswith("Frage: How is a release deployed?\n\nKontext:\n[1] Titel: Page 2")
    ranks = [(k, b) for p, k, b in asked if p == "/rerank"]
    assert ranks and all(k == "Bearer k" and b["model"] == "r" and b["query"] == "How is a release deployed?" for k, b in ranks)
    assert all(len(b["input"]) <= 2 for p, _, b in asked if p == "/v1/embeddings")
    assert remote.answer(spark.createDataFrame([(0, "\t\u00a0")], "qid int, question string")).collect() == []
